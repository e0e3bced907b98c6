"""Read-side queries: filters, cards, pivots, boards and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import vector_index, vectors
from driftline.operators.ranking import top_per_group
from driftline.plans.base import Plans, rounded, table
from driftline.plans.folds import _PATH, price_path

plans = Plans()


@plans.query("cosine_topk", """
SELECT vec_id, round_even(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10""")
def cosine_topk(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings")
    query = [float(x) for x in data.where("vec_id = 0").first()["embedding"]]
    return vectors.nearest(data, query, "embedding", "vec_id", 10).withColumn("similarity", rounded("similarity", 6))


@plans.query("vector_search", """
SELECT query, key, round_even(s, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, key) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS key, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def vector_search(spark, sf_dir):
    """The ten nearest of all vectors to each query, exactly."""
    rows = table(spark, sf_dir, "embeddings")
    found = vector_index.nearest_to_each(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return found.select("query", "key", rounded("similarity", 6).alias("similarity"), "rank")


@plans.query("learning_state", """
SELECT o_orderpriority AS category, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS severity, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS snippets FROM orders GROUP BY 1""")
def learning_state(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("severity"), F.col("o_orderstatus").alias("snippet"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    state, more = orders.where(F.year("at.o_orderdate") < 1998), orders.where(F.year("at.o_orderdate") >= 1998)
    return vectors.learn(state, more).select("category", "severity", F.array_join("snippets", ",").alias("snippets"))


@plans.query("filter_agg", """
SELECT user_id, count(*) AS games, round_even(sum(value) / count(*), 9) AS mean FROM events WHERE user_id::VARCHAR LIKE '%1%' AND event_type IN ('click', 'view') AND ts >= '2024-01-08' GROUP BY 1""")
def filter_agg(spark, sf_dir):
    df = table(spark, sf_dir, "events").where(F.col("user_id").cast("string").contains("1") & F.col("event_type").isin("click", "view") & (F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")))
    return df.groupBy("user_id").agg(F.count("*").alias("games"), rounded(F.sum("value") / F.count("*"), 9).alias("mean"))


@plans.query("kpis", """
WITH u AS (SELECT user_id, sum(value) AS total FROM events GROUP BY 1) SELECT count(*) AS players, arg_max(user_id, (total, user_id)) AS top_player, round_even(avg(total), 4) AS mean_total, (SELECT max(date_trunc('week', ts))::DATE FROM events) AS last_week FROM u""")
def kpis(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    totals = events.groupBy("user_id").agg(F.sum("value").alias("total"), F.max("ts").alias("last"))
    return totals.agg(F.count("*").alias("players"), F.max_by("user_id", F.struct("total", "user_id")).alias("top_player"), rounded(F.avg("total")).alias("mean_total"), F.to_date(F.date_trunc("week", F.max("last"))).alias("last_week"))


#: The SQL names the weeks of the season, so a week more that Spark finds is a difference and not lost.
_WEEKS = ", ".join(f"round_even(avg(value) FILTER (WHERE w = {k}), 9) AS week_{k}" for k in range(1, 6))


@plans.query("week_pivot", f"SELECT user_id, {_WEEKS} FROM (SELECT user_id, (ts::DATE - DATE '2024-01-01') // 7 + 1 AS w, value FROM events) GROUP BY user_id")
def week_pivot(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("w", F.concat(F.lit("week_"), (F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7) + 1).cast("string")))
    # the weeks of a season are few; Spark finds them
    return df.groupBy("user_id").pivot("w").agg(rounded(F.avg("value"), 9))


@plans.query("path_metrics", f"{_PATH} SELECT user_id, period, arg_min(price, week) AS start, arg_max(next_price, week) AS latest, round_even(arg_max(next_price, week) - arg_min(price, week), 3) AS change FROM p GROUP BY ALL")
def path_metrics(spark, sf_dir):
    first, last = F.min_by("price", "week"), F.max_by("next_price", "week")
    return price_path(spark, sf_dir).groupBy("user_id", "period").agg(first.alias("start"), last.alias("latest"), rounded(last - first, 3).alias("change"))


@plans.query("top_trends", """
WITH t AS (SELECT user_id FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 5) SELECT user_id, date_trunc('week', ts)::DATE AS week, round_even(sum(value), 2) AS total FROM events WHERE user_id IN (SELECT user_id FROM t) GROUP BY ALL""")
def top_trends(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    top = events.groupBy("user_id").agg(F.sum("value").alias("all")).orderBy(F.col("all").desc(), "user_id").limit(5)
    return events.join(F.broadcast(top), "user_id").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(rounded(F.sum("value"), 2).alias("total"))


@plans.query("tier_board", """
WITH s AS (SELECT DISTINCT user_id FROM events), t(tier, lo, hi) AS (VALUES ('1.3x', 0, 20), ('1.5x', 20, 60), ('1.7x', 60, 1000000)), r AS (SELECT user_id, tier, event_id, row_number() OVER (PARTITION BY user_id, tier ORDER BY value DESC, event_id) AS k FROM events JOIN t ON value >= lo AND value < hi WHERE event_type = 'purchase')
SELECT user_id, tier, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY k), '') AS options, count(event_id) > 0 AS available FROM s CROSS JOIN t LEFT JOIN (SELECT * FROM r WHERE k <= 3) USING (user_id, tier) GROUP BY ALL""")
def tier_board(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tier = F.when(F.col("value") < 20, "1.3x").when(F.col("value") < 60, "1.5x").otherwise("1.7x")
    bought = events.where("event_type = 'purchase' AND value >= 0").withColumn("tier", tier)
    best = top_per_group(bought, ["user_id", "tier"], [F.col("value").desc(), "event_id"], 3)
    options = best.groupBy("user_id", "tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("options"))
    board = events.select("user_id").distinct().withColumn("tier", F.explode(F.array(*map(F.lit, ("1.3x", "1.5x", "1.7x")))))
    return board.join(options, ["user_id", "tier"], "left").select("user_id", "tier", F.coalesce("options", F.lit("")).alias("options"), F.col("options").isNotNull().alias("available"))


@plans.query("matchup_board", """
SELECT least(a, b) || '-' || greatest(a, b) AS matchup, count(*) AS picks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS contested FROM (SELECT (user_id % 10)::VARCHAR AS a, (event_id % 10)::VARCHAR AS b, event_type FROM events) WHERE a <> b GROUP BY 1""")
def matchup_board(spark, sf_dir):
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").alias("a"), (F.col("event_id") % 10).cast("string").alias("b"), "event_type").where("a <> b")
    return df.groupBy(F.array_join(F.array_sort(F.array("a", "b")), "-").alias("matchup")).agg(F.count("*").alias("picks"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("contested"))


@plans.query("distinct_values", "SELECT DISTINCT event_type, ts::DATE AS day FROM events")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
