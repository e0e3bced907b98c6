"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import profiles as prof
from driftline.plans.base import Plans, rounded, table

plans = Plans()


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("year", F.year("o_orderdate"))


_LINES = "(SELECT *, year(o_orderdate) AS year FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@plans.query("role_profiles", f"""
SELECT year, p_type, count(*) AS rows, sum((l_returnflag <> 'R')::INT)::BIGINT AS complete_rows, count(DISTINCT l_orderkey) AS games, count(DISTINCT l_suppkey) AS players, round_even(avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 4) AS avg_quantity, round_even(avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 6) AS avg_discount FROM {_LINES} GROUP BY ALL""")
def role_profiles(spark, sf_dir):
    df = prof.profile(_lines(spark, sf_dir), ["year", "p_type"], {"games": "l_orderkey", "players": "l_suppkey"}, {"avg_quantity": "l_quantity", "avg_discount": "l_discount"}, F.col("l_returnflag") != "R")
    return df.withColumns({"avg_quantity": rounded("avg_quantity"), "avg_discount": rounded("avg_discount", 6)})


_PERFORMANCE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber", "p_size", "p_retailprice", "l_suppkey", "l_partkey"]


@plans.query("role_profile_table", f"""
WITH l AS {_LINES}, g AS (SELECT year, p_type, p_brand, count(l_orderkey) AS champion_games, sum((l_linestatus = 'F')::INT)::BIGINT AS wins, sum((l_returnflag <> 'R')::INT)::BIGINT AS complete_stat_games, count(DISTINCT l_suppkey) AS unique_players, count(DISTINCT l_shipdate::DATE) AS unique_teams, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
 {', '.join(f"round_even(avg(CASE WHEN l_returnflag <> 'R' THEN {c}::DOUBLE END), 3) AS avg_{c}" for c in _PERFORMANCE)} FROM l GROUP BY ALL)
SELECT *, (sum(champion_games) OVER r)::BIGINT AS role_games_in_context, round_even(champion_games::DOUBLE / (sum(champion_games) OVER r)::DOUBLE, 4) AS role_pick_rate, round_even(wins::DOUBLE / champion_games, 4) AS win_rate, round_even(complete_stat_games::DOUBLE / champion_games, 4) AS complete_stats_share FROM g WINDOW r AS (PARTITION BY year, p_type)""")
def role_profile_table(spark, sf_dir):
    """All aggregates of an item's profile by year and role."""
    lines = _lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_p"), "p_size", "p_retailprice"), F.col("l_partkey") == F.col("_p")).withColumn("day", F.to_date("l_shipdate"))
    return prof.role_profiles(lines, ["year"], "p_type", "p_brand", "l_orderkey", F.col("l_linestatus") == "F", F.col("l_returnflag") != "R", "l_suppkey", "day", "l_shipdate", _PERFORMANCE)


@plans.query("presence", f"""
WITH l AS {_LINES} SELECT year, p_brand, round_even(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)::DOUBLE / any_value(games), 6) AS ban_rate, round_even(count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END)::DOUBLE / any_value(games), 6) AS pick_rate
FROM l JOIN (SELECT year, count(DISTINCT l_orderkey) AS games FROM l GROUP BY 1) USING (year) GROUP BY ALL""")
def presence(spark, sf_dir):
    df = prof.rates(_lines(spark, sf_dir), ["year"], "p_brand", "l_orderkey", F.col("l_returnflag") == "R")
    return df.select("year", "p_brand", rounded("ban_rate", 6).alias("ban_rate"), rounded("pick_rate", 6).alias("pick_rate"))


@plans.query("denial_rates", """
WITH r AS (SELECT user_id, event_type, count(DISTINCT CASE WHEN value < 10 THEN day END)::DOUBLE / any_value(g) AS ban, count(DISTINCT CASE WHEN NOT value < 10 THEN day END)::DOUBLE / any_value(g) AS pick FROM (SELECT *, ts::DATE AS day FROM events) JOIN (SELECT user_id, count(DISTINCT ts::DATE) AS g FROM events GROUP BY 1) USING (user_id) GROUP BY ALL)
SELECT user_id, event_type, round_even(ban, 6) AS ban_rate, round_even(greatest(0.05, least(1.0, 1 - (0.70 * ban + 0.30 * pick))), 6) AS availability FROM r""")
def denial_rates(spark, sf_dir):
    df = prof.rates(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id"], "event_type", "day", F.col("value") < 10)
    return df.select("user_id", "event_type", rounded("ban_rate", 6).alias("ban_rate"), rounded(prof.availability(F.col("ban_rate"), F.col("pick_rate")), 6).alias("availability"))


@plans.query("weekly_summary", """
WITH e AS (SELECT *, ((ts::DATE - min(ts::DATE) OVER (PARTITION BY user_id)) // 7 + 1)::INT AS week FROM events)
SELECT user_id, week, min(ts) AS started, count(*) AS games, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types, round_even(sum(value), 2) AS total, round_even(avg(value), 9) AS per_game FROM e GROUP BY ALL""")
def weekly_summary(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    df = df.withColumn("week", prof.relative_week(F.col("day"), ["user_id"]))
    return df.groupBy("user_id", "week").agg(F.min("ts").alias("started"), F.count("*").alias("games"), F.array_join(F.sort_array(F.collect_set("event_type")), ", ").alias("types"), rounded(F.sum("value"), 2).alias("total"), rounded(F.avg("value"), 9).alias("per_game"))


@plans.query("profile_rollup", """
WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, avg(value) AS mean, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY ALL)
SELECT user_id, count(*) AS weeks, round_even(sum(mean), 6) AS total, round_even(sum(mean) / count(*), 6) AS average, arg_max(last_type, week) AS latest, string_agg(week::VARCHAR || '=' || n::VARCHAR, ';' ORDER BY week) AS weekly_stats FROM w GROUP BY 1""")
def profile_rollup(spark, sf_dir):
    weekly = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    entries = F.array_sort(F.collect_list(F.struct("week", "n")))
    return weekly.groupBy("user_id").agg(F.count("*").alias("weeks"), rounded(F.sum("mean"), 6).alias("total"), rounded(F.sum("mean") / F.count("*"), 6).alias("average"), F.max_by("last_type", "week").alias("latest"), F.array_join(F.transform(entries, lambda x: F.concat(x["week"].cast("string"), F.lit("="), x["n"].cast("string"))), ";").alias("weekly_stats"))


@plans.query("halves", """
SELECT user_id, half, count(*) AS n, round_even(avg(value), 9) AS mean FROM (SELECT *, ntile(2) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS half FROM events) GROUP BY ALL""")
def halves(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.withColumn("half", prof.halves(["user_id"], ["ts", "event_id"])).groupBy("user_id", "half").agg(F.count("*").alias("n"), rounded(F.avg("value"), 9).alias("mean"))


@plans.query("tier_matrix", f"""
WITH l AS {_LINES}, i AS (SELECT year, p_brand, count(DISTINCT l_orderkey) AS n, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_orderkey END) AS wins FROM l GROUP BY ALL),
s AS (SELECT year, p_brand, n::DOUBLE / games AS p, 0.7 * (n::DOUBLE / games) + 0.3 * ((wins + 5) / (n + 10)::DOUBLE) AS s FROM i JOIN (SELECT year, count(DISTINCT l_orderkey) AS games FROM l GROUP BY 1) USING (year))
SELECT year, p_brand, round_even(p, 6) AS presence, round_even(s, 6) AS score, tier, CASE tier WHEN 'S' THEN 1.35::DOUBLE WHEN 'A' THEN 1.15 WHEN 'B' THEN 0.9 ELSE 0.7 END AS multiplier FROM (SELECT *, CASE WHEN s >= 0.25 OR p >= 0.30 THEN 'S' WHEN s >= 0.15 OR p >= 0.15 THEN 'A' WHEN s >= 0.08 OR p >= 0.05 THEN 'B' ELSE 'C' END AS tier FROM s)""")
def tier_matrix(spark, sf_dir):
    df = prof.tiers(_lines(spark, sf_dir), ["year"], "p_brand", "l_orderkey", F.col("l_returnflag") == "N")
    return df.select("year", "p_brand", rounded("presence", 6).alias("presence"), rounded("score", 6).alias("score"), "tier", prof.tier_multiplier(F.col("tier")).alias("multiplier"))


@plans.query("lane_means", f"""
SELECT p_brand, p_type, round_even(least(1.0, greatest(0.0, 0.5 + cs / 40)), 6) AS push, greatest(0.5, round_even(1 + cs / 50 + gold / 1000, 2)) AS priority FROM (SELECT p_brand, p_type, avg(coalesce(l_quantity - 25, 0)) AS cs, avg(coalesce(nullif(l_discount, 0) * 1000, 0)) AS gold FROM {_LINES} GROUP BY ALL)""")
def lane_means(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumns({"cs": F.col("l_quantity") - 25, "gold": F.when(F.col("l_discount") != 0, F.col("l_discount") * 1000)})
    return prof.lanes(df, ["p_brand", "p_type"], "cs", "gold").withColumn("push", rounded("push", 6))


@plans.query("priors", f"SELECT year, p_brand, n, round_even(n::DOUBLE / (sum(n) OVER (PARTITION BY year))::DOUBLE, 6) AS prior FROM (SELECT year, p_brand, count(*) AS n FROM {_LINES} GROUP BY ALL)")
def priors(spark, sf_dir):
    return prof.priors(_lines(spark, sf_dir), ["year"], "p_brand").withColumn("prior", rounded("prior", 6))


@plans.query("training_weights", """
SELECT o_orderkey, round_even(pow(0.5, (DATE '2002-01-01' - o_orderdate::DATE) / 365.0) * pow(0.70, gap), 6) AS weight FROM orders JOIN (SELECT o_orderpriority, dense_rank() OVER (ORDER BY max(o_orderdate) DESC, o_orderpriority) - 1 AS gap FROM orders GROUP BY 1) USING (o_orderpriority)""")
def training_weights(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # one row a version: the ranking is over these few rows
    versions = orders.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("last"))
    gaps = versions.withColumn("gap", F.dense_rank().over(prof.Window.orderBy(F.col("last").desc(), "o_orderpriority")) - 1)
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    return orders.join(F.broadcast(gaps), "o_orderpriority").select("o_orderkey", rounded(prof.training_weight(age, F.col("gap")), 6).alias("weight"))


@plans.query("pool_concentration", """
WITH c AS (SELECT user_id, event_type, event_id % 9 AS item, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, item) AS k FROM c)
SELECT user_id, event_type, items, round_even(top, 6) AS top_share, CASE WHEN items <= 3 OR top >= 0.75 THEN 'Concentrated' WHEN items >= 8 AND top <= 0.55 THEN 'Wide' ELSE 'Balanced' END AS label FROM (SELECT user_id, event_type, count(*) AS items, sum(CASE WHEN k <= 3 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS top FROM r GROUP BY ALL)""")
def pool_concentration(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 9).alias("item")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(prof.Window.partitionBy("user_id", "event_type").orderBy(F.col("n").desc(), "item")))
    df = ranked.groupBy("user_id", "event_type").agg(F.count("*").alias("items"), (F.sum(F.when(F.col("k") <= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("top"))
    return df.select("user_id", "event_type", "items", rounded("top", 6).alias("top_share"), prof.pool_label(F.col("top"), F.col("items")).alias("label"))


@plans.query("ban_lift", """
WITH e AS (SELECT user_id, event_type, ts::DATE AS day FROM events)
SELECT user_id, event_type, round_even(rate, 6) AS rate, round_even(g, 6) AS global_rate, round_even(rate - g, 6) AS lift FROM (SELECT user_id, event_type, count(DISTINCT day)::DOUBLE / (SELECT count(DISTINCT day) FROM e b WHERE b.user_id = e.user_id) AS rate, (SELECT count(DISTINCT day) FROM e b WHERE b.event_type = e.event_type)::DOUBLE / (SELECT count(DISTINCT day) FROM e) AS g FROM e GROUP BY user_id, event_type)""")
def ban_lift(spark, sf_dir):
    df = prof.lift(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id"], "event_type", "day")
    return df.select("user_id", "event_type", *(rounded(c, 6).alias(c) for c in ("rate", "global_rate", "lift")))


@plans.query("coach_mean", """
SELECT s_nationkey AS team, round_even(avg(s_acctbal), 6) AS projected, count(*) AS starters, string_agg(s_name, ',' ORDER BY s_name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 5 GROUP BY 1""")
def coach_mean(spark, sf_dir):
    rank = F.row_number().over(prof.Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    df = table(spark, sf_dir, "supplier").withColumn("r", rank).where("r <= 5")
    return df.groupBy(F.col("s_nationkey").alias("team")).agg(rounded(F.avg("s_acctbal"), 6).alias("projected"), F.count("*").alias("starters"), F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names"))
