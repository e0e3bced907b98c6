"""Fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.numbers import half_even, ordered_mean
from driftline.operators import context, folds
from driftline.operators.asof import bucket_length
from driftline.plans.base import Plans, micros, rounded, table

plans = Plans()
HOUR = 3_600_000_000


def _weeks(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(half_even(ordered_mean("value", "ts", "event_id"), 1).alias("score"))
    return df.withColumn("period", F.when(F.col("week") < F.lit("2024-01-15").cast("date"), "Spring").otherwise("Summer"))


_WEEKS = "(SELECT *, CASE WHEN week < DATE '2024-01-15' THEN 'Spring' ELSE 'Summer' END AS period, row_number() OVER (PARTITION BY user_id ORDER BY week) AS k FROM (SELECT user_id, date_trunc('week', ts)::DATE AS week, round_even(avg(value), 1) AS score FROM events GROUP BY ALL))"
_NEXT = "least(32.0, greatest(5.0, round_even({p} + CASE WHEN score > 13 THEN 0.2 * (score - 13) * CASE WHEN {p} >= 26 THEN 0.25 WHEN {p} >= 22 THEN 0.5 ELSE 1.0 END ELSE 0.2 * (score - 13) END, 3)))"


_PATH = f"""WITH RECURSIVE w AS {_WEEKS}, p(user_id, week, k, period, price, reset, next_price) AS (
 SELECT user_id, week, k, period, 15.0::DOUBLE, true, {_NEXT.format(p='15.0::DOUBLE')} FROM w WHERE k = 1 UNION ALL
 SELECT user_id, week, k, period, pr, reset, {_NEXT.format(p='pr')} FROM (SELECT w.*, w.period <> p.period AS reset, CASE WHEN w.period <> p.period THEN 15.0::DOUBLE ELSE p.next_price END AS pr FROM p JOIN w ON w.user_id = p.user_id AND w.k = p.k + 1))"""


@plans.query("price_path", f"{_PATH} SELECT user_id, week, period, price, next_price, reset FROM p")
def price_path(spark, sf_dir):
    return folds.price_paths(_weeks(spark, sf_dir), "user_id", "week", "period", "score", folds.Market(digits=3))


@plans.query("official_prices", f"""{_PATH}, o AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, arg_max(value, (ts, event_id)) AS price FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT user_id, week, coalesce(o.price, p.price) AS price, CASE WHEN o.price IS NOT NULL THEN 'official' ELSE 'modeled' END AS source FROM p FULL JOIN o USING (user_id, week)""")
def official_prices(spark, sf_dir):
    captured = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), F.struct("ts", "event_id").alias("captured"), F.col("value").alias("price"))
    official = folds.latest_capture(captured, ["user_id", "week"], "captured")
    return folds.official_prices(price_path(spark, sf_dir), official, ["user_id", "week"]).select("user_id", "week", "price", "source")


def matches(spark, sf_dir):
    pairs = context.two_sided(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", {"value": F.sum("l_extendedprice")})
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("league"))
    return pairs.join(orders, "l_orderkey").withColumn("a_win", (F.col("value_a") > F.col("value_b")).cast("double"))


_MATCHES = """(SELECT l_orderkey, o_orderpriority AS league, o_orderdate AS date, min(l_suppkey) AS a, max(l_suppkey) AS b, (arg_min(v, l_suppkey) > arg_max(v, l_suppkey))::INT::DOUBLE AS win FROM (SELECT l_orderkey, l_suppkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2) GROUP BY ALL)
 JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""


ELO = f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY date, l_orderkey) AS k FROM {_MATCHES}), f(league, k, l_orderkey, ra, rb, state) AS (
 SELECT league, 0::BIGINT, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, MAP {{}}::MAP(BIGINT, DOUBLE) FROM (SELECT DISTINCT league FROM m) UNION ALL
 SELECT league, k, l_orderkey, ra, rb, map_concat(state, MAP {{a: ra + 32 * (win - p), b: rb - 32 * (win - p)}}) FROM (SELECT *, 1 / (1 + pow(10, (rb - ra) / 400)) AS p FROM (SELECT m.*, f.state, coalesce(f.state[m.a], 1500) AS ra, coalesce(f.state[m.b], 1500) AS rb FROM f JOIN m ON m.league = f.league AND m.k = f.k + 1)))"""


@plans.query("elo_ratings", f"""{ELO} SELECT l_orderkey, round_even(ra, 3) AS rating_a, round_even(rb, 3) AS rating_b FROM f WHERE k > 0""")
def elo_ratings(spark, sf_dir):
    df = folds.elo(matches(spark, sf_dir), "league", ["date", "l_orderkey"])
    return df.select("l_orderkey", rounded("rating_a", 3).alias("rating_a"), rounded("rating_b", 3).alias("rating_b"))


@plans.query("elo_all_teams", f"""{ELO.replace('PARTITION BY league ORDER BY', 'ORDER BY').replace('row_number() OVER', "'all' AS pool, row_number() OVER").replace('f(league, k,', 'f(pool, k,').replace('SELECT league, 0::BIGINT', 'SELECT pool, 0::BIGINT').replace('SELECT DISTINCT league FROM m', 'SELECT DISTINCT pool FROM m').replace('SELECT league, k, l_orderkey', 'SELECT pool, k, l_orderkey').replace('m.league = f.league AND m.k', 'm.pool = f.pool AND m.k')} SELECT l_orderkey, round_even(ra, 3) AS rating_a, round_even(rb, 3) AS rating_b FROM f WHERE k > 0""")
def elo_all_teams(spark, sf_dir):
    """One rating a team over the matches of all leagues: each match waits for those before, so they are one ordered stream."""
    df = folds.elo(matches(spark, sf_dir).withColumn("pool", F.lit("all")), "pool", ["date", "l_orderkey"])
    return df.select("l_orderkey", rounded("rating_a", 3).alias("rating_a"), rounded("rating_b", 3).alias("rating_b"))


_BEFORE = "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_COUNTERS = {"m": "event_type", "n": "", "tm": "user_id, event_type", "tn": "user_id", "om": "user_id % 10, event_type", "o": "user_id % 10"}


@plans.query("surprise_counters", f"""
WITH c AS (SELECT event_id, {', '.join(f"count(*) OVER ({'PARTITION BY ' + k if k else ''} {_BEFORE}) AS {n}" for n, k in _COUNTERS.items())} FROM events)
SELECT event_id, round_even(-ln(0.60 * ((m + 0.4) / (n + 2)) + 0.25 * ((tm + 0.4) / (tn + 2)) + 0.15 * ((om + 0.4) / (o + 2))), 6) AS surprise FROM c""")
def surprise_counters(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("target", F.col("user_id") % 10)
    hot = {"m": ["event_type"], "n": [], "om": ["target", "event_type"], "o": ["target"]}
    # buckets of time by the number of rows, an hour at most
    bucket = min(HOUR, bucket_length(df.withColumn("us", micros("ts")), "us"))
    df = folds.counters(df, ["ts", "event_id"], {"tm": ["user_id", "event_type"], "tn": ["user_id"]}, hot, F.floor(micros("ts") / F.lit(bucket)))
    mean = 0.60 * folds.smoothed(F.col("m"), F.col("n"), 0.2) + 0.25 * folds.smoothed(F.col("tm"), F.col("tn"), 0.2) + 0.15 * folds.smoothed(F.col("om"), F.col("o"), 0.2)
    return df.select("event_id", rounded(-F.log(mean), 6).alias("surprise"))
