"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import context
from driftline.plans.base import Plans, rounded, table

plans = Plans()


def _sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))


_CONTEXT = """
SELECT l.l_orderkey, l.l_linestatus, count(*) AS n, max(c.quantity) AS {0}quantity, max(c.lines) AS {0}lines FROM lineitem l
LEFT JOIN (SELECT l_orderkey, {1} AS l_linestatus, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY l_orderkey, l_linestatus) c ON l.l_orderkey = c.l_orderkey AND l.l_linestatus = c.l_linestatus GROUP BY ALL"""


def _context(spark, sf_dir, prefix, flip):
    # lines of one group get the same context, so they are counted before they meet it
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n"))
    return context.attach_context(lines, _sums(spark, sf_dir), ["l_orderkey", "l_linestatus"], ["quantity", "lines"], prefix, flip)


@plans.query("own_context", _CONTEXT.format("team_", "l_linestatus"))
def own_context(spark, sf_dir):
    return _context(spark, sf_dir, "team_", None)


@plans.query("flipped_context", _CONTEXT.format("opponent_", "CASE l_linestatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'O' END"))
def flipped_context(spark, sf_dir):
    return _context(spark, sf_dir, "opponent_", ("l_linestatus", {"O": "F", "F": "O"}))


_TWO = "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2)"


@plans.query("two_sided_pairs", f"""
SELECT l_orderkey, min(l_suppkey) AS side_a, max(l_suppkey) AS side_b, round_even(arg_min(v, l_suppkey), 2) AS value_a, round_even(arg_max(v, l_suppkey), 2) AS value_b
FROM (SELECT l_orderkey, l_suppkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_orderkey IN {_TWO} GROUP BY ALL) GROUP BY 1""")
def two_sided_pairs(spark, sf_dir):
    df = context.two_sided(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", {"value": F.sum("l_extendedprice")})
    return df.select("l_orderkey", "side_a", "side_b", rounded("value_a", 2).alias("value_a"), rounded("value_b", 2).alias("value_b"))


@plans.query("opponent", f"""
SELECT l_suppkey, opponent, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_orderkey IN {_TWO} THEN (CASE WHEN l_suppkey = lo THEN hi ELSE lo END)::VARCHAR ELSE '' END AS opponent
FROM lineitem JOIN (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY 1) USING (l_orderkey)) GROUP BY ALL""")
def opponent(spark, sf_dir):
    df = context.opponents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")
    return df.groupBy("l_suppkey", "opponent").agg(F.count("*").alias("n"))


@plans.query("banned_rate_theta", """
WITH picks AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'), bans AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey % 20 AS item FROM lineitem WHERE l_returnflag = 'R')
SELECT p.l_suppkey, b.item, count(*) AS banned, round_even(count(*)::DOUBLE / any_value(g.n), 6) AS rate FROM picks p JOIN bans b ON p.l_orderkey = b.l_orderkey AND p.l_suppkey <> b.l_suppkey
JOIN (SELECT l_suppkey, count(*) AS n FROM picks GROUP BY 1) g ON g.l_suppkey = p.l_suppkey GROUP BY ALL""")
def banned_rate_theta(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    picks = lines.where("l_returnflag = 'N'").select("l_orderkey", "l_suppkey").distinct()
    bans = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey", (F.col("l_partkey") % 20).alias("item")).distinct()
    hits = context.across_sides(picks, bans, "l_orderkey", "l_suppkey").groupBy("l_suppkey", F.col("item_other").alias("item")).agg(F.count("*").alias("banned"))
    games = picks.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return hits.join(games, "l_suppkey").select("l_suppkey", "item", "banned", rounded(F.col("banned") / F.col("n"), 6).alias("rate"))


@plans.query("nullsafe_denominator", """
WITH g AS (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
SELECT g.segment, g.c_nationkey, g.n, round_even(g.n::DOUBLE / t.total::DOUBLE, 6) AS share FROM g JOIN (SELECT segment, sum(n) AS total FROM g GROUP BY 1) t ON g.segment IS NOT DISTINCT FROM t.segment""")
def nullsafe_denominator(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    df = df.groupBy("segment", "c_nationkey").agg(F.count("*").alias("n"))
    return df.withColumn("share", rounded(context.share_of_group(df, F.col("n"), ["segment"]), 6))


@plans.query("proj_error", """
SELECT c_custkey, round_even(c_acctbal * 20 - total, 2) AS error, round_even(abs(c_acctbal * 20 - total), 2) AS absolute, round_even((c_acctbal * 20 - total) / total, 6) AS percent
FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def proj_error(spark, sf_dir):
    predicted = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 20).alias("predicted"))
    actual = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("actual"))
    df = context.errors(predicted, actual, ["c_custkey"])
    return df.select("c_custkey", rounded("error", 2).alias("error"), rounded("absolute", 2).alias("absolute"), rounded("percent", 6).alias("percent"))


@plans.query("missing_profiles", """
SELECT c_custkey, c_mktsegment, 'none' AS origin FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT o_custkey, max(o_orderpriority), 'orders' FROM orders WHERE o_totalprice > 400000 GROUP BY 1""")
def missing_profiles(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment")).withColumn("origin", F.lit("orders"))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("none").alias("origin"))
    return context.upsert(base, have, ["c_custkey"])


@plans.query("dedupe_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def dedupe_first(spark, sf_dir):
    df = context.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
