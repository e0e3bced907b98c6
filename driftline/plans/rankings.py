"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import ranking as rk
from driftline.plans.base import Plans, rounded, table

plans = Plans()


@plans.query("topk_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    return rk.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@plans.query("tier_union", """
SELECT o_custkey, o_orderkey, overall, in_group FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS overall, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INT AS in_group FROM orders) WHERE overall <= 2 OR in_group <= 1""")
def tier_union(spark, sf_dir):
    return rk.tops_and_leaders(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", [F.col("o_totalprice").desc(), "o_orderkey"], 2, 1).select("o_custkey", "o_orderkey", "overall", "in_group")


@plans.query("argmax", "SELECT user_id, arg_max(event_type, (value, event_id)) AS best, max(value) AS value FROM events GROUP BY 1")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("best"), F.max("value").alias("value"))


@plans.query("starter", """
WITH c AS (SELECT c_nationkey, c_mktsegment, c_custkey, max(o_orderdate) AS latest, count(o_orderkey) AS games FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, c_custkey, games FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY latest DESC NULLS LAST, games DESC NULLS LAST, c_custkey) AS r FROM c) WHERE r = 1""")
def starter(spark, sf_dir):
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    df = df.groupBy("c_nationkey", "c_mktsegment", "c_custkey").agg(F.max("o_orderdate").alias("latest"), F.count("o_orderkey").alias("games"))
    return rk.starters(df, ["c_nationkey", "c_mktsegment"], "latest", "games", "c_custkey").select("c_nationkey", "c_mktsegment", "c_custkey", "games")


@plans.query("portfolio", """
WITH p AS (SELECT s_nationkey AS entity, s_suppkey AS item, s_acctbal AS a, s_suppkey % 7 AS b, -s_suppkey AS c FROM supplier), one AS (SELECT *, 1 AS slot FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY a DESC, item) = 1),
two AS (SELECT *, 2 AS slot FROM p WHERE item NOT IN (SELECT item FROM one) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY b DESC, item) = 1), three AS (SELECT *, 3 AS slot FROM p WHERE item NOT IN (SELECT item FROM one UNION ALL SELECT item FROM two) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c DESC, item) = 1)
SELECT entity, item, slot FROM one UNION ALL SELECT entity, item, slot FROM two UNION ALL SELECT entity, item, slot FROM three""")
def portfolio(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity"), F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("a"), (F.col("s_suppkey") % 7).alias("b"), (-F.col("s_suppkey")).alias("c"))
    return rk.portfolio(df, "entity", "item", *([F.col(x).desc(), "item"] for x in "abc")).select("entity", "item", "slot")


_OPTIONS = """c AS (SELECT user_id, 'c' || (event_id % 40) AS item, count(*) AS n, avg(value) AS m, avg((value < 10)::INT) AS ban_rate, event_id % 40 AS k FROM events GROUP BY user_id, event_id % 40), g AS (SELECT item, sum(n) AS gn FROM c GROUP BY 1),
o AS (SELECT user_id, item, CASE WHEN user_id % 4 = 0 THEN 'opening_round_baseline' WHEN k % 3 = 0 THEN 'already_played_by_player' WHEN k % 3 = 1 THEN 'unplayed_by_player' ELSE 'unplayed_in_role' END AS cat, round_even(m, 6) AS b, round_even(n::DOUBLE / sum(n) OVER (PARTITION BY user_id), 9) AS p, round_even(n * m, 6) AS own, round_even(gn::DOUBLE / (SELECT sum(n) FROM c), 9) AS lead, ban_rate FROM c JOIN g USING (item))"""


@plans.query("tiered_portfolio", f"""WITH {_OPTIONS}, q1 AS (SELECT * FROM o WHERE cat = 'opening_round_baseline' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b DESC, p DESC, item) = 1), r2 AS (SELECT o.* FROM o ANTI JOIN q1 USING (user_id, item) WHERE cat = 'opening_round_baseline'), q2 AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY own DESC, p DESC, item) = 1),
q3 AS (SELECT r2.* FROM r2 ANTI JOIN q2 USING (user_id, item) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lead DESC, p DESC, item) = 1), qr AS (SELECT *, row_number() OVER (PARTITION BY user_id, cat ORDER BY b DESC, p DESC, item)::INT AS r FROM o WHERE cat <> 'opening_round_baseline'),
pk AS (SELECT *, 1 AS r, 'Overall' AS basis FROM q1 UNION ALL SELECT *, 2, 'Player comfort' FROM q2 UNION ALL SELECT *, 3, 'International meta' FROM q3 UNION ALL SELECT *, 'Rank ' || r FROM qr WHERE r <= 3),
co AS (SELECT user_id, item AS comfort FROM pk WHERE r = 1 AND cat = 'already_played_by_player' AND ban_rate > 0.25), up AS (SELECT user_id, cat AS up_cat FROM pk WHERE r = 1 AND cat IN ('unplayed_by_player', 'unplayed_in_role') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b DESC, p DESC, item) = 1), tu AS (SELECT * FROM co JOIN up USING (user_id))
SELECT user_id, item, r AS portfolio_rank, basis AS portfolio_basis, CASE cat {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rk.TIERS.items())} END AS portfolio_tier, coalesce(r = 1 AND cat = up_cat, false) AS risk_pivot_recommended, coalesce(comfort, '') AS risk_pivot_from, coalesce(CASE up_cat {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rk.TIERS.items())} END, '') AS recommended_tier FROM pk LEFT JOIN tu USING (user_id)""")
def tiered_portfolio(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 40)
    own = rows.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.avg((F.col("value") < 10).cast("int")).alias("ban_rate"))
    world = rows.groupBy("k").agg(F.count("*").alias("gn"))
    total = rows.agg(F.count("*").alias("all_n"))
    category = F.when(F.col("user_id") % 4 == 0, "opening_round_baseline").when(F.col("k") % 3 == 0, "already_played_by_player").when(F.col("k") % 3 == 1, "unplayed_by_player").otherwise("unplayed_in_role")
    df = own.join(world, "k").join(total)
    df = df.select("user_id", F.concat(F.lit("c"), "k").alias("item"), category.alias("novelty_category"), rounded("m", 6).alias("expected_bonus"), rounded(F.col("n") / F.sum("n").over(rk.Window.partitionBy("user_id")), 9).alias("pick_probability"), rounded(F.col("n") * F.col("m"), 6).alias("player_share"), rounded(F.col("gn") / F.col("all_n"), 9).alias("leading_share"), "ban_rate")
    found = rk.tiered_portfolio(df, ["user_id"], "item")
    return found.select("user_id", "item", "portfolio_rank", "portfolio_basis", "portfolio_tier", "risk_pivot_recommended", "risk_pivot_from", "recommended_tier")


@plans.query("novelty_multiplier", """
WITH h AS (SELECT DISTINCT user_id % 5 AS role, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'), c AS (SELECT user_id, user_id % 5 AS role, t AS event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type AS t FROM events))
SELECT user_id, event_type, CASE WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.role = c.role AND h.event_type = c.event_type) THEN 1.7::DOUBLE WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = c.user_id AND h.event_type = c.event_type) THEN 1.5 ELSE 1.3 END AS multiplier FROM c""")
def novelty_multiplier(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("role", F.col("user_id") % 5)
    wanted = events.select("user_id", "role").distinct().crossJoin(events.select("event_type").distinct())
    return rk.novelty(wanted, events.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")), "role", "user_id", "event_type").select("user_id", "event_type", "multiplier")


@plans.query("legal_candidates", """
SELECT user_id, day, t AS candidate FROM (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type) AS used FROM events GROUP BY ALL), (SELECT DISTINCT event_type AS t FROM events) WHERE NOT list_contains(used, t)""")
def legal_candidates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    universe = events.select("event_type").distinct()
    used = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("used"))
    return rk.legal_candidates(used, universe, "used").select("user_id", "day", "candidate")


@plans.query("candidate_ranker", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS champ_mean FROM events GROUP BY ALL), x AS (SELECT user_id, event_type, n::DOUBLE / (sum(n) OVER (PARTITION BY user_id))::DOUBLE AS ps, (sum(n) OVER (PARTITION BY user_id % 5, event_type))::DOUBLE / (sum(n) OVER (PARTITION BY user_id % 5))::DOUBLE AS ds, (sum(n) OVER (PARTITION BY event_type))::DOUBLE / (sum(n) OVER ())::DOUBLE AS ls, champ_mean, n, r.m AS role_mean FROM c, (SELECT avg(value) AS m FROM events) r),
b AS (SELECT *, (0.55 * ps + 0.30 * ds + 0.15 * ls) * (0.85 + 0.15 * ps) AS base, greatest(0.05, least(1.0, 1 - (0.70 * ds + 0.30 * ps))) AS av, n / (n + 5.0) * champ_mean + (1 - n / (n + 5.0)) * role_mean AS pts FROM x)
SELECT user_id, event_type, round_even(base / sum(base) OVER (PARTITION BY user_id), 6) AS base_pick_probability, round_even(base * av / sum(base * av) OVER (PARTITION BY user_id), 6) AS pick_share, round_even(base / sum(base) OVER (PARTITION BY user_id) * av * pts * 0.5, 6) AS bonus FROM b""")
def candidate_ranker(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("role", F.col("user_id") % 5)
    own = events.groupBy("user_id", "role", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("champ_mean"))
    role = events.groupBy("role", "event_type").agg(F.count("*").alias("rn"))
    role = role.join(events.groupBy("role").agg(F.count("*").alias("rt")), "role")
    world = events.groupBy("event_type").agg(F.count("*").alias("wn"))
    total = events.agg(F.count("*").alias("wt"), F.avg("value").alias("role_mean"))
    df = own.join(role, ["role", "event_type"]).join(world, "event_type").join(F.broadcast(total))
    ps = F.col("n") / F.sum("n").over(rk.Window.partitionBy("user_id"))
    df = df.withColumns({"player_share": ps, "domestic_share": F.col("rn") / F.col("rt"), "leading_share": F.col("wn") / F.col("wt"), "tier": F.lit(1.0), "comfort": F.lit(0.0), "champ_weight": F.col("n"), "multiplier": F.lit(1.5)})
    df = df.withColumns({"priority": F.col("player_share"), "ban": F.col("domestic_share"), "denial": F.col("player_share")})
    out = rk.candidate_scores(df, ["user_id"])
    return out.select("user_id", "event_type", *(rounded(c, 6).alias(c) for c in ("base_pick_probability", "pick_share", "bonus")))


_CAND = "(SELECT o_custkey % 50 AS team, o_custkey AS player, o_orderpriority AS item, count(*)::DOUBLE / (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey) AS p FROM orders a GROUP BY o_custkey, o_orderpriority)"
_PAIR = "(SELECT a, b, 0.01 * (row_number() OVER (ORDER BY a, b)) AS boost FROM (SELECT DISTINCT x.o_orderpriority AS a, y.o_orderpriority AS b FROM orders x, (SELECT DISTINCT o_orderpriority FROM orders) y WHERE x.o_orderpriority < y.o_orderpriority))"


def _round(source: str) -> str:
    return f"""(SELECT team, player, item, p0, p0 * (1 + s) / sum(p0 * (1 + s)) OVER (PARTITION BY team, player) AS p, s FROM (SELECT c.team, c.player, c.item, any_value(c.p0) AS p0, least(0.35, coalesce(sum(bo.boost * m.p), 0)) AS s FROM {source} c
 LEFT JOIN both_ways bo ON bo.a = c.item LEFT JOIN {source} m ON m.team = c.team AND m.player <> c.player AND m.item = bo.b GROUP BY c.team, c.player, c.item))"""


@plans.query("teammate_expectation", f"""
WITH c0 AS (SELECT *, p AS p0 FROM {_CAND}), pairs AS {_PAIR}, both_ways AS (SELECT a, b, boost FROM pairs UNION ALL SELECT b, a, boost FROM pairs), c1 AS {_round('c0')}, c2 AS {_round('c1')}
SELECT player, item, round_even(p, 6) AS p, round_even(s, 6) AS synergy FROM c2""")
def teammate_expectation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(rk.Window.partitionBy("o_custkey"))
    df = counts.select((F.col("o_custkey") % 50).alias("team"), F.col("o_custkey").alias("player"), F.col("o_orderpriority").alias("item"), share.alias("chance"))
    items = orders.select(F.col("o_orderpriority").alias("a")).distinct()
    pairs = items.join(items.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    # the pairs of priorities are few; one window numbers them
    pairs = pairs.withColumn("boost", 0.01 * F.row_number().over(rk.Window.orderBy("a", "b")))
    return rk.teammate_synergy(df, pairs, ["team"], "player", "item", "chance").select("player", "item", rounded("p", 6).alias("p"), rounded("synergy", 6).alias("synergy"))


@plans.query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey || ':7'), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return rk.sample_rows(table(spark, sf_dir, "orders"), "o_orderkey", 100, 7).select("o_orderkey")
