"""Version-decay and co-occurrence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import versions as ver
from driftline.plans.base import Plans, rounded, table

plans = Plans()

_DIST = """CASE WHEN {t}m = {h}m AND {t}n = {h}n THEN 0 WHEN {h}m > {t}m OR ({h}m = {t}m AND {h}n > {t}n) THEN abs({t}m - {h}m) * 5 + abs({t}n - {h}n)
 WHEN {t}m = {h}m THEN {t}n - {h}n + 2 * (({h}n < 8 AND {t}n >= 8)::INT + ({h}n < 18 AND {t}n >= 18)::INT) ELSE greatest(0, 24 - {h}n) + 24 * greatest(0, {t}m - {h}m - 1) + {t}n + 5 * ({t}m - {h}m) END"""
_DISTANCE = _DIST.format(t="t", h="h")


def _versions(spark, sf_dir):
    version = F.concat((F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 4 + 13).cast("string"), F.lit("."), (F.col("p_size") % 24 + 1).cast("string"))
    return table(spark, sf_dir, "part").withColumn("version", version)


_PARTS = "(SELECT *, regexp_extract(p_brand, '([0-9]+)', 1)::INT % 4 + 13 AS hm, p_size % 24 + 1 AS hn, (regexp_extract(p_brand, '([0-9]+)', 1)::INT % 4 + 13)::VARCHAR || '.' || (p_size % 24 + 1)::VARCHAR AS version FROM part)"


@plans.query("version_distance", f"""
SELECT DISTINCT target, version, ({_DISTANCE})::DOUBLE AS distance FROM (SELECT *, split_part(target, '.', 1)::INT AS tm, split_part(target, '.', 2)::INT AS tn FROM {_PARTS}, (VALUES ('15.1'), ('16.10'), ('16.14'), ('14.24')) v(target))""")
def version_distance(spark, sf_dir):
    seen = _versions(spark, sf_dir).select("version").distinct()
    targets = spark.createDataFrame([("15.1",), ("16.10",), ("16.14",), ("14.24",)], "target string")
    return seen.join(F.broadcast(targets)).select("target", "version", ver.distance(F.col("target"), F.col("version")).alias("distance"))


@plans.query("version_decay_shares", f"""
WITH w AS (SELECT p_type, target, p_brand, sum(exp(-0.30 * ({_DISTANCE}))) AS w FROM (SELECT *, split_part(target, '.', 1)::INT AS tm, split_part(target, '.', 2)::INT AS tn FROM {_PARTS}, (VALUES ('15.1'), ('16.10')) v(target)) GROUP BY ALL)
SELECT p_type, target, p_brand, round_even(w / sum(w) OVER (PARTITION BY p_type, target), 8) AS share FROM w""")
def version_decay_shares(spark, sf_dir):
    counts = _versions(spark, sf_dir).groupBy("p_type", "version", "p_brand").agg(F.count("*").alias("n"))
    targets = spark.createDataFrame([("15.1",), ("16.10",)], "version string")
    return ver.weighted_shares(counts, targets, ["p_type"], "p_brand", 0.30).withColumn("share", rounded("share", 8))


@plans.query("comfort", """
WITH e AS (SELECT user_id, event_type, event_id, ts::DATE AS day FROM events), g AS (SELECT user_id, count(DISTINCT event_id) AS games FROM e GROUP BY 1)
SELECT user_id, event_type, round_even(n::DOUBLE / games * n / (n + 2) * (0.5 + 0.5 * least(1.0, stages / 2.0)), 8) AS comfort FROM (SELECT user_id, event_type, count(DISTINCT event_id) AS n, count(DISTINCT day) AS stages FROM e GROUP BY ALL) JOIN g USING (user_id)""")
def comfort(spark, sf_dir):
    df = ver.comfort(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id"], "event_type", "event_id", "day")
    return df.withColumn("comfort", rounded("comfort", 8))


_BRANDS = "(SELECT DISTINCT year(o_orderdate) AS year, l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
_BOOSTS = f"""(SELECT year, a, b, n, least(0.25, n::DOUBLE / least(x.g, y.g) * n / (n + 8)) AS boost FROM (SELECT p.year, p.p_brand AS a, q.p_brand AS b, count(*) AS n FROM {_BRANDS} p JOIN {_BRANDS} q ON p.year = q.year AND p.l_orderkey = q.l_orderkey AND p.p_brand < q.p_brand GROUP BY ALL HAVING count(*) >= 3)
 JOIN (SELECT year, p_brand AS a, count(*) AS g FROM {_BRANDS} GROUP BY ALL) x USING (year, a) JOIN (SELECT year, p_brand AS b, count(*) AS g FROM {_BRANDS} GROUP BY ALL) y USING (year, b))"""


def _brands(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))


@plans.query("pair_synergy", f"SELECT year, a, b, n, round_even(boost, 8) AS boost FROM {_BOOSTS}")
def pair_synergy(spark, sf_dir):
    return ver.pair_boosts(_brands(spark, sf_dir), ["year"], "l_orderkey", "p_brand").withColumn("boost", rounded("boost", 8))


@plans.query("boost_lookup", f"""
WITH x AS (SELECT a, b, 13 + (year - 1995) // 3 AS hm, 1 + (year - 1995) % 3 AS hn, boost FROM {_BOOSTS}), o AS (SELECT DISTINCT 13 + (year - 1995) // 3 AS major, l_orderkey, p_brand FROM {_BRANDS}), g AS (SELECT major, p_brand, count(*) AS g FROM o GROUP BY ALL),
s AS (SELECT n.major, n.a, n.b, least(0.05, 0.20 * least(0.25, n::DOUBLE / least(p.g, q.g) * n / (n + 8))) AS boost FROM (SELECT p.major, p.p_brand AS a, q.p_brand AS b, count(*) AS n FROM o p JOIN o q ON p.major = q.major AND p.l_orderkey = q.l_orderkey AND p.p_brand < q.p_brand GROUP BY ALL HAVING count(*) >= 3) n JOIN g p ON p.major = n.major AND p.p_brand = n.a JOIN g q ON q.major = n.major AND q.p_brand = n.b),
w AS (SELECT DISTINCT a, b, tm, tn FROM s, (VALUES (14, 2), (15, 1), (17, 1)) t(tm, tn)),
near AS (SELECT a, b, tm, tn, least(0.25, sum(boost * exp(-0.15 * ({_DISTANCE}))) / count(*)) AS now FROM w JOIN x USING (a, b) WHERE tm = hm AND hn <= tn AND tn - hn <= 4 GROUP BY ALL),
old AS (SELECT a, b, tm, tn, arg_max(boost, major) * pow(0.5, greatest(0, tm - max(major) - 1)) AS old FROM w JOIN s USING (a, b) WHERE major < tm GROUP BY a, b, tm, tn)
SELECT a, b, tm::VARCHAR || '.' || tn::VARCHAR AS target, round_even(coalesce(now, old, 0), 8) AS boost FROM w LEFT JOIN near USING (a, b, tm, tn) LEFT JOIN old USING (a, b, tm, tn)""")
def boost_lookup(spark, sf_dir):
    age = F.col("year") - 1995
    brands = _brands(spark, sf_dir).withColumns({"major": (13 + F.floor(age / 3)).cast("int"), "minor": (1 + age % 3).cast("int")})
    boosts = ver.pair_boosts(brands, ["major", "minor"], "l_orderkey", "p_brand").select("a", "b", F.concat_ws(".", "major", "minor").alias("version"), "boost")
    seasons = ver.season_boosts(brands, "major", "l_orderkey", "p_brand")
    wanted = seasons.select("a", "b").distinct().withColumn("target", F.explode(F.array(*map(F.lit, ("14.2", "15.1", "17.1")))))
    return ver.boost_lookup(wanted, boosts, seasons).withColumn("boost", rounded("boost", 8))


@plans.query("duo_pairs", f"""
SELECT x.p_brand AS first, y.p_brand AS second, count(*) AS n FROM (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A') x JOIN (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') y USING (l_orderkey) GROUP BY ALL""")
def duo_pairs(spark, sf_dir):
    return ver.duos(_brands(spark, sf_dir), ["l_orderkey"], "l_returnflag", "A", "R", "p_brand")


@plans.query("maturity_weights", """
SELECT user_id, n, CASE WHEN n < 60 THEN 0.35::DOUBLE WHEN n <= 70 THEN 0.45 ELSE 0.55 END AS player, round_even(0.2 + 0.4 * least(1.0, n / 80.0), 6) AS blended FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def maturity_weights(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    scaled = F.when(F.col("n") < 60, 0).when(F.col("n") <= 70, 10).otherwise(20)
    return df.select("user_id", "n", ver.dynamic_weights(scaled)["player"].alias("player"), rounded(ver.maturity_weights(F.col("n"), (0.2, 0.3, 0.5), (0.6, 0.3, 0.1), 80)[0], 6).alias("blended"))
