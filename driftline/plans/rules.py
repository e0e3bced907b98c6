"""Scoring, cleaning and rule queries over orders, lineitem and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import scoring
from driftline.operators.scoring import Term
from driftline.plans.base import Plans, rounded, table

plans = Plans()


@plans.query("rule_scoring", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round_even(sum(pts), 2) AS points, round_even(max(pts), 3) AS best FROM (
 SELECT l_returnflag, l_linestatus, 0.5 * l_quantity - l_linenumber + CASE WHEN l_discount >= 0.05 THEN 2.0 ELSE 0 END + CASE WHEN l_quantity >= 40 THEN 3.0 ELSE 0 END
 + greatest(0, l_extendedprice - 50000) / 1000 + CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_tax >= 0.04 THEN 2.0 ELSE 0 END WHEN l_returnflag = 'N' THEN 1.5 * (CASE WHEN (SELECT sum(l_tax) FROM lineitem) <> 0 THEN l_tax ELSE l_discount END) ELSE CASE WHEN l_quantity < 10 THEN 1.0 ELSE 0 END END AS pts FROM lineitem)
GROUP BY ALL""")
def rule_scoring(spark, sf_dir):
    df = scoring.choose_source(table(spark, sf_dir, "lineitem"), {"rate": ("l_tax", "l_discount")})
    base = scoring.score([Term(0.5, "l_quantity"), Term(-1, "l_linenumber"), Term(2, when="l_discount >= 0.05"), Term(3, when="l_quantity >= 40"), Term(1, "greatest(0, l_extendedprice - 50000) / 1000")])
    role = F.when(F.col("l_returnflag") == "A", scoring.score([Term(2, when="l_tax >= 0.04")])).when(F.col("l_returnflag") == "N", scoring.score([Term(1.5, "rate")])).otherwise(scoring.score([Term(1, when="l_quantity < 10")]))
    df = df.withColumn("pts", base + role)
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), rounded(F.sum("pts"), 2).alias("points"), rounded(F.max("pts"), 3).alias("best"))


@plans.query("split_inference", """
SELECT year(o_orderdate) AS year, coalesce(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END, CASE WHEN month(o_orderdate) <= 6 THEN 'Spring' ELSE 'Summer' END) AS split, count(*) AS n FROM orders GROUP BY ALL""")
def split_inference(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("split", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")))
    return df.groupBy(F.year("o_orderdate").alias("year"), scoring.infer_split("o_orderdate", "split").alias("split")).agg(F.count("*").alias("n"))


@plans.query("phase_label", """
SELECT phase, regexp_replace(phase, ' Playoffs$', '') AS period, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN concat(s, ' Playoffs') ELSE s END AS phase FROM (SELECT o_orderstatus, CASE WHEN month(o_orderdate) <= 6 THEN 'Spring' ELSE 'Summer' END AS s FROM orders)) GROUP BY ALL""")
def phase_label(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("none", F.lit(None).cast("string"))
    named = df.select(scoring.phase(scoring.infer_split("o_orderdate", "none"), F.col("o_orderstatus") == "P").alias("phase"))
    return named.groupBy("phase", F.regexp_replace("phase", " Playoffs$", "").alias("period")).agg(F.count("*").alias("n"))


@plans.query("primary_groups", """
SELECT l_suppkey AS supplier, count(*) AS n, round_even(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 600) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (0, 1, 2)) GROUP BY 1""")
def primary_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    many = lines.groupBy("l_suppkey").count().where("count >= 600").select("l_suppkey")
    named = table(spark, sf_dir, "supplier").where(F.col("s_nationkey").isin(0, 1, 2)).select(F.col("s_suppkey").alias("l_suppkey"))
    kept = lines.join(many.unionByName(named).distinct(), "l_suppkey", "left_semi")
    return kept.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


@plans.query("alias_dim", """
SELECT CASE lower(trim(n_name)) WHEN 'nation_1' THEN 'First' WHEN 'nation_2' THEN 'Second' WHEN 'nation_3' THEN 'First' ELSE n_name END AS team, count(*) AS customers, round_even(avg(c_acctbal), 4) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def alias_dim(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("team", scoring.alias("n_name", {"NATION_1": "First", "nation_2": "Second", "Nation_3": "First"}))
    df = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("team").agg(F.count("*").alias("customers"), rounded(F.avg("c_acctbal")).alias("balance"))


@plans.query("learning_adjust", """
WITH f AS (SELECT * FROM (VALUES ('BUILDING', 1.1), ('MACHINERY', 0.8), ('BUILDING', 0.95)) t(segment, factor))
SELECT c_custkey, round_even(c_acctbal * coalesce((SELECT avg(factor) FROM f WHERE segment = c_mktsegment), 1.0)::DOUBLE, 2) AS adjusted FROM customer""")
def learning_adjust(spark, sf_dir):
    factors = spark.createDataFrame([("BUILDING", 1.1), ("MACHINERY", 0.8), ("BUILDING", 0.95)], "c_mktsegment string, factor double").groupBy("c_mktsegment").agg(F.avg("factor").alias("factor"))
    return table(spark, sf_dir, "customer").join(factors, "c_mktsegment", "left").select("c_custkey", scoring.adjusted("c_acctbal", "factor").alias("adjusted"))


RULES = [
    {"id": "early", "start": "1995-01-01", "end": "1997-12-31"},
    {"id": "open-late", "start": "1997-06-01", "groups": ["O"]},
    {"id": "late", "start": "1999-01-01", "end": "2000-12-31", "groups": ["F", "P"]},
]


@plans.query("effective_rule", """
SELECT rule, o_orderstatus, count(*) AS n, round_even(sum(o_totalprice), 2) AS total FROM (SELECT o_orderstatus, o_totalprice, CASE WHEN o_orderdate::DATE BETWEEN '1999-01-01' AND '2000-12-31' AND o_orderstatus IN ('F', 'P') THEN 'late'
 WHEN o_orderdate::DATE >= '1997-06-01' AND o_orderstatus = 'O' THEN 'open-late' WHEN o_orderdate::DATE BETWEEN '1995-01-01' AND '1997-12-31' THEN 'early' ELSE 'default' END AS rule FROM orders) GROUP BY ALL""")
def effective_rule(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    df = df.withColumn("rule", scoring.effective_rule(df, RULES, F.to_date("o_orderdate"), F.col("o_orderstatus"), "default"))
    return df.groupBy("rule", "o_orderstatus").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@plans.query("coerced_numbers", """
SELECT event_type, round_even(sum(coalesce(try_cast(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE), 0)), 4) AS total, sum(CASE WHEN try_cast(event_type AS DOUBLE) IS NULL THEN 0 ELSE 1 END)::BIGINT AS parsed, 0.0::DOUBLE AS absent FROM events GROUP BY 1""")
def coerced_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k"), "kind": F.col("event_type")})
    df = scoring.numbers(df.withColumn("parsed", F.expr("try_cast(kind AS DOUBLE)").isNotNull().cast("long")), ["k", "missing"])
    return df.groupBy("event_type").agg(rounded(F.sum("k")).alias("total"), F.sum("parsed").alias("parsed"), F.sum("missing").alias("absent"))
