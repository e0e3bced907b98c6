"""Model and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import models, winmodel
from driftline.operators.folds import elo
from driftline.plans.base import Plans, rounded, stored, table
from driftline.plans.folds import ELO, matches

plans = Plans()
#: Orders' years of the windows: training, confirmation, validation, test.
_WINDOWS = {"development": (1995, 1996), "confirmation": (1997, 1997), "validation": (1998, 1998), "test": (1999, 2001)}

ELO_SQL = f"""{ELO} SELECT league, count(*) AS rows, round_even(avg(((p >= 0.5) = (win = 1))::INT), 6) AS accuracy, round_even(avg(-(win * ln(least(1 - 1e-15, greatest(1e-15, p))) + (1 - win) * ln(1 - least(1 - 1e-15, greatest(1e-15, p))))), 6) AS log_loss, round_even(avg(pow(p - win, 2)), 6) AS brier
FROM (SELECT *, 1 / (1 + pow(10, (rb - ra) / 400)) AS p FROM f JOIN m USING (league, k)) GROUP BY 1"""
_NB = """
WITH k AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT quality, count(*)::DOUBLE AS cw FROM k GROUP BY 1), t AS (SELECT sum(cw) AS total, count(*) AS classes FROM c), l AS (SELECT quality, lang, count(*)::DOUBLE AS w FROM k GROUP BY ALL), s AS (SELECT quality, source, count(*)::DOUBLE AS w FROM k GROUP BY ALL),
g AS (SELECT doc_id, c.quality, ln((cw + 1) / (total + classes)) + ln((coalesce(l.w, 0) + 1) / (cw + (SELECT count(DISTINCT lang) FROM k) + CASE WHEN lang IN (SELECT lang FROM k) THEN 0 ELSE 1 END)) + ln((coalesce(s.w, 0) + 1) / (cw + (SELECT count(DISTINCT source) FROM k) + CASE WHEN source IN (SELECT source FROM k) THEN 0 ELSE 1 END)) AS lg
 FROM documents d CROSS JOIN c CROSS JOIN t LEFT JOIN l USING (quality, lang) LEFT JOIN s USING (quality, source)), p AS (SELECT doc_id, quality, exp(lg) / sum(exp(lg)) OVER (PARTITION BY doc_id) AS probability FROM g)"""


def _bayes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return models.naive_bayes(docs.join(table(spark, sf_dir, "labels"), "doc_id"), docs, ["lang", "source"], "quality", "doc_id")


@plans.query("naive_bayes", f"{_NB} SELECT doc_id, quality, round_even(probability, 6) AS probability FROM p")
def naive_bayes(spark, sf_dir):
    return _bayes(spark, sf_dir).withColumn("probability", rounded("probability", 6))


@plans.query("metrics", f"{_NB} SELECT count(*) AS rows, round_even(avg(((probability >= 0.5)::INT = labels.quality)::INT), 6) AS accuracy, round_even(avg(-(labels.quality * ln(probability) + (1 - labels.quality) * ln(1 - probability))), 6) AS log_loss, round_even(avg(pow(probability - labels.quality, 2)), 6) AS brier FROM p JOIN labels USING (doc_id) WHERE p.quality = 1")
def metrics(spark, sf_dir):
    scored = _bayes(spark, sf_dir).where("quality = 1").drop("quality").join(table(spark, sf_dir, "labels"), "doc_id")
    found = models.metrics(F.col("probability"), F.col("quality"))
    return scored.agg(found["rows"].alias("rows"), *(rounded(found[k], 6).alias(k) for k in ("accuracy", "log_loss", "brier")))


@plans.query("calibration", f"{_NB} SELECT greatest(ceil(probability * 20) - 1, 0)::INT AS bin, least(floor(probability * 10), 9)::INT AS decile, count(*) AS n, round_even(avg(probability), 6) AS predicted, round_even(avg(labels.quality), 6) AS observed FROM p JOIN labels USING (doc_id) WHERE p.quality = 1 GROUP BY ALL")
def calibration(spark, sf_dir):
    scored = _bayes(spark, sf_dir).where("quality = 1").drop("quality").join(table(spark, sf_dir, "labels"), "doc_id")
    p = F.col("probability")
    return scored.groupBy(models.equal_bin(p, 20).alias("bin"), models.decile(p).alias("decile")).agg(F.count("*").alias("n"), rounded(F.avg(p), 6).alias("predicted"), rounded(F.avg("quality"), 6).alias("observed"))


@plans.query("rank_eval", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < '2024-01-20' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, n::DOUBLE / (sum(n) OVER (PARTITION BY user_id))::DOUBLE AS p FROM c),
t AS (SELECT e.event_id, k, p FROM events e LEFT JOIN r USING (user_id, event_type) WHERE ts >= '2024-01-20')
SELECT count(*) AS targets, round_even(avg(coalesce((k <= 1)::INT, 0)), 6) AS top1, round_even(avg(coalesce((k <= 5)::INT, 0)), 6) AS top5, round_even(avg(coalesce(1.0::DOUBLE / k, 0)), 6) AS mrr, round_even(avg(-ln(p)), 6) AS log_loss FROM t""")
def rank_eval(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = events.where("ts < TIMESTAMP_NTZ '2024-01-20'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    window = models.Window.partitionBy("user_id")
    ranked = counts.withColumns({"k": F.row_number().over(window.orderBy(F.col("n").desc(), "event_type")), "p": F.col("n") / F.sum("n").over(window)})
    found = models.rank_metrics(events.where("ts >= TIMESTAMP_NTZ '2024-01-20'").join(ranked, ["user_id", "event_type"], "left"), "k", "p")
    return found.select("targets", *(rounded(c, 6).alias(c) for c in ("top1", "top5", "mrr", "log_loss")))


@plans.query("ols_beta", "SELECT l_returnflag, round_even(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS beta FROM lineitem GROUP BY 1")
def ols_beta(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(rounded(models.ols_slope(F.col("l_quantity"), F.col("l_extendedprice"))).alias("beta"))


@plans.query("pearson_spearman", """
SELECT l_returnflag, round_even(corr(l_quantity, l_extendedprice), 6) AS pearson, round_even(corr(x, y), 6) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem) GROUP BY 1""")
def pearson_spearman(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    df = models.average_ranks(models.average_ranks(df, ["l_returnflag"], "l_quantity", "x"), ["l_returnflag"], "l_extendedprice", "y")
    return df.groupBy("l_returnflag").agg(rounded(models.pearson("l_quantity", "l_extendedprice"), 6).alias("pearson"), rounded(models.pearson("x", "y"), 6).alias("spearman"))


_TRIALS = [(1, 1.0, 0.0, 0.0), (2, 0.5, 0.3, 0.2), (3, 0.2, 0.2, 0.6), (4, 0.0, 1.0, 0.0)]


@plans.query("grid_search", f"""
WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000 AS a, (o_orderkey % 97)::DOUBLE AS b, (o_orderkey % 31)::DOUBLE AS c, o_orderstatus = 'F' AS hit, o_totalprice AS bonus FROM orders), t(trial, wa, wb, wc) AS (VALUES {', '.join(str(t) for t in _TRIALS)}),
x AS (SELECT trial::INT AS trial, o_custkey, arg_max(hit, (s, o_orderkey)) AS hit, arg_max(bonus, (s, o_orderkey)) AS bonus FROM (SELECT *, a * wa::DOUBLE + b * wb::DOUBLE + c * wc::DOUBLE AS s FROM c, t) GROUP BY ALL)
SELECT trial, count(*) AS targets, round_even(avg(hit::INT), 6) AS hit_rate, round_even(avg(bonus), 4) AS mean_bonus FROM x GROUP BY 1""")
def grid_search(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("a"), (F.col("o_orderkey") % 97).cast("double").alias("b"), (F.col("o_orderkey") % 31).cast("double").alias("c"), (F.col("o_orderstatus") == "F").alias("hit"), F.col("o_totalprice").alias("bonus"))
    trials = spark.createDataFrame(_TRIALS, "trial int, w_a double, w_b double, w_c double")
    found = models.grid_search(df, trials, "o_custkey", ["a", "b", "c"], "hit", "bonus", "o_orderkey")
    return found.select("trial", "targets", rounded("hit_rate", 6).alias("hit_rate"), rounded("mean_bonus").alias("mean_bonus"))


@plans.query("elo_metrics", ELO_SQL)
def elo_metrics(spark, sf_dir):
    rated = elo(matches(spark, sf_dir), "league", ["date", "l_orderkey"])
    found = models.metrics(F.col("p_a"), F.col("a_win"))
    return rated.groupBy("league").agg(*((c if k == "rows" else rounded(c, 6)).alias(k) for k, c in found.items()))


@plans.query("logit_fit")
def logit_fit(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("y"), (F.col("o_totalprice") / 250000 - 1).alias("price"), (F.year("o_orderdate") - 1998).cast("double").alias("year"))
    w = models.logistic(df, ["price", "year"], "y")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(("price", "year", "intercept"), w, strict=True)], "feature string, weight double")


@plans.query("conditional_logit")
def conditional_logit(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    window = models.Window.partitionBy("user_id")
    df = own.select("user_id", (F.col("n") / F.sum("n").over(window)).alias("share"), (F.col("m") / 50).alias("mean"), (F.row_number().over(window.orderBy(F.col("m").desc(), "event_type")) == 1).alias("chosen"))
    w = models.conditional_logit(df, "user_id", ["share", "mean"], "chosen", [2.5, 1.8])
    return spark.createDataFrame([(n, float(v)) for n, v in zip(("share", "mean"), w, strict=True)], "feature string, weight double")


_WINDOW_SQL = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in _WINDOWS.items()) + " END"
_WIN = f"""{ELO}, mt AS (SELECT m.*, f.ra, f.rb, year(m.date) AS year FROM m JOIN f ON f.league = m.league AND f.k = m.k), sd AS (SELECT l_orderkey, date, 'a' AS side, a AS team, win AS won FROM mt UNION ALL SELECT l_orderkey, date, 'b', b, 1 - win FROM mt),
rt AS (SELECT l_orderkey, side, (coalesce(sum(won) OVER w, 0) + 2.5) / (count(won) OVER w + 5) AS rate FROM sd WINDOW w AS (PARTITION BY team ORDER BY date, l_orderkey ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ft AS (SELECT mt.l_orderkey, win, year, 1 / (1 + pow(10, (rb - ra) / 400)) AS p_elo, ra - rb AS ed, x.rate AS wa, y.rate AS wb, x.rate - y.rate AS wd FROM mt JOIN rt x ON x.l_orderkey = mt.l_orderkey AND x.side = 'a' JOIN rt y ON y.l_orderkey = mt.l_orderkey AND y.side = 'b'),
sc AS (SELECT stddev_samp(ed) AS es, stddev_samp(wd) AS ws FROM ft WHERE year BETWEEN {_WINDOWS['development'][0]} AND {_WINDOWS['development'][1]}), dv AS (SELECT ed / es AS x1, wd / ws AS x2, win AS y FROM ft, sc WHERE year BETWEEN {_WINDOWS['development'][0]} AND {_WINDOWS['development'][1]}),
wt(i, w0, w1, w2) AS (SELECT 0, 0.0::DOUBLE, 0.5::DOUBLE, 0.2::DOUBLE UNION ALL SELECT i + 1, w0 - 0.1 * avg(p - y), w1 - 0.1 * (avg((p - y) * x1) + 0.01 * w1), w2 - 0.1 * (avg((p - y) * x2) + 0.01 * w2) FROM (SELECT wt.*, x1, x2, y, 1 / (1 + exp(-least(10.0, greatest(-10.0, w0 + w1 * x1 + w2 * x2)))) AS p FROM wt, dv WHERE i < 200) GROUP BY i, w0, w1, w2),
pb AS (SELECT {_WINDOW_SQL} AS win_window, win, unnest([('even', 0.5::DOUBLE), ('win_rate', 1 / (1 + exp(-least(5.0, greatest(-5.0, 2 * wd))))), ('elo', p_elo), ('logistic', 1 / (1 + exp(-least(10.0, greatest(-10.0, w0 + w1 * ed / es + w2 * wd / ws)))))]) AS x FROM ft, sc, (SELECT * FROM wt WHERE i = 200)),
me AS (SELECT win_window, x[1] AS model, count(*) AS rows, avg(((x[2] >= 0.5)::INT = win)::INT) AS accuracy, avg(-(win * ln(least(1 - 1e-15, greatest(1e-15, x[2]))) + (1 - win) * ln(1 - least(1 - 1e-15, greatest(1e-15, x[2]))))) AS log_loss, avg(pow(x[2] - win, 2)) AS brier FROM pb WHERE win_window IS NOT NULL GROUP BY ALL)"""


def _win_report(spark, sf_dir):
    order = ["date", "l_orderkey"]
    # ratings are one fold over all matches, read for both sides' rates, for scales, the fit and the report
    rated = winmodel.pregame(stored(elo(matches(spark, sf_dir), "league", order), "ratings"), "l_orderkey", order)
    rated = stored(rated.withColumn("year", F.year("date")), "matches")
    window = F.coalesce(*(F.when(F.col("year").between(a, b), n) for n, (a, b) in _WINDOWS.items()))
    weights, by = winmodel.fit(rated.where(F.col("year").between(*_WINDOWS["development"])))
    return winmodel.evaluate(winmodel.probabilities(rated, weights, by), window), weights


@plans.query("win_models", f"{_WIN} SELECT win_window AS \"window\", model, rows, round_even(accuracy, 6) AS accuracy, round_even(log_loss, 6) AS log_loss, round_even(brier, 6) AS brier FROM me")
def win_models(spark, sf_dir):
    """Even chances, win rates, ratings and the fitted model in each window of years."""
    return _win_report(spark, sf_dir)[0].select("window", "model", "rows", *(rounded(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier")))


@plans.query("win_gate", f"""{_WIN}, r AS (SELECT win_window AS w, model, round_even(log_loss, 4) AS l, round_even(brier, 4) AS b FROM me), v AS (SELECT x.w, x.l < y.l AND x.b < y.b AS better FROM r x JOIN r y ON x.w = y.w AND x.model = 'logistic' AND y.model = 'elo'),
g AS (SELECT bool_or(w = 'confirmation' AND better) AS confirmed, bool_or(w = 'validation' AND better) AS validated FROM v)
SELECT confirmed, validated, confirmed AND validated AS accepted, CASE WHEN confirmed AND validated THEN 'logistic' ELSE 'elo' END AS source, round_even(w1, 6) AS w_elo, round_even(w2, 6) AS w_rate, round_even(w0, 6) AS intercept FROM g, (SELECT * FROM wt WHERE i = 200)""")
def win_gate(spark, sf_dir):
    """Whether the fitted model is to be used in place of the ratings."""
    report, weights = _win_report(spark, sf_dir)
    names = ("intercept", "w_elo", "w_rate")
    return winmodel.gate(report, "confirmation", "validation").withColumns({n: rounded(F.lit(w), 6) for n, w in zip(names, weights, strict=True)})
