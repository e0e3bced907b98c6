"""What adding a chance of winning to a projection changes, window by window, and whether it is to be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import models

#: Rows of a whole slate, and how much the root mean square error may grow while the absolute one falls.
SLATE, RMSE_SLACK = 5, 0.01
METRICS = ("mae", "rmse", "pearson", "spearman")


def coefficient(training: DataFrame, actual: str, projected: str, chance: str) -> float:
    """Points for a whole chance of winning above one half: the slope without intercept of what the projection misses."""
    row = training.agg(models.ols_slope(F.col(chance) - 0.5, F.col(actual) - F.col(projected)).alias("b")).first()
    return float(row["b"] or 0.0)


def adjusted(rows: DataFrame, projected: str, chance: str, beta: float, digits: int = 2) -> DataFrame:
    """Adds off and on: the rounded projection without and with the chance; an unknown chance is one half."""
    return rows.withColumns({"off": F.bround(projected, digits), "on": F.bround(F.col(projected) + beta * (F.coalesce(chance, F.lit(0.5)) - 0.5), digits)})


def by_window(rows: DataFrame, actual: str, slate: list[str], digits: int = 4) -> DataFrame:
    """One row for each window: observations, whole slates, errors and correlations off and on, the errors of whole slates' means, and differences."""
    ranked = rows
    for c in (actual, "off", "on"):
        ranked = models.average_ranks(ranked, ["window"], c, f"_rank_{c}")
    sums = [F.count("*").alias("observations")]
    for way in ("off", "on"):
        gap = F.col(actual) - F.col(way)
        sums += [F.avg(F.abs(gap)).alias(f"mae_{way}"), F.sqrt(F.avg(gap * gap)).alias(f"rmse_{way}"), models.pearson(actual, way).alias(f"pearson_{way}"), models.pearson(f"_rank_{actual}", f"_rank_{way}").alias(f"spearman_{way}")]
    found = ranked.groupBy("window").agg(*sums)
    means = rows.groupBy("window", *slate).agg(F.count("*").alias("_n"), *(F.avg(c).alias(c) for c in (actual, "off", "on"))).where(F.col("_n") == SLATE)
    coach = means.groupBy("window").agg(F.count("*").alias("slates"), *(F.avg(F.abs(F.col(actual) - F.col(way))).alias(f"coach_{way}") for way in ("off", "on")))
    out = found.join(coach, "window", "left").withColumn("slates", F.coalesce("slates", F.lit(0)))
    shown = [f"{m}_{way}" for m in (*METRICS, "coach") for way in ("off", "on")]
    out = out.select("window", "observations", "slates", *(F.bround(c, digits).alias(c) for c in shown))
    return out.withColumns({f"{m}_delta": F.bround(F.col(f"{m}_on") - F.col(f"{m}_off"), digits) for m in ("mae", "rmse", "pearson")})


def by_role(rows: DataFrame, actual: str, role: str, digits: int = 4) -> DataFrame:
    """(window, role, mae_off, mae_on)."""
    return rows.groupBy("window", role).agg(*(F.bround(F.avg(F.abs(F.col(actual) - F.col(way))), digits).alias(f"mae_{way}") for way in ("off", "on")))


def gate(report: DataFrame, confirmation: str, validation: str) -> DataFrame:
    """One row: whether the chance lowers the absolute error of either window without raising the other one by more than the slack."""

    def better(name: str) -> Column:
        ok = (F.col("mae_delta") < 0) & (F.col("rmse_delta") <= RMSE_SLACK)
        return F.coalesce(F.bool_or(F.when(F.col("window") == name, ok)), F.lit(False))

    out = report.agg(better(confirmation).alias("confirmed"), better(validation).alias("validated"))
    return out.withColumn("passed", F.col("confirmed") & F.col("validated"))
