"""Chances of winning a match: baselines, a fitted model, and the gate that it must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import asof, models

# Start weights (intercept, rating gap, win-rate gap), and scales where training matches show no spread.
START = [0.0, 0.5, 0.2]
NO_SPREAD = {"elo_diff": 100.0, "win_rate_diff": 0.2}
#: Models in the order of a report; each is a column of ``probabilities``.
MODELS = ("even", "win_rate", "elo", "logistic")


def pregame(rated: DataFrame, match: str, order: list[str], rows: int = 20) -> DataFrame:
    """Rated matches (side_a, side_b, a_win, rating_a, rating_b, p_a) with both sides' shrunken win rates of their last matches before, and the gaps."""
    won = lambda side: F.col("a_win") if side == "a" else 1 - F.col("a_win")
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"side_{side}").alias("team"), won(side).alias("won")) for side in ("a", "b")))
    long = rated.select(match, *(c for c in order if c != match), F.explode(sides).alias("x")).select(match, *(c for c in order if c != match), "x.*")
    long = long.withColumn("rate", asof.shrunken_rate(["team"], order, F.col("won") > 0.5, rows))
    rates = long.groupBy(match).agg(*(F.max(F.when(F.col("side") == side, F.col("rate"))).alias(f"win_rate_{side}") for side in ("a", "b")))
    out = rated.join(rates, match)
    return out.withColumns({"elo_diff": F.col("rating_a") - F.col("rating_b"), "win_rate_diff": F.col("win_rate_a") - F.col("win_rate_b")})


def scales(training: DataFrame) -> dict[str, float]:
    """Sample deviations of the gaps over training matches only."""
    row = training.agg(*(F.stddev_samp(c).alias(c) for c in NO_SPREAD)).first()
    return {c: float(row[c]) if row[c] else none for c, none in NO_SPREAD.items()}


def fit(training: DataFrame, steps: int = 200) -> tuple[list[float], dict[str, float]]:
    """(weights of the intercept and both standardised gaps, scales), from training matches only."""
    by = scales(training)
    rows = training.select("a_win", *((F.col(c) / by[c]).alias(c) for c in by))
    return models.logistic_many(rows, {"win": (list(by), "a_win")}, steps, 0.1, clip=10.0, start={"win": START})["win"].tolist(), by


def _chance(z: Column, most: float) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(most), F.greatest(F.lit(-most), z))))


def probabilities(matches: DataFrame, weights: list[float], by: dict[str, float]) -> DataFrame:
    """Adds a chance of side a by each model."""
    z = F.lit(weights[0])
    for (c, scale), w in zip(by.items(), weights[1:], strict=True):
        z = z + F.lit(w) * F.col(c) / F.lit(scale)
    return matches.withColumns({"even": F.lit(0.5), "win_rate": _chance(2.0 * F.col("win_rate_diff"), 5.0), "elo": F.col("p_a"), "logistic": _chance(z, 10.0)})


def evaluate(scored: DataFrame, window: Column) -> DataFrame:
    """(window, model, rows, accuracy, log_loss, brier) of each model in each window; rows whose window is null are left out."""
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in MODELS))
    long = scored.withColumn("window", window).where("window IS NOT NULL").select("window", "a_win", F.explode(pairs).alias("x"))
    return long.groupBy("window", F.col("x.model").alias("model")).agg(*(c.alias(k) for k, c in models.metrics(F.col("x.p"), F.col("a_win")).items()))


def gate(report: DataFrame, confirmation: str, validation: str, digits: int = 4) -> DataFrame:
    """One row: whether the fitted model beats the ratings by log loss and Brier score in either window, and which chances are to be used."""

    def of(name: str, model: str, metric: str) -> Column:
        return F.bround(F.max(F.when((F.col("window") == name) & (F.col("model") == model), F.col(metric))), digits)

    def beats(name: str) -> Column:
        both = (of(name, "logistic", "log_loss") < of(name, "elo", "log_loss")) & (of(name, "logistic", "brier") < of(name, "elo", "brier"))
        return F.coalesce(both, F.lit(False))

    out = report.agg(beats(confirmation).alias("confirmed"), beats(validation).alias("validated"))
    accepted = F.col("confirmed") & F.col("validated")
    return out.withColumns({"accepted": accepted, "source": F.when(accepted, "logistic").otherwise("elo")})
