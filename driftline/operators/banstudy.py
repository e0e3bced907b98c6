"""Whether an unexpected ban foretells that the other team picks the item later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import asof, folds, models

# Parts of an expected ban's chance, and the number that a prior counts as.
PARTS = {"meta_rate": 0.60, "team_rate": 0.25, "comfort": 0.15}
SMOOTHING = 2.0
BASELINE = list(PARTS)
EXTENDED = [*BASELINE, "surprise", "first_matchup_ban", "previous_matchup_bans"]
#: Later picks: in the same series, in another one, in any, all within ``days``.
OUTCOMES = ["same_series", "next_series", "within_days"]


def _smoothed(hits: Column, n: Column, prior: Column) -> Column:
    return (hits + SMOOTHING * prior) / (n + SMOOTHING)


def ban_events(actions: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Every ban with its rates and surprise from the actions before it.

    actions: league, team, opponent, item, action_type and the columns of ``order``, which together are unique;
    ``bucket`` never falls along the order.  A league's bans are counted by bucket, so that no task holds them all.
    """
    bans = actions.where("action_type = 'ban'")
    groups = {"_team_n": ["team"], "_team_hits": ["team", "item"], "previous_matchup_bans": ["team", "opponent", "item"]}
    bans = folds.counters(bans, order, groups, {"_league_n": ["league"], "_league_hits": ["league", "item"]}, bucket)
    # bans ask for the picks that their target has made before
    kept = [c for c in bans.columns if c not in ("team", "item")]
    asked = bans.select(*kept, F.col("opponent").alias("_key"), "item", F.col("team").alias("_team"), F.lit(0).alias("_pick"))
    picks = actions.where("action_type = 'pick'").select(*order, F.col("team").alias("_key"), "item", F.lit(1).alias("_pick"))
    both = asked.unionByName(picks, allowMissingColumns=True)
    before = lambda *keys: F.coalesce(F.sum("_pick").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = both.withColumns({"_target_n": before("_key"), "_target_hits": before("_key", "item")}).where("_pick = 0").drop("_pick", "_key").withColumnRenamed("_team", "team")
    # one number: how likely any item is where nothing is known
    universe = actions.agg(F.greatest(F.lit(1), F.count_distinct("item")).alias("_items"))
    even = 1 / F.col("_items")
    out = out.join(universe).withColumn("meta_rate", _smoothed(F.col("_league_hits"), F.col("_league_n"), even))
    out = out.withColumns({"team_rate": _smoothed(F.col("_team_hits"), F.col("_team_n"), F.col("meta_rate")), "comfort": _smoothed(F.col("_target_hits"), F.col("_target_n"), even)})
    chance = sum((w * F.col(c) for c, w in PARTS.items()), F.lit(0.0))
    out = out.withColumns({"expected": chance, "surprise": -F.log(F.greatest(chance, F.lit(1e-9))), "first_matchup_ban": (F.col("previous_matchup_bans") == 0).cast("double")})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def outcomes(bans: DataFrame, actions: DataFrame, time: str, series: str, key: str, days: float = 14) -> DataFrame:
    """Adds whether the ban's target picks the item later: in the series, in another one, in either.  ``key`` is unique among bans; times are epoch micros."""
    asked = bans.select(key, F.col("opponent").alias("_team"), "item", time, series, F.lit(False).alias("_pick"))
    picks = actions.where("action_type = 'pick'").select(F.col("team").alias("_team"), "item", time, series, F.lit(True).alias("_pick"))
    both = asked.unionByName(picks, allowMissingColumns=True)
    counted = {"_any": asof.followed_within(["_team", "item"], time, F.col("_pick"), days), "_same": asof.followed_within(["_team", "item", series], time, F.col("_pick"), days)}
    found = both.withColumns(counted).where("NOT _pick")
    hits = {"same_series": F.col("_same") > 0, "next_series": F.col("_any") > F.col("_same"), "within_days": F.col("_any") > 0}
    return bans.join(found.select(key, *(c.cast("double").alias(n) for n, c in hits.items())), key)


def evaluate(train: DataFrame, test: DataFrame, steps: int = 400) -> DataFrame:
    """(outcome, rows, positives, log loss and Brier score without and with the ban's own features, and how much less they are with them)."""
    fits = {f"{o}:{name}": (features, o) for o in OUTCOMES for name, features in (("baseline", BASELINE), ("extended", EXTENDED))}
    weights = models.logistic_many(train, fits, steps)
    chances = F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y"), *(models.logistic_chance(weights[f"{o}:{name}"], fits[f"{o}:{name}"][0]).alias(name) for name in ("baseline", "extended"))) for o in OUTCOMES))
    long = test.select(F.explode(chances).alias("_case")).select("_case.*")
    sums = [F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives")]
    for name in ("baseline", "extended"):
        q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col(name)))
        sums += [F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias(f"{name}_log_loss"), F.avg((q - F.col("y")) * (q - F.col("y"))).alias(f"{name}_brier")]
    out = long.groupBy("outcome").agg(*sums)
    return out.withColumns({f"delta_{m}": F.col(f"baseline_{m}") - F.col(f"extended_{m}") for m in ("log_loss", "brier")})


def decision(report: DataFrame) -> DataFrame:
    """One row: whether the features lower the log loss of every outcome, and what weight that earns them."""
    helps = F.coalesce(F.bool_and(F.bround("delta_log_loss", 6) > 0), F.lit(False))
    return report.agg(helps.alias("consistently_improves")).withColumn("production_weight", F.when(F.col("consistently_improves"), "eligible for tuning").otherwise("zero"))
