"""Point-in-time rankings of items for many targets at once, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.asof import decay_weight, hot_frame_sums

#: Fixed value: how much of a targeted ban rate is taken off an item's probability.
BAN_DISCOUNT = 0.60


def _totals(events: DataFrame, probes: DataFrame, keys: list[str], time: str, frame_days: float) -> DataFrame:
    """Probes (keys, time) with the sum of events' w in [time - frame, time), where there are any; keys may hold many events."""
    both = events.select(*keys, time, F.col("w"), F.lit(1.0).alias("_n"), F.lit(False).alias("_probe")).unionByName(probes.select(*keys, time, F.lit(0.0).alias("w"), F.lit(0.0).alias("_n"), F.lit(True).alias("_probe")))
    both = both.withColumn("_row", F.struct(*keys, time))
    sums = hot_frame_sums(both, "_row", keys, time, {"total": F.col("w"), "_rows": F.col("_n")}, frame_days, asked=F.col("_probe"))
    return sums.where("_rows > 0.5").select("_row.*", "total")


def rolling_parts(history: DataFrame, targets: DataFrame, key: str, role: str, player: str, item: str, version: str, time: str, anchor: int, half_life_days: float = 90, frame_days: float = 730) -> DataFrame:
    """(key, item, all, same, own) of each target: weights of its role's rows, of those of its version, and of its player's.

    Weights are those of history rows in [time - frame, time), halved every half-life; the
    half-life's factor at the target is left in and cancels in shares.  Targets without
    history of their role have no rows.
    """
    rows = history.withColumn("w", decay_weight(time, half_life_days, anchor))
    by_role = rows.groupBy(role, item, time).agg(F.sum("w").alias("w"))
    by_version = rows.groupBy(role, item, version, time).agg(F.sum("w").alias("w"))
    by_player = rows.groupBy(role, player, item, time).agg(F.sum("w").alias("w"))
    wanted = targets.select(role, time, version).distinct()
    items = rows.select(role, item).distinct()
    grid = targets.select(role, time).distinct().join(items, role)
    every = _totals(by_role, grid, [role, item], time, frame_days).withColumnRenamed("total", "all")
    same = _totals(by_version, wanted.join(rows.select(role, item, version).distinct(), [role, version]), [role, item, version], time, frame_days).withColumnRenamed("total", "same")
    own = _totals(by_player, targets.select(role, player, time).distinct().join(rows.select(role, player, item).distinct(), [role, player]), [role, player, item], time, frame_days).withColumnRenamed("total", "own")
    out = targets.select(key, role, player, version, time).join(every, [role, time]).join(same, [role, item, version, time], "left").join(own, [role, player, item, time], "left")
    return out.select(key, item, "all", F.coalesce("same", F.lit(0.0)).alias("same"), F.coalesce("own", F.lit(0.0)).alias("own"))


def _scored(parts: DataFrame, keys: list[str], item: str, meta_weight: Column, off_version: Column) -> DataFrame:
    meta, window = off_version * F.col("all") + (1 - off_version) * F.col("same"), Window.partitionBy(*keys)
    share = lambda c: F.coalesce(F.try_divide(c, F.sum(c).over(window)), F.lit(0.0))
    out = parts.withColumn("_meta", meta).withColumn("score", meta_weight * share(F.col("_meta")) + (1 - meta_weight) * share(F.col("own")))
    # sums of weights in another order differ in their last digits, which must not settle ties
    return out.withColumn("rank", F.row_number().over(window.orderBy(F.bround("score", 9).desc(), item))).select(*keys, item, "score", "rank")


def rolling_scores(history: DataFrame, targets: DataFrame, key: str, role: str, player: str, item: str, version: str, time: str, meta_weight: float, off_version: float, anchor: int, half_life_days: float = 90, frame_days: float = 730) -> DataFrame:
    """(key, item, score, rank) of each target: meta_weight * the role's share + the rest * the player's share of each item; rows of another version count ``off_version`` in the role's share."""
    parts = rolling_parts(history, targets, key, role, player, item, version, time, anchor, half_life_days, frame_days)
    return _scored(parts, [key], item, F.lit(meta_weight), F.lit(off_version))


# The weights that are tried.
META_WEIGHTS, OFF_VERSIONS = (0.50, 0.70, 0.85, 0.95, 1.00), (0.05, 0.15, 0.30)


def tuned(parts: DataFrame, targets: DataFrame, key: str, item: str, actual: str, meta_weights=META_WEIGHTS, off_versions=OFF_VERSIONS) -> DataFrame:
    """(meta_weight, off_version, targets, hit_1, hit_3, place) of every pair of weights over the same parts, so that history is read once; place 1 is the best by hit_3, then hit_1, then in the order tried."""
    trials = F.array(*(F.struct(F.lit(float(m)).alias("meta_weight"), F.lit(float(o)).alias("off_version"), F.lit(i * len(off_versions) + j).alias("_n")) for i, m in enumerate(meta_weights) for j, o in enumerate(off_versions)))
    each = parts.withColumn("_trial", F.explode(trials)).select("*", "_trial.meta_weight", "_trial.off_version", "_trial._n").drop("_trial")
    ranked = _scored(each, [key, "meta_weight", "off_version", "_n"], item, F.col("meta_weight"), F.col("off_version")).where("rank <= 3")
    met = ranked.join(targets.select(key, F.col(actual).alias("_actual")), key).withColumn("_hit", F.array_contains("_actual", F.col(item)))
    by_target = met.groupBy(key, "meta_weight", "off_version", "_n").agg(F.max(F.when(F.col("rank") == 1, F.col("_hit")).otherwise(False).cast("int")).alias("_1"), F.max(F.col("_hit").cast("int")).alias("_3"))
    out = by_target.groupBy("meta_weight", "off_version", "_n").agg(F.count("*").alias("targets"), F.bround(F.avg("_1"), 4).alias("hit_1"), F.bround(F.avg("_3"), 4).alias("hit_3"))
    # fifteen rows
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("hit_3").desc(), F.col("hit_1").desc(), "_n"))).drop("_n")


def hits(ranked: DataFrame, targets: DataFrame, key: str, item: str, actual: str, top: int = 3) -> DataFrame:
    """(key, predicted, hit_1, hit_n): the first items of each target and whether they meet the set of actual ones."""
    best = ranked.where(F.col("rank") <= top).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("predicted"))
    met = best.join(targets.select(key, actual), key)
    return met.select(key, "predicted", F.array_contains(actual, F.get("predicted", F.lit(0))).alias("hit_1"), F.arrays_overlap("predicted", actual).alias(f"hit_{top}"))


def ban_discount(probabilities: DataFrame, rates: DataFrame, key: str, player: str, item: str, part: float = BAN_DISCOUNT) -> DataFrame:
    """Probabilities (key, player, item, probability) less the part of the rate (player, item, rate) at which opponents ban the item, with ranks."""
    out = probabilities.join(rates.select(player, item, F.col("rate").alias("_rate")), [player, item], "left")
    out = out.withColumn("adjusted", F.col("probability") * (1 - part * F.coalesce("_rate", F.lit(0.0)))).drop("_rate")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("adjusted").desc(), item)))


def realized_bonus(choices: DataFrame, played: DataFrame, keys: list[str], item: str, points: str, games: str, multiplier: str) -> DataFrame:
    """Adds hit and realized: a choice's points where it was played, times the multiplier less 1, for each game of the series."""
    sums = played.groupBy(*keys, item).agg(F.sum(points).alias("_points"))
    out = choices.join(sums, [*keys, item], "left").withColumn("hit", F.col("_points").isNotNull())
    return out.withColumn("realized", F.coalesce("_points", F.lit(0.0)) * (F.col(multiplier) - 1) / F.greatest(F.lit(1), F.col(games))).drop("_points")


def value_choices(candidates: DataFrame, keys: list[str], item: str, probability: str, bonus: str, carry: list[str]) -> DataFrame:
    """The item of each target with the greatest expected bonus (of equal ones the likelier, then the first by name)."""
    order = Window.partitionBy(*keys).orderBy(F.bround(bonus, 9).desc(), F.bround(probability, 9).desc(), item)
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, item, *carry)


def summary(choices: DataFrame, keys: list[str], columns: dict[str, Column], digits: int = 4) -> DataFrame:
    """Number of choices and rounded means of some columns."""
    return choices.groupBy(*keys).agg(F.count("*").alias("targets"), *(F.bround(F.avg(c.cast("double")), digits).alias(n) for n, c in columns.items()))
