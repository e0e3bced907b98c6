"""Version text, distance and decay; decayed shares, comfort and pair strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Minor versions at which a season turns, and the distance rules' constants.
BOUNDARIES = (8, 18)
RESET, SEASON_GAP, SEASON_LENGTH, BOUNDARY_COST = 5, 5, 24, 2


def parse(version: Column) -> tuple[Column, Column]:
    """Major and minor number of a version text; (0, 0) if it has none."""
    part = [F.regexp_extract(F.coalesce(version, F.lit("")), r"^\s*(\d+)\.(\d+)", k) for k in (1, 2)]
    return tuple(F.when(p == "", 0).otherwise(p.try_cast("int")) for p in part)


def distance(target: Column, historical: Column, reset: float = RESET) -> Column:
    """How far a historical version lies from the target's."""
    (tm, tn), (hm, hn) = parse(target), parse(historical)
    later = (hm > tm) | ((hm == tm) & (hn > tn))
    crossed = F.lit(0)
    for boundary in BOUNDARIES:
        crossed = crossed + F.when((hn < boundary) & (tn >= boundary), 1).otherwise(0)
    inside = (tn - hn) + BOUNDARY_COST * crossed
    across = F.greatest(F.lit(0), SEASON_LENGTH - hn) + SEASON_LENGTH * F.greatest(F.lit(0), tm - hm - 1) + tn + reset * (tm - hm)
    reverse = F.abs(tm - hm) * SEASON_GAP + F.abs(tn - hn)
    return F.when((tm == hm) & (tn == hn), 0.0).when(later, reverse).when(tm == hm, inside).otherwise(across).cast("double")


def decay(gap: Column, rate: float) -> Column:
    return F.exp(-F.lit(rate) * gap)


def weighted_shares(counts: DataFrame, targets: DataFrame, keys: list[str], item: str, rate: float) -> DataFrame:
    """Share of each item for each target version.

    counts holds (keys, version, item, n), already summed by version, so only versions
    meet the few target versions.
    """
    met = counts.join(targets.select(F.col("version").alias("target")))
    met = met.withColumn("w", F.col("n") * decay(distance(F.col("target"), F.col("version")), rate))
    sums = met.groupBy(*keys, "target", item).agg(F.sum("w").alias("w"))
    totals = sums.groupBy(*keys, "target").agg(F.sum("w").alias("total"))
    return sums.join(totals, [*keys, "target"]).select(*keys, "target", item, (F.col("w") / F.col("total")).alias("share"))


def comfort(df: DataFrame, keys: list[str], item: str, game: str, stage: str) -> DataFrame:
    """share * n / (n + 2) * (0.5 + 0.5 * min(1, stages / 2)) of each item of an entity."""
    games = df.groupBy(*keys).agg(F.count_distinct(game).alias("games"))
    items = df.groupBy(*keys, item).agg(F.count_distinct(game).alias("n"), F.count_distinct(stage).alias("stages")).join(games, keys)
    return items.select(*keys, item, (F.col("n") / F.col("games") * F.col("n") / (F.col("n") + 2) * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("stages") / 2))).alias("comfort"))


def pairs(df: DataFrame, keys: list[str], group: str, item: str) -> DataFrame:
    """Games in which two items of a group meet, as (keys, a, b, n) with a < b.

    A group's distinct items are paired inside its own array, so groups must be small, as drafts are.
    """
    sets = df.groupBy(*keys, group).agg(F.sort_array(F.collect_set(item)).alias("items"))
    a = sets.select(*keys, "items", F.posexplode("items").alias("i", "a"))
    b = a.select(*keys, "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    return b.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def pair_boosts(df: DataFrame, keys: list[str], group: str, item: str, least: int = 3, cap: float = 0.25) -> DataFrame:
    """min(cap, n / min(n_a, n_b) * n / (n + 8)) of pairs that met often enough."""
    sets = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys, group).agg(F.sort_array(F.collect_set(item)).alias("items"))
    a = sets.select(*keys, "items", group, F.posexplode("items").alias("i", "a"))
    # an item's own games are its pairs with nothing, so that games are read once
    others = F.slice("items", F.col("i") + 2, F.size("items"))
    none = F.array(F.lit(None).cast(dict(df.dtypes)[item]))
    counted = a.select(*keys, "a", F.explode(F.when(F.col(group).isNull(), others).otherwise(F.concat(others, none))).alias("b")).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    alone = F.max(F.when(F.col("b").isNull(), F.col("n")))
    out = counted.withColumns({"n_a": alone.over(Window.partitionBy(*keys, "a")), "n_b": alone.over(Window.partitionBy(*keys, F.coalesce("b", "a")))}).where(F.col("b").isNotNull() & (F.col("n") >= least))
    return out.where("n_a IS NOT NULL AND n_b IS NOT NULL").select(*keys, "a", "b", "n", F.least(F.lit(cap), F.col("n") / F.least("n_a", "n_b") * F.col("n") / (F.col("n") + 8)).alias("boost"))


def season_boosts(df: DataFrame, major: str, group: str, item: str, cap: float = 0.05, part: float = 0.20) -> DataFrame:
    """(major, a, b, boost) of whole seasons: a part of the season's pair boost, capped."""
    return pair_boosts(df, [major], group, item).select(major, "a", "b", F.least(F.lit(cap), part * F.col("boost")).alias("boost"))


def boost_lookup(wanted: DataFrame, boosts: DataFrame, seasons: DataFrame, rate: float = 0.15, reach: int = 4, cap: float = 0.25, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, target, boost) of pairs (a, b, target).

    Boosts (a, b, version, boost) of versions of the target's season, up to the target and
    within reach, are decayed and averaged over the number of these versions; without any,
    the latest earlier season (a, b, major, boost) counts, halved for each season between.
    All tables may have further keys in common, as the week that a model is of.
    """
    (tm, tn), (vm, vn) = parse(F.col("target")), parse(F.col("version"))
    pair, key = ["a", "b", *keys], ["a", "b", "target", *keys]
    near = (tm == vm) & (vn <= tn) & (tn - vn <= reach)
    w = decay(distance(F.col("target"), F.col("version")), rate)
    now = wanted.join(boosts, pair).where(near).groupBy(*key).agg(F.least(F.lit(cap), F.avg(w * F.col("boost"))).alias("now"))
    gap = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.max(tm) - F.max("major") - 1))
    old = wanted.join(seasons, pair).where(F.col("major") < tm).groupBy(*key).agg((F.max_by("boost", "major") * gap).alias("old"))
    found = wanted.join(now, key, "left").join(old, key, "left")
    return found.select(*key, F.coalesce("now", "old", F.lit(0.0)).alias("boost"))


def duos(df: DataFrame, keys: list[str], role: str, first: str, second: str, item: str) -> DataFrame:
    """How often items of two roles of the same group meet."""
    a = df.where(F.col(role) == first).select(*keys, F.col(item).alias("first"))
    b = df.where(F.col(role) == second).select(*keys, F.col(item).alias("second"))
    return a.join(b, keys).groupBy("first", "second").agg(F.count("*").alias("n"))


def dynamic_weights(games: Column) -> Column:
    """Weights of player, domestic and leading share by the games a patch has seen."""

    def weights(a, b, c):
        return F.struct(F.lit(a).alias("player"), F.lit(b).alias("domestic"), F.lit(c).alias("leading"))

    return F.when(games < 5, weights(0.35, 0.15, 0.50)).when(games <= 15, weights(0.45, 0.25, 0.30)).otherwise(weights(0.55, 0.30, 0.15))


def maturity_weights(games: Column, early: tuple, mature: tuple, full: float) -> list[Column]:
    """Weights that move from early to mature over the first ``full`` games."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), games / full))
    return [F.lit(float(a)) + (float(b) - float(a)) * part for a, b in zip(early, mature, strict=True)]


def latest_version(df: DataFrame, time: str, version: str, cutoff: Column, chosen: Column | None = None) -> DataFrame:
    """The version of the latest row before the cutoff, of chosen rows only if given; empty without such a row."""
    seen = df.where((F.col(time) < cutoff) & (F.lit(True) if chosen is None else chosen))
    return seen.agg(F.coalesce(F.trim(F.max_by(version, F.struct(time, version))), F.lit("")).alias(version))


def comfort_strength(games: Column, early: float, mature: float, full: float) -> Column:
    """How much comfort counts: from early to mature over the first ``full`` games."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), games / max(1.0, full)))
    return (1 - part) * early + part * mature


def decay_column(name: str, rate: float) -> str:
    return f"{name}_pdr_{rate:g}".replace(".", "_")


def select_decay(df: DataFrame, names: list[str], rate: float) -> DataFrame:
    """Shows the columns of one decay rate under their plain names; a rate that was not computed is an error."""
    missing = [decay_column(n, rate) for n in names if decay_column(n, rate) not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({n: F.col(decay_column(n, rate)) for n in names} | {"patch_decay_rate": F.lit(float(rate))})
