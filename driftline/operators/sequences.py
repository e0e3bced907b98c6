"""Order-dependent operators: sessions, running pools, prior states and step orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The 20 steps of a draft as (phase, kind, side relative to the first side, slot).
DRAFT_ORDER = (
    *(("ban1", "ban", s, k) for s, k in (("first", 1), ("second", 1), ("first", 2), ("second", 2), ("first", 3), ("second", 3))),
    *(("pick1", "pick", s, k) for s, k in (("first", 1), ("second", 1), ("second", 2), ("first", 2), ("first", 3), ("second", 3))),
    *(("ban2", "ban", s, k) for s, k in (("second", 4), ("first", 4), ("second", 5), ("first", 5))),
    *(("pick2", "pick", s, k) for s, k in (("second", 4), ("first", 4), ("first", 5), ("second", 5))),
)


def sessions(df: DataFrame, keys: list[str], time: str, name: str, gap_micros: int, restart: Column | None = None, tie: str | None = None) -> DataFrame:
    """Adds session: the name of the row that began it, after a gap or a restart."""
    window = Window.partitionBy(*keys).orderBy(time, tie or name)
    previous = F.lag(time).over(window)
    new = previous.isNull() | (F.col(time) - previous > gap_micros)
    new = new if restart is None else new | restart
    df = df.withColumn("_new", new)
    return df.withColumn("session", F.last(F.when(F.col("_new"), F.col(name)), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def earlier(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_pool(items: Column, window) -> Column:
    """Sorted distinct items of the arrays of all earlier rows."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(items).over(window))))


def prior(item: str | Column, chosen: Column, window) -> Column:
    """Items of earlier rows that fit a condition, in order."""
    return F.collect_list(F.when(chosen, F.col(item) if isinstance(item, str) else item)).over(window)


def conflicts(item: str, drafted: Column, pool: Column) -> Column:
    """Names of what makes an item illegal, joined by commas; empty if it is legal."""
    return F.concat_ws(",", F.when(F.array_contains(drafted, F.col(item)), "current_draft_duplicate"), F.when(F.array_contains(pool, F.col(item)), "fearless_unavailable"))


def draft_steps(spark) -> DataFrame:
    rows = [(i + 1, *step) for i, step in enumerate(DRAFT_ORDER)]
    return spark.createDataFrame(rows, "action_number int, action_phase string, action_type string, relative_side string, slot int")


def expand_drafts(games: DataFrame, game: str = "gameid") -> DataFrame:
    """One row for each of the 20 steps of games with first_side, blue_/red_ bans and picks (arrays of five)."""
    df = games.crossJoin(F.broadcast(draft_steps(games.sparkSession)))
    other = F.when(F.col("first_side") == "Blue", "Red").otherwise("Blue")
    df = df.withColumn("side", F.when(F.col("relative_side") == "first", F.col("first_side")).otherwise(other))
    values = F.when(F.col("side") == "Blue", F.when(F.col("action_type") == "ban", F.col("blue_bans")).otherwise(F.col("blue_picks"))).otherwise(F.when(F.col("action_type") == "ban", F.col("red_bans")).otherwise(F.col("red_picks")))
    df = df.withColumn("champion", F.trim(F.coalesce(F.get(values, F.col("slot") - 1), F.lit("")))).where("champion <> ''")
    return df.drop("blue_bans", "red_bans", "blue_picks", "red_picks")


def canonical_games(rows: DataFrame) -> DataFrame:
    """Team rows (gameid, side, teamname, date, game, firstPick, bans, picks) as one row a game; games without one Blue and one Red row are dropped."""
    sides = {s: F.col("side") == s for s in ("Blue", "Red")}
    agg = [F.count("*").alias("rows"), F.min("date").alias("date"), F.min("game").alias("game"), F.max(F.when(F.col("firstPick") == 1, F.col("side"))).alias("first_side"), *(F.sum(c.cast("int")).alias(f"n_{s}") for s, c in sides.items())]
    agg += [F.max(F.when(c, F.col(v))).alias(f"{s.lower()}_{n}") for s, c in sides.items() for v, n in (("teamname", "team"), ("bans", "bans"), ("picks", "picks"))]
    games = rows.where(F.col("gameid").isNotNull()).groupBy("gameid").agg(*agg).where("rows = 2 AND n_Blue = 1 AND n_Red = 1").drop("rows", "n_Blue", "n_Red")
    full = [F.size(c) == 5 for c in ("blue_bans", "red_bans", "blue_picks", "red_picks")] + [F.forall(c, lambda x: x != "") for c in ("blue_bans", "red_bans", "blue_picks", "red_picks")]
    complete = full[0]
    for c in full[1:]:
        complete = complete & c
    return games.withColumns({"first_side_inferred": F.col("first_side").isNull(), "first_side": F.coalesce("first_side", F.lit("Blue")), "complete": F.coalesce(complete, F.lit(False))})


def series(games: DataFrame, gap_hours: float = 12) -> DataFrame:
    """Adds series_id: new for a first game, after a gap, or where the game number does not follow."""
    df = games.withColumns({"_pair": F.array_join(F.array_sort(F.array("blue_team", "red_team")), "|"), "_us": F.unix_micros("date")})
    window = Window.partitionBy("_pair").orderBy("_us", "game", "gameid")
    restart = (F.col("game") == 1) | (F.col("game") != F.lag("game").over(window) + 1)
    df = df.withColumn("_restart", F.coalesce(restart, F.lit(True)))
    out = df.withColumn("_new", F.col("_restart") | F.lag("_us").over(window).isNull() | (F.col("_us") - F.lag("_us").over(window) > int(gap_hours * 3_600_000_000)))
    return out.withColumn("series_id", F.last(F.when(F.col("_new"), F.col("gameid")), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_pair", "_us", "_restart", "_new")


def draft_actions(games: DataFrame, fearless: Column | None = None) -> DataFrame:
    """Ordered actions with prior picks and bans, the series' pool of earlier picks, and conflicts; no action is dropped."""
    picks = F.concat(F.coalesce("blue_picks", F.array().cast("array<string>")), F.coalesce("red_picks", F.array().cast("array<string>")))
    pool = running_pool(F.filter(picks, lambda x: F.trim(x) != ""), earlier(["series_id"], ["date", "game", "gameid"]))
    games = games.withColumn("pool", pool if fearless is None else F.when(fearless, pool).otherwise(F.array().cast("array<string>")))
    df = expand_drafts(games)
    window = earlier(["gameid"], ["action_number"])
    df = df.withColumns({"picked_before": prior("champion", F.col("action_type") == "pick", window), "banned_before": prior("champion", F.col("action_type") == "ban", window)})
    df = df.withColumn("conflicts", conflicts("champion", F.concat("picked_before", "banned_before"), F.col("pool")))
    return df.withColumn("chosen_was_legal", F.col("conflicts") == "")


def change_points(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the last known one before."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("previous", before).where(F.col(value).isNotNull() & F.col("previous").isNotNull() & (F.col(value) != F.col("previous")))


def ordered_distinct(order: list[str], value: str) -> Column:
    """Distinct values of a group in the order of first sight."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]))
