"""Profiles of an entity's items in a phase: what it took, what was denied to it, and how that moved from the first half to the second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.numbers import half_even, ordered_mean
from driftline.operators.profiles import pool_label

#: Items that a segment lists.
SEGMENT_TOP = 5


def _listed(df: DataFrame, keys: list[str], order: list[Column], entry: list[str], name: str, most: int | None = None) -> DataFrame:
    """(keys, name): the rows of each key in an order, as one array of structs."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked if most is None else ranked.where(F.col("_r") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct(*entry).alias("_e")))), lambda x: x["_e"]).alias(name))


def usage(rows: DataFrame, keys: list[str], item: str, game: str, win: str, means: dict[str, int], team: str, time: str, version: str, order: list[str]) -> DataFrame:
    """Games, wins, win rate, rounded means, first and last time and the sorted teams and versions of each key and of each key's items: one pass with grouping sets; item is null, and _whole true, for the key itself.  Means are added in ``order``, which leaves no ties open."""
    sums = [F.count_distinct(game).alias("games"), F.coalesce(F.sum(win), F.lit(0)).cast("long").alias("wins"), half_even(F.avg(win), 4).alias("win_rate"), *(half_even(ordered_mean(c, *order), n).alias(f"avg_{c}") for c, n in means.items())]
    sums += [F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.sort_array(F.collect_set(team)).alias("teams"), F.sort_array(F.collect_set(version)).alias("versions"), (F.grouping(item) == 1).alias("_whole")]
    return rows.groupingSets([[F.col(c) for c in keys], [F.col(c) for c in (*keys, item)]], *keys, item).agg(*sums)


def denied(rows: DataFrame, sides: DataFrame, keys: list[str], context: list[str], game: str, side: str, item: str) -> DataFrame:
    """(keys, item, denied_games, faced_rate, side_rate, lift): how often opponents deny an item to a key, beside how often any side of the context does.

    sides holds (game, side, context, bans): one row for each side of a game, and what it denied.
    """
    other = F.when(F.col(side) == "Blue", "Red").when(F.col(side) == "Red", "Blue").otherwise(F.col(side))
    once = sides.dropDuplicates([game, side, *context])
    long = once.select(game, side, *context, F.explode(F.array_distinct(F.filter("bans", lambda x: F.trim(x) != ""))).alias(item))
    world = long.groupBy(*context, item).agg(F.count("*").alias("_n")).join(once.groupBy(*context).agg(F.count("*").alias("_sides")), context)
    games = rows.groupBy(*keys).agg(F.count_distinct(game).alias("_games"))
    met = rows.select(*keys, game, side, *(c for c in context if c not in keys)).distinct().join(long.withColumn(side, other), [game, side, *context])
    faced = met.groupBy(*keys, *(c for c in context if c not in keys), item).agg(F.count_distinct(game).alias("denied_games"))
    out = faced.join(games, keys).join(world, [*context, item])
    rate, usual = F.col("denied_games") / F.col("_games"), F.col("_n") / F.col("_sides")
    return out.select(*keys, item, "denied_games", half_even(rate, 4).alias("faced_rate"), half_even(usual, 4).alias("side_rate"), half_even(rate - usual, 4).alias("lift"))


def segments(rows: DataFrame, keys: list[str], item: str, game: str, time: str) -> DataFrame:
    """(keys, label, games, items, concentration, top): a key's games in order of time, cut in the middle (the first half takes the odd one)."""
    order = Window.partitionBy(*keys).orderBy(time, game)
    one = rows.where(F.trim(F.coalesce(item, F.lit(""))) != "").withColumn("_d", F.row_number().over(Window.partitionBy(*keys, game).orderBy(time, item))).where("_d = 1").drop("_d")
    half = F.floor((F.count("*").over(Window.partitionBy(*keys)) + 1) / 2)
    cut = one.withColumn("label", F.when(F.row_number().over(order) <= half, "Early half").otherwise("Late half"))
    counts = cut.groupBy(*keys, "label", item).agg(F.count("*").alias("games"))
    every = Window.partitionBy(*keys, "label")
    ranked = counts.withColumns({"_all": F.sum("games").over(every), "_r": F.row_number().over(every.orderBy(F.col("games").desc(), item))}).withColumn("share", half_even(F.col("games") / F.col("_all"), 4))
    whole = ranked.groupBy(*keys, "label").agg(F.first("_all").alias("_all"), F.count("*").alias("items"), F.sum(F.when(F.col("_r") <= 3, F.col("games")).otherwise(0)).alias("_top"))
    top = _listed(ranked, [*keys, "label"], ["_r"], [item, "games", "share"], "top", SEGMENT_TOP)
    return whole.join(top, [*keys, "label"]).select(*keys, "label", F.col("_all").alias("games"), "items", half_even(F.col("_top") / F.col("_all"), 4).alias("concentration"), "top")


def profiles(rows: DataFrame, sides: DataFrame, keys: list[str], context: list[str], item: str, game: str, side: str, win: str, means: dict[str, int], team: str, time: str, version: str, order: list[str]) -> DataFrame:
    """One row for each key: a summary, and its picks, denials and halves as arrays of structs."""
    used = usage(rows, keys, item, game, win, means, team, time, version, order)
    whole = used.where("_whole").drop(item, "_whole", "versions")
    items = used.where(~F.col("_whole") & (F.trim(F.coalesce(item, F.lit(""))) != "")).join(whole.select(*keys, F.col("games").alias("_games")), keys)
    items = items.withColumn("share", half_even(F.col("games") / F.col("_games"), 4))
    entry = [item, "games", "share", "wins", "win_rate", *(f"avg_{c}" for c in means), "first_seen", "last_seen", "versions"]
    picks = _listed(items, keys, [F.col("games").desc(), item], entry, "picks")
    bans = _listed(denied(rows, sides, keys, context, game, side, item), keys, [F.col("lift").desc(), F.col("denied_games").desc(), item], [item, "denied_games", "faced_rate", "side_rate", "lift"], "denied")
    halves = _listed(segments(rows, keys, item, game, time), keys, [F.col("label")], ["label", "games", "items", "concentration", "top"], "segments")
    out = whole.join(picks, keys, "left").join(bans, keys, "left").join(halves, keys, "left")
    lists = {n: F.coalesce(n, F.array()) for n in ("picks", "denied", "segments")}
    out = out.withColumns(lists).withColumns({"unique_items": F.size("picks"), "concentration": half_even(F.aggregate(F.slice("picks", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x["games"]) / F.col("games"), 4)})
    return out.withColumn("pool", pool_label(F.col("concentration"), F.col("unique_items")))
