"""Exact budgeted line-ups: one item of each slot, with variety bonus and conflict penalty, for each market."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks compare values of two digits; what differs by less than this may be the same there.
SLACK = 0.02


def pruned(items: DataFrame, keys: list[str], cost: str, value: str, item: str, k: int) -> DataFrame:
    """Drops an item if k others of its keys have the same cost and are worth more, or the same value and cost less (or equal both and come first by item).

    Each of these could take its place in a line-up that ranks before, so that none
    of the k best line-ups holds it; keys name all that decides variety and conflicts.
    Differences that two digits may hide count as none.
    """
    far = lambda own, other, column: F.count("*").over(Window.partitionBy(*keys, own).orderBy(other).rangeBetween(Window.unboundedPreceding, -2)).alias(column)
    first = F.row_number().over(Window.partitionBy(*keys, cost, value).orderBy(item)) - 1
    known = items.where(F.col(cost).isNotNull() & F.col(value).isNotNull())
    ranked = known.withColumns({"_value": -F.floor(F.col(value) * 100), "_cost": F.floor(F.col(cost) * 100)})
    counted = ranked.select("*", far(cost, "_value", "_dearer"), far(value, "_cost", "_cheaper"), first.alias("_first"))
    return counted.where((F.col("_dearer") + F.col("_first") < k) & (F.col("_cheaper") + F.col("_first") < k)).drop("_value", "_cost", "_dearer", "_cheaper", "_first")


def complete(items: DataFrame, keys: list[str], slots: list, slot: str) -> DataFrame:
    """Items of markets that have one for every slot; no other market has a line-up."""
    names = list(dict.fromkeys(slots))
    bit = F.coalesce(*(F.when(F.col(slot) == name, F.lit(1 << n)) for n, name in enumerate(names)))
    held = F.bit_or(bit).over(Window.partitionBy(*keys))
    return items.withColumn("_held", held).where(F.col("_held") == (1 << len(names)) - 1).drop("_held")


def with_bonus(players: DataFrame, options: DataFrame, keys: list[str], rank: str, bonus: str, item: str) -> DataFrame:
    """Players with the item and expected bonus of their first option (least rank, then greatest bonus), names compared without case; empty and 0 without one."""
    names = [f"_{k}" for k in keys]
    given = players.withColumns({f"_{k}": F.lower(k) for k in keys})
    # options that no player has are dropped before they are put in order
    offered = options.select(*(F.lower(k).alias(f"_{k}") for k in keys), F.col(rank).alias("_rank"), F.col(item).alias("_item"), F.col(bonus).alias("_bonus")).join(given.select(*names).distinct(), names, "left_semi")
    first = offered.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_rank", F.col("_bonus").desc(), "_item"))).where("_r = 1").drop("_r", "_rank")
    met = given.join(first, names, "left")
    return met.withColumns({item: F.coalesce("_item", F.lit("")), bonus: F.coalesce("_bonus", F.lit(0.0))}).drop(*(f"_{k}" for k in keys), "_item", "_bonus")


class _Rules:
    """What a line-up is worth."""

    def __init__(self, slots, variety, opponent, penalty, slot_weights):
        self.slots, self.variety, self.opponent = slots, variety, opponent
        weights = slot_weights or {}
        self.risks = {(a, b): round(penalty * min(weights.get(slots[a], 1.0), weights.get(slots[b], 1.0)), 2) for a, b in combinations(range(len(slots)), 2)}

    def bonus(self, groups: Column) -> Column:
        found: Column = F.lit(0.0)
        for count, value in sorted(self.variety.items()):
            found = F.when(groups >= count, value).otherwise(found)
        return found

    def most(self, groups: Column) -> Column:
        """The greatest bonus of so many groups or fewer."""
        found: Column = F.lit(0.0)
        for count, value in sorted(self.variety.items()):
            found = F.when(groups >= count, F.greatest(found, F.lit(float(value)))).otherwise(found)
        return found

    def scored(self, lineup: DataFrame) -> DataFrame:
        """Adds groups, total and rank_score to whole line-ups with cost and base, and rounds these."""
        groups = F.size(F.array_distinct(F.array(*(f"group{n}" for n in range(len(self.slots))))))
        conflict = F.lit(0.0)
        if self.opponent:
            for (a, b), risk in self.risks.items():
                meet = F.array_contains(f"opponents{a}", F.col(f"group{b}")) | F.array_contains(f"opponents{b}", F.col(f"group{a}"))
                conflict = conflict + F.when(meet, risk).otherwise(0.0)
        out = lineup.withColumn("groups", groups).withColumns({"conflict": F.bround(conflict, 2), "total": F.bround(F.col("base") * (1 + self.bonus(F.col("groups"))), 2)})
        return out.withColumns({"cost": F.bround("cost", 2), "base": F.bround("base", 2), "rank_score": F.bround(F.col("total") - F.col("conflict"), 2)})


def _markets(items: DataFrame, keys, slots, slot, group, cost, value, item, opponent) -> DataFrame:
    """A row for each market: the items of every slot as an array, the least cost of each slot (_least0 ...) and of all."""
    entry = F.struct(F.col(item).alias("item"), F.col(group).alias("group"), F.col(cost).cast("double").alias("cost"), F.col(value).cast("double").alias("value"), *([F.col(opponent).alias("opponents")] if opponent else []))
    lists = [F.collect_list(F.when(F.col(slot) == name, entry)).alias(f"_slot{n}") for n, name in enumerate(slots)]
    out = items.where(F.col(slot).isin(*slots)).groupBy(*keys).agg(*lists)
    out = out.withColumns({f"_least{n}": F.array_min(F.transform(f"_slot{n}", lambda x: x["cost"])) for n in range(len(slots))})
    return out.withColumn("_least", sum((F.col(f"_least{n}") for n in range(len(slots))), F.lit(0.0)))


def _half(markets: DataFrame, keys, numbers, budget, opponent) -> DataFrame:
    """Choices for some of the slots: cost and base of each, within the budget with the market's cheapest rest.  Markets are opened slot by slot, without a join."""
    half = markets.withColumns({"_rest": F.col("_least") - sum((F.col(f"_least{n}") for n in numbers), F.lit(0.0)), "cost": F.lit(0.0), "base": F.lit(0.0)})
    half = half.select(*keys, "_rest", "cost", "base", *(f"_slot{n}" for n in numbers), *(f"_least{n}" for n in numbers))
    for step, number in enumerate(numbers):
        after = sum((F.col(f"_least{n}") for n in numbers[step + 1 :]), F.lit(0.0))
        half = half.select(*(c for c in half.columns if c != f"_slot{number}"), F.explode(f"_slot{number}").alias("_x"))
        half = half.withColumns({"cost": F.col("cost") + F.col("_x.cost"), "base": F.col("base") + F.col("_x.value")}).where(F.col("cost") + after + F.col("_rest") <= budget + 1e-9)
        half = half.withColumns({f"item{number}": F.col("_x.item"), f"group{number}": F.col("_x.group")} | ({f"opponents{number}": F.col("_x.opponents")} if opponent else {})).drop("_x")
    return half.drop("_rest", *(f"_least{n}" for n in numbers))


def _bounded(half: DataFrame, other: DataFrame, keys, numbers, rules: _Rules, budget: float) -> DataFrame:
    """Adds most: what a line-up of this half can reach at best with any half of the other slots that the budget leaves."""
    asks = half.withColumn("_left", F.lit(budget + 1e-9) - F.col("cost"))
    offers = other.select(*keys, F.col("cost").alias("_left"), F.col("base").alias("_offer")).groupBy(*keys, "_left").agg(F.max("_offer").alias("_offer"))
    both = asks.withColumn("_asks", F.lit(True)).unionByName(offers.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    best = F.max("_offer").over(Window.partitionBy(*keys).orderBy("_left").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("_best", best).where("_asks AND _best IS NOT NULL")
    groups = F.size(F.array_distinct(F.array(*(f"group{n}" for n in numbers)))) + (len(rules.slots) - len(numbers))
    base = F.col("base") + F.col("_best")
    return out.withColumn("most", F.greatest(base, base * (1 + rules.most(groups)))).drop("_left", "_offer", "_asks", "_best")


def optimize(items: DataFrame, slots: list, slot: str, group: str, cost: str, value: str, item: str, budget: float, variety: dict[int, float], k: int, opponent: str | None = None, penalty: float = 0.0, market: list[str] | None = None, slot_weights: dict | None = None, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best line-ups of each market by rank score, total, base and least cost; without market columns all items are one market.

    Only half line-ups are formed.  What a half can reach at best is its own value and the best
    value among the other slots' halves that the budget leaves, times the greatest bonus open to it.  A few halves
    of the greatest reach are tried with each other, and their k-th best score bounds the answer: halves, and
    pairs of halves, that cannot reach it are dropped before a pair becomes a row.  The result is exact.
    Two slots whose groups meet (``opponent`` lists an item's opponents) cost the penalty times the lesser
    weight of both slots (1 unless given).  ``store`` writes a table and reads it again: markets are read several
    times, and without it what they come from is computed each time.
    """
    keys = market or ["_market"]
    items = items if market else items.withColumn("_market", F.lit(0))
    rules = _Rules(slots, variety, opponent, penalty, slot_weights)
    items = items.where(F.col(cost).isNotNull() & F.col(value).isNotNull())
    items = complete(items, keys, slots, slot) if market else items
    items = items if opponent else pruned(items, [*keys, slot, group], cost, value, item, k)
    markets = _markets(items, keys, slots, slot, group, cost, value, item, opponent).where(F.col("_least") <= budget + 1e-9)
    # whole markets are few; dealt once more, they are what all halves are opened from, and no half moves after.
    # A number is given since few bytes become many halves: without one, they would be put together by their bytes
    session = items.sparkSession
    parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    markets = (store(markets) if store else markets).withColumn("_deal", F.xxhash64(*keys)).repartition(parts, "_deal")
    keys = ["_deal", *keys]
    every = list(range(len(slots)))
    cut = len(slots) // 2
    if not cut:
        lineup = rules.scored(_half(markets, keys, every, budget, opponent))
    else:
        sides = [every[:cut], every[cut:]]
        halves = [_half(markets, keys, numbers, budget, opponent) for numbers in sides]
        halves = [_bounded(halves[i], halves[1 - i], keys, sides[i], rules, budget) for i in (0, 1)]
        renamed = [halves[0], halves[1].withColumnsRenamed({"cost": "_cost", "base": "_base", "most": "_most"})]

        def paired(first: DataFrame, second: DataFrame) -> DataFrame:
            fits = first.join(second, keys).where(F.col("cost") + F.col("_cost") <= budget + 1e-9)
            return fits.withColumns({"cost": F.col("cost") + F.col("_cost"), "base": F.col("base") + F.col("_base")}).drop("_cost", "_base")

        # a line-up of the first halves by reach exists, whatever its score; k of them bound the k-th best
        tried = [renamed[i].withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(("most", "_most")[i]).desc(), F.col(("cost", "_cost")[i]), *(f"item{n}" for n in sides[i])))).where(F.col("_r") <= k + 2).drop("_r") for i in (0, 1)]
        scores = rules.scored(paired(*tried).drop("most", "_most")).groupBy(*keys).agg(F.sort_array(F.collect_list("rank_score"), asc=False).alias("_scores"))
        # in a market without so many, anything may be among the best
        bound = scores.select(*keys, F.get("_scores", F.lit(k - 1)).alias("_bound"))
        reaching = lambda column: F.col("_bound").isNull() | (F.col(column) >= F.col("_bound") - SLACK)
        first = renamed[0].join(bound, keys, "left").where(reaching("most"))
        second = renamed[1].join(bound.withColumnRenamed("_bound", "_other"), keys, "left").where(F.col("_other").isNull() | (F.col("_most") >= F.col("_other") - SLACK)).drop("_other")
        groups = F.size(F.array_distinct(F.array(*(f"group{n}" for n in every))))
        enough = lambda bonus: F.greatest(F.col("base"), F.col("base") * (1 + bonus)) >= F.col("_bound") - SLACK
        # the greatest bonus of all first, so that groups are only counted where they decide
        reached = enough(rules.most(F.lit(len(slots)))) & enough(rules.bonus(groups))
        lineup = rules.scored(paired(first, second).where(F.col("_bound").isNull() | reached).drop("most", "_most", "_bound"))
    order = [F.col(c).desc() for c in ("rank_score", "total", "base")] + ["cost", *(f"item{n}" for n in every)]
    ranked = lineup.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.drop("_deal") if market else ranked.drop("_deal", "_market")


def documents(best: DataFrame, slots: list, items: DataFrame, keys: list[str], slot: str, item: str, details: list[str], options: DataFrame, option_order: list, entry: Column) -> DataFrame:
    """One row (keys, document) for each market: its line-ups by rank, each with its items in order of the slots, what is known of them, and their options.

    ``details`` are columns of items; options (keys, item, and what ``entry`` and ``option_order`` name) are
    listed in that order, so that a stored document needs no other table.  The document is JSON text.
    """
    numbers = list(range(len(slots)))
    long = best.select(*keys, "rank", "cost", "base", "groups", "total", "conflict", "rank_score", F.posexplode(F.array(*(F.struct(F.lit(s).alias("slot"), F.col(f"item{n}").alias("item")) for n, s in zip(numbers, slots, strict=True)))).alias("_n", "_x"))
    long = long.select(*keys, "rank", "cost", "base", "groups", "total", "conflict", "rank_score", "_n", "_x.slot", "_x.item")
    known = items.select(*keys, F.col(slot).alias("slot"), F.col(item).alias("item"), *details)
    place = Window.partitionBy(*keys, item).orderBy(*option_order)
    # options of items that are in no line-up are dropped before they are put in order
    chosen = options.join(long.select(*keys, "item").withColumnRenamed("item", item).distinct(), [*keys, item], "left_semi")
    listed = chosen.withColumn("_r", F.row_number().over(place)).groupBy(*keys, F.col(item).alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", entry.alias("_e")))), lambda x: x["_e"]).alias("options"))
    met = long.join(known, [*keys, "slot", "item"]).join(listed, [*keys, "item"], "left")
    row = F.struct("_n", F.struct("slot", "item", *details, F.coalesce("options", F.array()).alias("options")).alias("_row"))
    lineups = met.groupBy(*keys, "rank", "cost", "base", "groups", "total", "conflict", "rank_score").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_row"]).alias("items"))
    one = F.struct("rank", "cost", "base", "groups", "total", "conflict", "rank_score", "items")
    return lineups.groupBy(*keys).agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(one)).alias("lineups"))).alias("document"))
