"""Projections of a market: scheduled players and coaches, as known when their line-ups lock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import asof

#: Columns of a player's projection that are means over its opponents.
MEANS = ("projected", "recent", "last5", "baseline", "opponent_adjustment", "h2h_adjustment", "effective_games", "floor", "ceiling")
#: Rows whose plain mean is a player's short form.
SHORT = 5


def probes(market: DataFrame, opponents: str = "opponents") -> DataFrame:
    """A row for each scheduled opponent of a market row, numbered in the schedule's order; the empty opponent where none is scheduled."""
    listed = F.filter(F.coalesce(F.col(opponents), F.array()), lambda x: F.trim(x) != "")
    each = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("")))
    return market.withColumn("scheduled_matchups", F.size(listed)).select("*", F.posexplode(each).alias("slot", "opponent"))


def project(history: DataFrame, market: DataFrame, half_life_days: float, frame_days: float, anchor: int, digits: int = 2, mean_digits: int | None = None) -> DataFrame:
    """One row for each market row, with its projection over all its scheduled opponents and what it rests on.

    history: row, entity, role, opponent, time, value, playoff, domestic.  market: id (unique), entity, role,
    opponents (array), cutoff, and others, which stay.  Times are epoch micros; only history before a market row's own
    cutoff counts for it.  The market's rows enter every as-of total as probes without a value, so they need not be
    in the history, and one pass serves any number of cutoffs.  Names meet whatever their case.
    Values are rounded for each opponent, and their means again (to ``mean_digits`` if given).
    """
    name = lambda c: F.lower(F.trim(F.col(c).cast("string"))).alias(c)
    asked = F.struct("id", "slot")
    each = probes(market)
    shape = "struct<id:" + dict(market.dtypes)["id"] + ",slot:int>"
    tail = F.collect_list(F.struct("time", "value")).over(Window.partitionBy("entity", "role").orderBy("time", "row").rowsBetween(1 - SHORT, 0))
    known = history.select("row", name("entity"), "role", F.col("opponent").cast("string").alias("opponent"), "time", F.col("value").cast("double").alias("value"), "playoff", "domestic").where(F.col("value").isNotNull()).withColumn("tail", tail)
    scheduled = each.select(asked.alias("probe"), name("entity"), "role", "opponent", F.col("cutoff").alias("time"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("playoff"), F.lit(False).alias("domestic"))
    both = known.withColumn("probe", F.lit(None).cast(shape)).unionByName(scheduled, allowMissingColumns=True)
    # the newest row before a probe brings the last rows up to it
    newest = F.max(F.when(F.col("probe").isNull(), F.struct("time", "row", "tail"))).over(asof.before(["entity", "role"], "time"))
    both = both.withColumn("newest", newest)
    found = asof.projection(both, "probe", "entity", "role", "opponent", F.col("playoff"), "time", "value", half_life_days, frame_days, anchor, F.col("domestic"), F.col("probe").isNotNull())
    since = F.col("time") - F.lit(int(frame_days * asof.DAY))
    short = F.filter("newest.tail", lambda x: x["time"] >= since)
    total = F.aggregate(short, F.lit(0.0), lambda a, x: a + x["value"])
    values = {
        "projected": F.col("projection"), "recent": F.col("recent"), "last5": F.when(F.size(short) > 0, total / F.size(short)).otherwise(F.col("recent")), "baseline": F.col("baseline"), "opponent_adjustment": 0.35 * F.col("opp_effect"),
        "h2h_adjustment": 0.25 * F.col("h2h_effect"), "effective_games": F.coalesce("own_weight", F.lit(0.0)), "floor": F.col("floor"), "ceiling": F.col("ceiling"),
    }
    last = F.when(F.col("newest.time") >= since, F.col("newest.time"))
    found = found.select("probe", *(F.bround(v, digits).alias(k) for k, v in values.items()), F.col("own_rows").alias("games"), F.bround(F.coalesce("own_deviation", "role_deviation"), digits).alias("deviation"), last.alias("last_game"))
    means = [F.bround(F.avg(c), digits if mean_digits is None else mean_digits).alias(c) for c in MEANS]
    first = [F.min_by(c, F.col("probe.slot")).alias(c) for c in ("games", "deviation", "last_game")]
    player = found.groupBy(F.col("probe.id").alias("id")).agg(*means, *first)
    return market.withColumn("scheduled_matchups", F.size(F.filter(F.coalesce("opponents", F.array()), lambda x: F.trim(x) != ""))).join(player, "id")


def starters(projected: DataFrame, keys: list[str], last: str = "last_game", games: str = "games", tie: str = "id") -> DataFrame:
    """Marks the one of each group (a round's team and role) that played last, of equals the one of more games."""
    order = Window.partitionBy(*keys).orderBy(F.col(last).desc_nulls_last(), F.col(games).desc_nulls_last(), tie)
    return projected.withColumn("projected_starter", F.row_number().over(order) == 1)


def coaches(projected: DataFrame, coach_rows: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """Coaches (a round's team) with the mean of their projected starters, how many these are, and their names in order of role."""
    team = projected.where("projected_starter").groupBy(*keys).agg(
        F.bround(F.avg("projected"), digits).alias("projected"), F.count("*").alias("projected_players"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "id", "entity"))), lambda x: x["entity"].cast("string")), "|").alias("starters"),
    )
    return coach_rows.join(team, keys, "left").withColumns({"projected_players": F.coalesce("projected_players", F.lit(0)), "starters": F.coalesce("starters", F.lit(""))})
