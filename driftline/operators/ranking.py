"""Ranked choices: tops per group, tiers, portfolios, candidates and their expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the order must leave no ties open."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def tops_and_leaders(df: DataFrame, keys: list[str], group: str, order: list, n: int, leaders: int) -> DataFrame:
    """Rows among the first n of their keys or the first few of their group."""
    every = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    inside = F.row_number().over(Window.partitionBy(*keys, group).orderBy(*order))
    return df.withColumns({"overall": every, "in_group": inside}).where((F.col("overall") <= n) | (F.col("in_group") <= leaders))


def starters(df: DataFrame, keys: list[str], latest: str, games: str, tie: str) -> DataFrame:
    """One row of each key: latest game, then most games, nulls last."""
    return top_per_group(df, keys, [F.col(latest).desc_nulls_last(), F.col(games).desc_nulls_last(), tie], 1).drop("rank")


def novelty(df: DataFrame, history: DataFrame, role: str, entity: str, item: str) -> Column | DataFrame:
    """Adds multiplier: 1.7 if nobody of the role has played the item, 1.5 if the entity has not, else 1.3."""
    by_role = history.select(role, item).distinct().withColumn("_role", F.lit(True))
    by_entity = history.select(entity, item).distinct().withColumn("_own", F.lit(True))
    out = df.join(by_role, [role, item], "left").join(by_entity, [entity, item], "left")
    return out.withColumn("multiplier", F.when(F.col("_role").isNull(), 1.7).when(F.col("_own").isNull(), 1.5).otherwise(1.3)).drop("_role", "_own")


def legal_candidates(df: DataFrame, universe: DataFrame, used: str) -> DataFrame:
    """Each row with each item of the universe (one column, distinct) that it has not used."""
    item = universe.columns[0]
    met = df.crossJoin(universe.withColumnRenamed(item, "candidate"))
    return met.where(~F.coalesce(F.array_contains(used, F.col("candidate")), F.lit(False)))


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A sample of n rows that depends on keys and seed only, by a SHA-256 of both."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.col(key), F.lit(seed)).cast("binary"), 256), key).limit(n)


def portfolio(df: DataFrame, entity: str, item: str, first: list, second: list, third: list) -> DataFrame:
    """Three picks of each entity, best by each order in turn, without repeats of an item."""
    picked = None
    for number, order in enumerate((first, second, third), 1):
        rest = df if picked is None else df.join(picked.select(entity, item), [entity, item], "left_anti")
        chosen = top_per_group(rest, [entity], order, 1).drop("rank").withColumn("slot", F.lit(number))
        picked = chosen if picked is None else picked.unionByName(chosen)
    return picked


# Tiers of the novelty categories, what the three opening picks stand for, and the ban rate above which comfort is left.
TIERS = {"opening_round_baseline": "1.3x_opening_baseline", "already_played_by_player": "1.3x_comfort_floor", "unplayed_by_player": "1.5x_league_adoption", "unplayed_in_role": "1.7x_novelty_wildcard"}
OPENING_BASES = ("Overall", "Player comfort", "International meta")
PIVOT_ABOVE = 0.25


def tiered_portfolio(df: DataFrame, keys: list[str], item: str, top: int = 3) -> DataFrame:
    """Three picks of each novelty category of each key, and the pick to turn to where the comfortable one is often banned.

    df: keys, item, novelty_category, expected_bonus, pick_probability, player_share, leading_share, ban_rate.
    The opening category's picks are the best by bonus, by the player's share and by the leading
    regions' share in turn, without repeats; those of the others the best by bonus.  Ties go by probability, then item.
    """
    by = lambda c: [F.col(c).desc(), F.col("pick_probability").desc(), F.col(item)]
    opening = F.col("novelty_category") == "opening_round_baseline"
    known = df.where(F.col("novelty_category").isin(*TIERS)).withColumn("_key", F.struct(*keys))
    first = portfolio(known.where(opening), "_key", item, by("expected_bonus"), by("player_share"), by("leading_share"))
    basis = F.element_at(F.array(*map(F.lit, OPENING_BASES)), F.col("slot"))
    rest = top_per_group(known.where(~opening), ["_key", "novelty_category"], by("expected_bonus"), top)
    picked = first.withColumn("portfolio_basis", basis).withColumnRenamed("slot", "portfolio_rank").unionByName(rest.withColumn("portfolio_basis", F.concat(F.lit("Rank "), "rank")).withColumnRenamed("rank", "portfolio_rank"))
    tier = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))
    picked = picked.withColumn("portfolio_tier", tier[F.col("novelty_category")])
    # one comfortable pick and one with most upside a key, both of rank 1
    best = picked.where("portfolio_rank = 1")
    comfort = best.where((F.col("novelty_category") == "already_played_by_player") & (F.col("ban_rate") > PIVOT_ABOVE)).select("_key", F.col(item).alias("_from"))
    upside = top_per_group(best.where(F.col("novelty_category").isin("unplayed_by_player", "unplayed_in_role")), ["_key"], by("expected_bonus"), 1).select("_key", F.col("novelty_category").alias("_to"), F.col("portfolio_tier").alias("_tier"))
    out = picked.join(comfort.join(upside, "_key"), "_key", "left")
    turned = F.col("_from").isNotNull()
    pivot = turned & (F.col("portfolio_rank") == 1) & (F.col("novelty_category") == F.col("_to"))
    out = out.withColumns({"risk_pivot_recommended": pivot, "risk_pivot_from": F.coalesce("_from", F.lit("")), "recommended_tier": F.coalesce("_tier", F.lit("")), "portfolio_strategy": F.when(turned, "pivot_from_high_ban_risk_comfort").otherwise("best_expected_value_within_tier")})
    return out.drop("_key", "_from", "_to", "_tier")


def candidate_scores(df: DataFrame, keys: list[str], weights: tuple[float, float, float] = (0.55, 0.30, 0.15), comfort_strength: float = 0.0) -> DataFrame:
    """Ranks candidates (player_share, domestic_share, leading_share, tier, priority, comfort, ban, denial, champ_mean, champ_weight, role_mean, multiplier) by expected bonus."""
    group = Window.partitionBy(*keys)
    base = (weights[0] * F.col("player_share") + weights[1] * F.col("domestic_share") + weights[2] * F.col("leading_share")) * F.col("tier") * (0.85 + 0.15 * F.col("priority")) * (1 + comfort_strength * F.col("comfort"))
    df = df.withColumns({"base": base, "availability": F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 - (0.70 * F.col("ban") + 0.30 * F.col("denial"))))})
    df = df.withColumn("base_pick_probability", F.coalesce(F.try_divide(F.col("base"), F.sum("base").over(group)), F.lit(0.0)))
    offered = F.col("base") * F.col("availability")
    rel = F.col("champ_weight") / (F.col("champ_weight") + 5)
    points = rel * F.coalesce("champ_mean", "role_mean") + (1 - rel) * F.col("role_mean")
    df = df.withColumns({"pick_share": F.coalesce(F.try_divide(offered, F.sum(offered).over(group)), F.lit(0.0)), "expected_points": points})
    return df.withColumn("bonus", F.col("base_pick_probability") * F.col("availability") * F.col("expected_points") * (F.col("multiplier") - 1))


def teammate_synergy(df: DataFrame, boosts: DataFrame, keys: list[str], player: str, item: str, probability: str, rounds: int = 2, cap: float = 0.35, pair_keys: tuple[str, ...] = ()) -> DataFrame:
    """Moves pick probabilities towards items that go with teammates' likely items.

    Every round uses the last round's probabilities of all teammates; boosts holds
    (a, b, boost) with a < b, and those of the keys (a week, say) that it differs by.  A
    player's teammates enter as the team's sum of an item less the player's own, so no
    pairs of players are formed.
    """
    both = boosts.select(*pair_keys, "a", "b", "boost").unionByName(boosts.select(*pair_keys, F.col("b").alias("a"), F.col("a").alias("b"), "boost"))
    partners = both.groupBy(*pair_keys, F.col("b").alias(item)).agg(F.collect_list(F.struct(F.col("a").alias("to"), "boost")).alias("_partners"))
    kept = [c for c in df.columns if c not in (*keys, player, item, "p", "synergy")]
    df = df.withColumn("p", F.col(probability))
    for _ in range(rounds):
        # every candidate gives its chance, times the boost, to each of its partners, and itself to its own place
        own = F.array(F.struct(F.col(item).alias("to"), F.lit(0.0).alias("gives"), F.struct(F.lit(True).alias("_there"), *kept).alias("row")))
        given = F.transform(F.coalesce("_partners", F.array()), lambda x: F.struct(x["to"].alias("to"), (x["boost"] * F.col("p")).alias("gives"), F.lit(None).cast(_type_of(df, kept)).alias("row")))
        long = df.join(partners, [item, *pair_keys], "left").select(*keys, player, F.explode(F.concat(own, given)).alias("_x")).select(*keys, player, F.col("_x.to").alias(item), "_x.gives", "_x.row")
        met = long.groupBy(*keys, player, item).agg(F.max("row").alias("row"), F.sum("gives").alias("_own"))
        # what a team gives to an item, less the player's own part, is what its teammates give
        team = F.sum("_own").over(Window.partitionBy(*keys, item))
        df = met.withColumn("_team", team).where("row IS NOT NULL").withColumn("synergy", F.least(F.lit(cap), F.col("_team") - F.col("_own"))).select(*keys, player, item, *(F.col("row")[c].alias(c) for c in kept), "synergy")
        raised = F.col(probability) * (1 + F.col("synergy"))
        df = df.withColumn("p", F.coalesce(F.try_divide(raised, F.sum(raised).over(Window.partitionBy(*keys, player))), F.lit(0.0)))
    return df


def _type_of(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<_there:boolean," + ",".join(f"`{c}`:{kinds[c]}" for c in columns) + ">"
