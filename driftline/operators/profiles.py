"""Grouped profiles with shrunken rates, tiers and chronological halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, keys: list[str], counted: dict[str, str], averaged: dict[str, str], complete: Column | None = None) -> DataFrame:
    """Rows, distinct counts and means of a group; means are over complete rows only."""
    ok = F.lit(True) if complete is None else complete
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(ok.cast("long")).alias("complete_rows"),
        *(F.count_distinct(c).alias(n) for n, c in counted.items()), *(F.avg(F.when(ok, F.col(c))).alias(n) for n, c in averaged.items()),
    )


def role_profiles(rows: DataFrame, context: list[str], role: str, item: str, game: str, win: Column, complete: Column, player: str, team: str, time: str, performance: list[str]) -> DataFrame:
    """One row for each context, role and item: games, wins, complete games, players, teams, first and last time, means over complete games, and shares of the role's games.

    Values that are no numbers are left out of sums and means; rates are rounded to 4 digits, means to 3.
    """
    keys = [*context, role, item]
    means = [F.bround(F.avg(F.when(complete, F.col(c).try_cast("double"))), 3).alias(f"avg_{c.replace(' ', '_')}") for c in performance]
    out = rows.groupBy(*keys).agg(
        F.count(game).alias("champion_games"), F.coalesce(F.sum(win.cast("long")), F.lit(0)).alias("wins"), F.count_if(F.coalesce(complete, F.lit(False))).alias("complete_stat_games"), F.count_distinct(player).alias("unique_players"),
        F.count_distinct(team).alias("unique_teams"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), *means,
    )
    # a role's games are the sum of its items'
    out = out.withColumn("role_games_in_context", F.sum("champion_games").over(Window.partitionBy(*context, role)))
    share = lambda a, b: F.bround(F.try_divide(F.col(a), F.col(b)), 4)
    return out.withColumns({"role_pick_rate": share("champion_games", "role_games_in_context"), "win_rate": share("wins", "champion_games"), "complete_stats_share": share("complete_stat_games", "champion_games")})


def tiers(df: DataFrame, keys: list[str], item: str, game: str, win: Column) -> DataFrame:
    """Presence, shrunken win rate, score and tier of each item of a context."""
    games = df.groupBy(*keys).agg(F.count_distinct(game).alias("games"))
    items = df.groupBy(*keys, item).agg(F.count_distinct(game).alias("n"), F.count_distinct(F.when(win, F.col(game))).alias("wins"))
    out = items.join(games, keys).withColumns({"presence": F.col("n") / F.col("games"), "win_rate": (F.col("wins") + 5) / (F.col("n") + 10)})
    out = out.withColumn("score", 0.7 * F.col("presence") + 0.3 * F.col("win_rate"))
    p, s = F.col("presence"), F.col("score")
    return out.withColumn("tier", F.when((s >= 0.25) | (p >= 0.30), "S").when((s >= 0.15) | (p >= 0.15), "A").when((s >= 0.08) | (p >= 0.05), "B").otherwise("C"))


# Score multiplier of each tier.
TIER_MULTIPLIERS = {"S": 1.35, "A": 1.15, "B": 0.90, "C": 0.70}


def tier_multiplier(tier: Column) -> Column:
    """The tier's multiplier; items without a tier count as B."""
    out = F.lit(TIER_MULTIPLIERS["B"])
    for name, value in TIER_MULTIPLIERS.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def lanes(df: DataFrame, keys: list[str], cs: str, gold: str) -> DataFrame:
    """Push and priority of each group from mean leads, nulls counting as 0."""
    means = df.groupBy(*keys).agg(F.avg(F.coalesce(cs, F.lit(0.0))).alias("cs"), F.avg(F.coalesce(gold, F.lit(0.0))).alias("gold"))
    push = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("cs") / 40))
    return means.select(*keys, push.alias("push"), F.greatest(F.lit(0.5), F.bround(1 + F.col("cs") / 50 + F.col("gold") / 1000, 2)).alias("priority"))


def relative_week(time: Column, keys: list[str]) -> Column:
    """Weeks since the first day of the group, from 1."""
    return (F.floor(F.datediff(time, F.min(time).over(Window.partitionBy(*keys))) / 7) + 1).cast("int")


def halves(keys: list[str], order: list[str]) -> Column:
    """1 for the first half of a group in order (the longer one if odd), else 2."""
    window = Window.partitionBy(*keys)
    return F.when(F.row_number().over(window.orderBy(*order)) <= F.ceil(F.count("*").over(window) / 2), 1).otherwise(2)


def rates(df: DataFrame, keys: list[str], item: str, game: str, banned: Column) -> DataFrame:
    """Ban and pick rate of each item: distinct games with it by all games of the context."""
    games = df.groupBy(*keys).agg(F.count_distinct(game).alias("games"))
    items = df.groupBy(*keys, item).agg(F.count_distinct(F.when(banned, F.col(game))).alias("bans"), F.count_distinct(F.when(~banned, F.col(game))).alias("picks"))
    return items.join(games, keys).select(*keys, item, (F.col("bans") / F.col("games")).alias("ban_rate"), (F.col("picks") / F.col("games")).alias("pick_rate"))


def draft_rates_before(actions: DataFrame, targets: DataFrame, item: str = "champion", days: float = 365) -> DataFrame:
    """(target, item, ban_rate, pick_rate, public_ban_rate, games): how often a target's opponent bans and picks items, and how often anybody bans them.

    actions: game, team, time (epoch micros), patch, action_type, item.  targets: target (unique), opponent, cutoff,
    patch.  A target's pool are the actions in [cutoff - days, cutoff) of its patch, if there are any, else of all patches.
    Rates count actions by the pool's games (the opponent's own, or all).  A target without games of its
    opponent has no rows.  Counts are differences of running totals at the pool's ends, so no action meets a target.
    """
    frame = int(days * 86_400_000_000)
    actions = actions.where(F.col(item).isNotNull())

    def between(rows: DataFrame, asked: DataFrame, keys: list[str], *names: str) -> DataFrame:
        """Adds to asked (keys, cutoff and others, all rows different) the sums of names over the rows (keys, time, names) in its frame."""
        ends = F.explode(F.array(F.struct(F.col("cutoff").alias("_at"), F.lit(1).alias("_sign")), F.struct((F.col("cutoff") - F.lit(frame)).alias("_at"), F.lit(-1).alias("_sign"))))
        probes = asked.withColumn("_ends", ends).select("*", "_ends._at", "_ends._sign").drop("_ends")
        both = probes.unionByName(rows.select(*keys, F.col("time").alias("_at"), *names), allowMissingColumns=True)
        before = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
        met = both.withColumns({n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names}).where("_sign IS NOT NULL")
        return met.groupBy(*asked.columns).agg(*(F.sum(F.col("_sign") * F.col(n)).alias(n) for n in names))

    def one(name: str) -> Column:
        return F.lit(1).cast("long").alias(name)

    by_patch = actions.groupBy("patch", "time").agg(F.count("*").alias("_same"))
    pool = between(by_patch, targets, ["patch"], "_same")
    # the patch to which a pool is held, or that of all patches
    pool = pool.withColumn("pool", F.when(F.col("_same") > 0, F.col("patch")).otherwise(F.lit(""))).select("target", "opponent", "cutoff", "pool")
    both = actions.withColumn("pool", F.explode(F.array(F.col("patch"), F.lit("")))).withColumnRenamed("team", "opponent")
    own_games = both.select("pool", "opponent", "game", "time").distinct().select("pool", "opponent", "time", one("games"))
    games = both.select("pool", "game", "time").distinct().select("pool", "time", one("_public"))
    asked = between(games, between(own_games, pool, ["pool", "opponent"], "games").where("games > 0"), ["pool"], "_public")
    # an item for each team and pool grows as the input does, and its files are so small that the planner would broadcast it
    items = both.select("pool", "opponent", item).distinct().hint("merge")
    kinds = (F.count_if(F.col("action_type") == kind).alias(f"_{kind}") for kind in ("ban", "pick"))
    own = both.groupBy("pool", "opponent", item, "time").agg(*kinds)
    out = between(own, asked.join(items, ["pool", "opponent"]), ["pool", "opponent", item], "_ban", "_pick").where("_ban + _pick > 0")
    public = both.where("action_type = 'ban'").groupBy("pool", item, "time").agg(F.count("*").alias("_bans"))
    out = between(public, out, ["pool", item], "_bans")
    return out.select("target", item, (F.col("_ban") / F.col("games")).alias("ban_rate"), (F.col("_pick") / F.col("games")).alias("pick_rate"), (F.col("_bans") / F.col("_public")).alias("public_ban_rate"), "games")


def availability(ban: Column, denial: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 - (0.70 * ban + 0.30 * denial)))


def priors(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Each item's part of its context's rows."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    return counts.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def training_weight(age_days: Column, version_gap: Column) -> Column:
    return F.pow(F.lit(0.5), age_days / 365) * F.pow(F.lit(0.70), version_gap)


def pool_label(top_share: Column, items: Column) -> Column:
    return F.when((items <= 3) | (top_share >= 0.75), "Concentrated").when((items >= 8) & (top_share <= 0.55), "Wide").otherwise("Balanced")


def lift(df: DataFrame, keys: list[str], item: str, game: str) -> DataFrame:
    """How much more often a context's games hold an item than all games do."""
    total = df.agg(F.count_distinct(game).alias("all_games"))
    world = df.groupBy(item).agg(F.count_distinct(game).alias("item_games")).join(F.broadcast(total))
    games = df.groupBy(*keys).agg(F.count_distinct(game).alias("games"))
    faced = df.groupBy(*keys, item).agg(F.count_distinct(game).alias("faced"))
    out = faced.join(games, keys).join(world, item)
    return out.select(*keys, item, (F.col("faced") / F.col("games")).alias("rate"), (F.col("item_games") / F.col("all_games")).alias("global_rate"), (F.col("faced") / F.col("games") - F.col("item_games") / F.col("all_games")).alias("lift"))
