"""Point-in-time aggregates: every value comes from rows strictly before the row's own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.numbers import half_even

DAY = 86_400_000_000
#: A variance of less than this part of the mean square counts as none.
NOTHING = 1e-10


def before(keys: list, time: str, frame_days: float | None = None):
    """Rows of the same keys in [time - frame, time); times are epoch micros, so peers are left out."""
    window = Window.partitionBy(*keys).orderBy(time)
    return window.rangeBetween(Window.unboundedPreceding if frame_days is None else -int(frame_days * DAY), -1)


#: Half-lives that a row may lie from the anchor: squares of weights, and sums of them, stay far from the ends of a double.
FARTHEST = 400


def decay_weight(time: str, half_life_days: float, anchor: int) -> Column:
    """2^((t - anchor) / half-life); the cutoff's own factor cancels in means.

    A row farther from the anchor than a double can hold is an error: nearer anchors or longer half-lives are needed there.
    """
    age = (F.col(time) - F.lit(anchor)) / F.lit(half_life_days * DAY)
    too_far = F.raise_error(F.lit(f"a row lies more than {FARTHEST} half-lives from the anchor")).cast("double")
    return F.when(F.abs(age) > FARTHEST, too_far).otherwise(F.pow(F.lit(2.0), age))


def frame_sum(keys: list, time: str, value: Column, frame_days: float | None) -> Column:
    """Sum of a value over rows of the keys in [time - frame, time).

    It is the running total up to the row less that up to the frame's start: both frames only
    grow, so a row costs the same whatever the frame's length.  Counts come out exactly.
    """
    now = F.coalesce(F.sum(value).over(before(keys, time)), F.lit(0.0))
    if frame_days is None:
        return now
    window = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -int(frame_days * DAY) - 1)
    return now - F.coalesce(F.sum(value).over(window), F.lit(0.0))


def moments(value: Column, weight: Column, chosen: Column | None = None) -> dict[str, Column]:
    """What a decayed mean, weight, deviation and count need of each row."""
    ok = value.isNotNull() if chosen is None else value.isNotNull() & chosen
    w = F.when(ok, weight).otherwise(0.0)
    v = F.coalesce(value, F.lit(0.0))
    return {"w": w, "wv": w * v, "wvv": w * v * v, "n": ok.cast("double")}


def statistics(sums: dict[str, Column], weight_now: Column) -> dict[str, Column]:
    """Weighted mean, effective weight at the row's time, population deviation and count from summed moments."""
    some = sums["n"] > 0.5
    mean = F.when(some, F.try_divide(sums["wv"], sums["w"]))
    square = F.when(some, F.try_divide(sums["wvv"], sums["w"]))
    # what differences of running totals leave of a spread of nothing
    spread = F.when(square - mean * mean > NOTHING * square, square - mean * mean).otherwise(0.0)
    return {
        "mean": mean,
        "weight": F.when(some, sums["w"]).otherwise(0.0) / weight_now,
        "deviation": F.when(some, F.sqrt(spread)),
        "rows": F.round(sums["n"]).cast("long"),
    }


def decayed_asof(df: DataFrame, keys: list[str], time: str, value: str, half_life_days: float, frame_days: float, anchor: int) -> DataFrame:
    """Adds mean, weight, deviation and rows of the decayed history of each row's keys."""
    weight = decay_weight(time, half_life_days, anchor)
    sums = {k: frame_sum(keys, time, c, frame_days) for k, c in moments(F.col(value), weight).items()}
    return df.withColumns(statistics(sums, weight))


#: Rows of all keys that a bucket of time holds on average, if its length is not given.
BUCKET_ROWS = 1_000_000


def bucket_length(df: DataFrame, time: str, rows: int = BUCKET_ROWS) -> int:
    """Micros of a bucket of time that holds about so many rows, a day at most."""
    found = df.agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span")).first()
    return max(1, min(DAY, (found["span"] or 0) * rows // max(1, found["n"]) + 1))


def hot_frame_sums(df: DataFrame, row: str, keys: list[str], time: str, values: dict[str, Column], frame_days: float, bucket: int = DAY, asked: Column | None = None) -> DataFrame:
    """(row, names of values) with sums over rows of the keys in [time - frame, time), for keys that hold many rows.

    Every row, or every ``asked`` one, asks for the running total at its time and at its
    frame's start.  Totals are running sums inside (keys, bucket of time) plus those of
    earlier buckets, which are few rows, so that no task holds all rows of a key.  ``row``
    is unique among rows that ask.
    """
    asked = F.lit(True) if asked is None else asked
    sent = df.select(row, *keys, F.col(time).alias("_at"), F.when(asked, 1.0).alias("_sign"), *(c.alias(n) for n, c in values.items()))
    start = df.where(asked).select(row, *keys, (F.col(time) - int(frame_days * DAY)).alias("_at"), F.lit(-1.0).alias("_sign"), *(F.lit(0.0).alias(n) for n in values))
    both = sent.unionByName(start).withColumn("_bucket", F.floor(F.col("_at") / F.lit(bucket)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    totals = both.groupBy(*keys, "_bucket").agg(*(F.sum(n).alias(f"_{n}") for n in values))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0.0)).alias(f"_{n}") for n in values))
    run = both.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0.0)) for n in values}).where("_sign IS NOT NULL").join(totals, [*keys, "_bucket"])
    return run.groupBy(row).agg(*(F.sum(F.col("_sign") * (F.col(n) + F.col(f"_{n}"))).alias(n) for n in values))


def projection(df: DataFrame, row: str, entity: str, role: str, opponent: str, playoff: Column, time: str, value: str, half_life_days: float, frame_days: float, anchor: int, domestic: Column | None = None, asked: Column | None = None) -> DataFrame:
    """Shrunken projection of each row's value (of each ``asked`` row's, and then of no other row) from earlier rows, with floor and ceiling.

    The entity's mean shrinks to its role's by weight / (weight + 5); the opponent's
    effect by weight / (weight + 15), the head-to-head by weight / (weight + 3) above
    half a game; play-off form enters above one game of weight.  The role's pool are its
    domestic rows, if there are any in the frame, else all its rows; without any, its mean is
    the plain mean of all rows in the frame, else 0.  ``row`` is unique.
    """
    weight = decay_weight(time, half_life_days, anchor)
    chosen = domestic if domestic is not None else F.lit(True)

    def stats(prefix: str, keys: list[str], rows: Column | None = None):
        sums = {k: frame_sum(keys, time, c, frame_days) for k, c in moments(F.col(value), weight, rows).items()}
        return {f"{prefix}_{k}": c for k, c in statistics(sums, weight).items()}

    values = {f"{p}_{k}": c for p, rows in (("any", None), ("home", chosen)) for k, c in moments(F.col(value), weight, rows).items()}
    bucket = bucket_length(df, time)
    roles = hot_frame_sums(df, row, [role], time, values, frame_days, bucket, asked)
    plain = moments(F.col(value), F.lit(1.0))
    world = hot_frame_sums(df, row, [], time, {"world_n": plain["n"], "world_v": plain["wv"]}, frame_days, bucket, asked)
    found = {p: statistics({k: F.col(f"{p}_{k}") for k in ("w", "wv", "wvv", "n")}, weight) for p in ("any", "home")}
    own = before([entity, role], time, frame_days)
    spread = {f"p{k}": F.expr(f"percentile({value}, {k / 100})").over(own) for k in (10, 90)}
    df = df.withColumns(stats("own", [entity, role]) | stats("opp_any", [role, opponent]) | stats("opp_home", [role, opponent], chosen) | stats("h2h", [entity, role, opponent]) | stats("playoff", [entity, role], playoff)).withColumns(spread)
    # rows that do not ask have been counted, and go before any join
    df = (df if asked is None else df.where(asked)).join(roles, row).join(world, row).withColumn("at_home", found["home"]["rows"] > 0)
    df = df.withColumns({f"role_{k}": F.when(F.col("at_home"), found["home"][k]).otherwise(found["any"][k]) for k in found["any"]}).drop(*values)
    df = df.withColumns({f"opp_{k}": F.when(F.col("at_home"), F.col(f"opp_home_{k}")).otherwise(F.col(f"opp_any_{k}")) for k in ("mean", "weight")})
    base = F.coalesce("role_mean", F.when(F.col("world_n") > 0.5, F.col("world_v") / F.col("world_n")), F.lit(0.0))
    mean = F.coalesce("own_mean", base)
    rel = F.col("own_weight") / (F.col("own_weight") + 5)
    shrunk = rel * mean + (1 - rel) * base
    opp = F.col("opp_weight") / (F.col("opp_weight") + 15) * (F.coalesce("opp_mean", base) - base)
    h2h = F.when(F.col("h2h_weight") > 0.5, F.col("h2h_weight") / (F.col("h2h_weight") + 3) * (F.coalesce("h2h_mean", F.lit(0.0)) - F.col("shrunk"))).otherwise(0.0)
    playoff_effect = F.when(F.col("playoff_weight") > 1, 0.2 * (F.col("playoff_mean") / F.when(mean > 0, mean).otherwise(1.0) - 1)).otherwise(0.0)
    df = df.withColumns({"baseline": base, "recent": mean, "shrunk": shrunk, "opp_effect": opp})
    df = df.withColumns({"h2h_effect": h2h, "playoff_effect": playoff_effect})
    df = df.withColumn("projection", F.col("shrunk") + 0.35 * F.col("opp_effect") + 0.25 * F.col("h2h_effect") + F.col("shrunk") * F.col("playoff_effect"))
    # a spread of nothing counts as 3
    sd = 1.28 * F.when(F.coalesce("own_deviation", "role_deviation") == 0, 3.0).otherwise(F.coalesce("own_deviation", "role_deviation"))
    many = F.col("own_rows") >= 3
    return df.withColumns({"floor": F.when(many, F.col("p10")).otherwise(F.greatest(F.lit(0.0), F.col("projection") - sd)), "ceiling": F.when(many, F.col("p90")).otherwise(F.col("projection") + sd)})


def project_plain(history: DataFrame, targets: DataFrame, row: str, entity: str, role: str, opponent: str, playoff: Column, time: str, value: str, half_life_days: float, frame_days: float, domestic: Column) -> DataFrame:
    """(row, baseline, recent, projection) of few targets by meeting each with every row of its frame: slow, and what ``projection`` is held against."""
    old = history.select(F.col(entity).alias("_entity"), F.col(role).alias("_role"), F.col(opponent).alias("_opponent"), F.col(time).alias("_time"), F.col(value).alias("_value"), playoff.alias("_playoff"), domestic.alias("_home"))
    in_frame = (F.col("_time") < F.col(time)) & (F.col("_time") >= F.col(time) - int(frame_days * DAY)) & F.col("_value").isNotNull()
    w = F.pow(F.lit(0.5), (F.col(time) - F.col("_time")) / F.lit(half_life_days * DAY))
    same = F.col("_role") == F.col(role)
    own, meets = F.col("_entity") == F.col(entity), F.col("_opponent") == F.col(opponent)
    pools = {"any": F.lit(True), "home": F.col("_home"), "own": own, "opp_any": meets, "opp_home": meets & F.col("_home"), "h2h": own & meets, "playoff": own & F.col("_playoff")}
    # every pool but the world is of the role: only its rows are weighed, and the rest are only added up; the history is dealt to all tasks
    near = targets.hint("broadcast").join(old.repartition("_time"), same & in_frame).withColumn("_w", w)
    sums = {f"{p}_{k}": F.sum(F.when(rows, c)) for p, rows in pools.items() for k, c in (("w", F.col("_w")), ("wv", F.col("_w") * F.col("_value")))}
    found = near.groupBy(row).agg(*(c.alias(n) for n, c in sums.items()))
    world = targets.select(row, time).hint("broadcast").join(old.select("_time", "_value").repartition("_time"), in_frame).groupBy(row).agg(F.avg("_value").alias("world"))
    out = targets.join(found, row, "left").join(world, row, "left")
    mean, weight = (lambda p: F.try_divide(F.col(f"{p}_wv"), F.col(f"{p}_w"))), (lambda p: F.coalesce(f"{p}_w", F.lit(0.0)))
    at_home = F.col("home_w").isNotNull()
    base = F.coalesce(F.when(at_home, mean("home")).otherwise(mean("any")), F.col("world"), F.lit(0.0))
    out = out.withColumn("baseline", base).withColumn("recent", F.coalesce(mean("own"), F.col("baseline")))
    shrink = lambda n, size: n / (n + size)
    out = out.withColumn("_shrunk", shrink(weight("own"), 5) * F.col("recent") + (1 - shrink(weight("own"), 5)) * F.col("baseline"))
    met_weight, met_mean = F.when(at_home, weight("opp_home")).otherwise(weight("opp_any")), F.when(at_home, mean("opp_home")).otherwise(mean("opp_any"))
    met_effect = shrink(met_weight, 15) * (F.coalesce(met_mean, F.col("baseline")) - F.col("baseline"))
    h2h = F.when(weight("h2h") > 0.5, shrink(weight("h2h"), 3) * (mean("h2h") - F.col("_shrunk"))).otherwise(0.0)
    late = F.when(weight("playoff") > 1, 0.2 * (mean("playoff") / F.when(F.col("recent") > 0, F.col("recent")).otherwise(1.0) - 1)).otherwise(0.0)
    return out.select(row, "baseline", "recent", (F.col("_shrunk") * (1 + late) + 0.35 * met_effect + 0.25 * h2h).alias("projection"))


def opponents_mean(projected: DataFrame, keys: list[str], opponent: str, means: list[str], first: list[str], digits: int = 2) -> DataFrame:
    """A week's projection: rounded means over all scheduled opponents, the first opponent's other columns, and the number of matchups."""
    return projected.groupBy(*keys).agg(
        *(half_even(F.avg(c), digits).alias(c) for c in means), *(F.min_by(c, opponent).alias(c) for c in first),
        F.count_distinct(F.when(F.col(opponent) != "", F.col(opponent))).alias("scheduled_matchups"),
    )


def weekly_combine(ranked: DataFrame, identity: list[str], means: list[str], sums: list[str], opponent: str) -> DataFrame:
    """One row for each candidate of a week: means and sums over its matchups, and how many opponents it meets."""
    return ranked.groupBy(*identity).agg(*(F.avg(c).alias(c) for c in means), *(F.sum(c).alias(c) for c in sums), F.count_distinct(opponent).alias("matchup_count"))


def forecast_errors(df: DataFrame, keys: list[str], predicted: str, baseline: str, actual: str) -> DataFrame:
    """Observations, mean absolute and root mean square error, and the baseline's absolute error."""
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.count("*").alias("observations"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(F.col(actual) - F.col(baseline))).alias("baseline_mae"))


def slate_errors(df: DataFrame, keys: list[str], predicted: str, actual: str, size: int = 5) -> DataFrame:
    """Error of the mean over whole slates only: groups that have exactly so many rows."""
    means = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual")).where(F.col("rows") == size)
    return means.select(*keys, F.abs(F.col("predicted") - F.col("actual")).alias("error"))


def recent_mean(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> Column:
    """Mean of the last so many rows before each row."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1))


def shrunken_rate(keys: list[str], order: list[str], hit: Column, rows: int = 20, prior: float = 2.5, size: float = 5.0) -> Column:
    """(hits + prior) / (n + size) over the last so many rows before each row."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    return (F.coalesce(F.sum(hit.cast("double")).over(window), F.lit(0.0)) + prior) / (F.count(hit).over(window) + size)


def followed_within(keys: list[str], time: str, event: Column, days: float) -> Column:
    """How many rows with the event the same keys have in (time, time + days]."""
    window = Window.partitionBy(*keys).orderBy(time).rangeBetween(1, int(days * DAY))
    return F.count(F.when(event, 1)).over(window)


def fallback(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """The first pool's value if it has rows, else the second's; pools are (count, value)."""
    return F.when(first[0] > 0, first[1]).when(second[0] > 0, second[1])
