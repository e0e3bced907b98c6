"""Models with a version for each locked week, and what adding them changes.

A week's version knows all rows before the week.  It is not fitted anew: its counts are
running totals of each key's own rows, met as of the weeks that ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import versions as ver

WEEK = 7 * 86_400_000_000
#: 1970-01-05 was a Monday.
MONDAY = 4 * 86_400_000_000


def week_start(time: Column) -> Column:
    """Monday, 0:00, of epoch micros."""
    return time - F.pmod(time - F.lit(MONDAY), F.lit(WEEK))


def counts_before(rows: DataFrame, asked: DataFrame, keys: list[str], time: str, week: str, name: str) -> DataFrame:
    """(keys, week, name): how many rows (keys, time, n) of the keys come before each asked week; a key's total goes to a task, not the rows."""
    steps = rows.groupBy(*keys, F.col(time).alias("_at")).agg(F.sum("n").alias("_n"))
    probes = asked.select(*keys, F.col(week).alias("_at")).distinct().withColumns({"_n": F.lit(0).cast("long"), "_asked": F.lit(True)})
    both = steps.withColumn("_asked", F.lit(False)).unionByName(probes)
    window = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.coalesce(F.sum("_n").over(window), F.lit(0))).where("_asked").select(*keys, F.col("_at").alias(week), name)


def weekly_boosts(picks: DataFrame, asked: DataFrame, version: str, group: str, item: str, time: str, week: str = "week", least: int = 3, cap: float = 0.25) -> DataFrame:
    """(a, b, version, week, boost) of asked pairs (a, b, version, week) that met often enough before the week."""
    met = ver.pairs(picks, [version, time], group, item)
    alone = picks.groupBy(version, time, item).agg(F.count_distinct(group).alias("n"))
    out = counts_before(met, asked, [version, "a", "b"], time, week, "_pair").where(F.col("_pair") >= least)
    for side in ("a", "b"):
        single = alone.withColumnRenamed(item, side)
        out = out.join(counts_before(single, out, [version, side], time, week, f"_{side}"), [version, side, week])
    n = F.col("_pair")
    return out.select("a", "b", version, week, F.least(F.lit(cap), n / F.least("_a", "_b") * n / (n + 8)).alias("boost"))


def pair_strength(picks: DataFrame, group: str, item: str, time: str, week: str = "week", season_cap: float = 0.05, season_part: float = 0.20):
    """For picks (version, group, item, time): what adds boost to (a, b, target, week), as known before each week."""
    majors = picks.withColumn("major", ver.parse(F.col("version"))[0])

    def add(wanted: DataFrame) -> DataFrame:
        pairs = wanted.select("a", "b", week).distinct()
        by_version = pairs.join(picks.select("version").distinct())
        by_season = pairs.join(majors.select("major").distinct())
        boosts = weekly_boosts(picks, by_version, "version", group, item, time, week)
        seasons = weekly_boosts(majors, by_season, "major", group, item, time, week)
        seasons = seasons.withColumn("boost", F.least(F.lit(season_cap), season_part * F.col("boost")))
        return ver.boost_lookup(wanted, boosts, seasons, keys=(week,))

    return add


def deltas(with_part: DataFrame, without: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Three rows of one-row metrics: with the part, without it, and the difference; none where the first column counts nothing."""
    both = with_part.select(*(F.col(c).alias(f"w_{c}") for c in columns)).join(without.select(*(F.col(c).alias(f"o_{c}") for c in columns)))
    rows = [("with", lambda c: F.col(f"w_{c}")), ("without", lambda c: F.col(f"o_{c}")), ("difference", lambda c: F.col(f"w_{c}") - F.col(f"o_{c}"))]
    packed = F.array(*(F.struct(F.lit(name).alias("variant"), *(F.bround(of(c).cast("double"), digits).alias(c) for c in columns)) for name, of in rows))
    some = (F.col(f"w_{columns[0]}") > 0) & (F.col(f"o_{columns[0]}") > 0)
    return both.where(some).select(F.explode(packed).alias("_case")).select("_case.*")
