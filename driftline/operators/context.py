"""Joins that give a row the context of its own group, the other side, or its opponent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in an order that leaves no ties open."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def attach_context(rows: DataFrame, context: DataFrame, keys: list[str], values: list[str], prefix: str, flip: tuple[str, dict] | None = None) -> DataFrame:
    """Left-joins context values under a prefix; flip maps a key's values to those of the other side first.  A key with two rows of context is an error."""
    if flip:
        column, pairs = flip
        swap = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
        context = context.withColumn(column, swap[F.col(column)])
    # counted by the keys of the join, so that the join finds its rows where the count has put them
    one = context.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(v).alias(f"{prefix}{v}") for v in values))
    twice = F.raise_error(F.concat(F.lit("more than one row of context for: "), F.concat_ws(", ", *keys)))
    kinds = dict(one.dtypes)
    checked = [F.when(F.col("_n") > 1, twice.cast(kinds[f"{prefix}{v}"])).otherwise(F.col(f"{prefix}{v}")).alias(f"{prefix}{v}") for v in values]
    return rows.join(one.select(*keys, *checked), keys, "left")


def two_sided(df: DataFrame, group: str, side: str, measures: dict[str, Column]) -> DataFrame:
    """Groups of exactly two sides as (group, side_a, side_b, <measure>_a, <measure>_b), the sides in order."""
    totals = df.where(F.col(group).isNotNull() & F.col(side).isNotNull()).groupBy(group, side).agg(*(c.alias(k) for k, c in measures.items()))
    pairs = totals.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(side, *measures))).alias("sides")).where(F.size("sides") == 2)
    a, b = F.col("sides")[0], F.col("sides")[1]
    return pairs.select(group, a[side].alias("side_a"), b[side].alias("side_b"), *(x[k].alias(f"{k}_{n}") for k in measures for n, x in (("a", a), ("b", b))))


def opponents(df: DataFrame, group: str, side: str) -> DataFrame:
    """Adds opponent: the other of exactly two sides in the group, else the empty text."""
    sides = df.groupBy(group).agg(F.collect_set(side).alias("_sides"))
    other = F.array_except("_sides", F.array(side))
    return df.join(sides, group, "left").withColumn("opponent", F.when(F.size("_sides") == 2, F.coalesce(other[0].cast("string"), F.lit(""))).otherwise("")).drop("_sides")


def across_sides(a: DataFrame, b: DataFrame, group: str, side: str) -> DataFrame:
    """Rows of a with rows of b in the same group on a different side (columns of b end in _other)."""
    renamed = b.select(*(F.col(c).alias(c if c == group else f"{c}_other") for c in b.columns))
    return a.join(renamed, group).where(F.col(side) != F.col(f"{side}_other"))


def share_of_group(df: DataFrame, value: Column, keys: list[str]) -> Column:
    """A value's part of its group's total; null keys form a group, an empty total gives null."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy(*keys)))


def errors(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Signed, absolute and percent error of predicted against actual values."""
    gap = F.col("predicted") - F.col("actual")
    return predicted.join(actual, keys).select(*keys, gap.alias("error"), F.abs(gap).alias("absolute"), F.try_divide(gap, F.col("actual")).alias("percent"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose keys they do not replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
