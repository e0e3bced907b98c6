"""Sums and roundings that do not depend on how rows were dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column | str, digits: int) -> Column:
    """Rounds a double half to even as SQL's round_even does: scaled, rounded to the nearest whole number, scaled back.

    bround reads the shortest decimal text, where 15.549999999999999 is no tie and
    15.55 is one; scaled by ten both are 155.5.
    """
    x, scale = (F.col(x) if isinstance(x, str) else x).cast("double"), F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def ordered_mean(value: str, *order: str) -> Column:
    """The mean of a group's doubles, added one after another in an order, so that it is the same bits for any partitions."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("double").alias("_value")))))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["_value"]), F.size(rows))
