"""Whether two results are the same: met by key, with a tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """A row for each column: rows met, keys on one side only, rows whose values differ by more than the tolerance (or are null on one side only), and the greatest gap."""
    side = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), *(F.col(c).cast("double").alias(f"{name}_{c}") for c in columns), F.lit(True).alias(f"{name}_there"))
    met = reduce(lambda a, b: a & b, (F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys))
    both = side(left, "l").join(side(right, "r"), met, "full")
    here = F.col("l_there").isNotNull() & F.col("r_there").isNotNull()
    rows = []
    for c in columns:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        off = here & ~(a.isNull() & b.isNull()) & ~F.coalesce((F.abs(a - b) <= tolerance) | a.eqNullSafe(b), F.lit(False))
        rows.append(F.struct(F.lit(c).alias("column"), here.alias("met"), F.col("r_there").isNull().alias("only_left"), F.col("l_there").isNull().alias("only_right"), off.alias("beyond"), F.when(here, F.abs(a - b)).alias("gap")))
    long = both.select(F.explode(F.array(*rows)).alias("_row")).select("_row.*")
    return long.groupBy("column").agg(*(F.count_if(n).alias(n) for n in ("met", "only_left", "only_right", "beyond")), F.max("gap").alias("greatest_gap"))
