"""Running pools over a stream: what a key has taken before each row, with late rows put in their place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, row long, us long, item string, first_item string, pool array<string>"
STATE = "keys array<string>, pools array<array<string>>, firsts array<string>, waiting array<string>, rows array<long>, times array<long>, items array<string>"
#: Groups that keys are dealt to by their hash: a call of the Python function a group and batch, and not one a key.
GROUPS = 1024


def running_pools(events: DataFrame, key: str, row: str, time: str, item: str, late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """(key, row, us, item, first_item, pool) of a stream's rows: the different items of the key's earlier rows in order of name, and the item of its first row.

    Rows wait until the watermark has passed them, so that those that come late by less than ``late`` are put in
    order, and the first row is locked only when no earlier one can come; rows later than that are dropped, as the
    watermark says.  A key keeps its pool, its first item, and the rows that wait; the keys of one hash share a state.
    Times are epoch micros in the result; ties go by row.
    """
    given = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(row).cast("long").alias("row"), time, F.unix_micros(time).alias("us"), F.col(item).cast("string").alias("item"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, pools, firsts, *waiting = state.get if state.exists else ([], [], [], [], [], [], [])
        known = {k: (first, list(pool)) for k, pool, first in zip(keys, pools, firsts, strict=True)}
        waits = list(zip(*waiting, strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        for pdf in frames:
            # a row that the watermark has passed already would change what has been given
            fresh = pdf[pdf["us"] >= mark] if mark > 0 else pdf
            waits += list(zip(*(fresh[c].tolist() for c in ("key", "row", "us", "item")), strict=True))
        waits.sort(key=lambda w: (w[2], w[1]))
        done = [w for w in waits if w[2] < mark]
        waits, out = waits[len(done) :], []
        for k, number, us, name in done:
            first, pool = known.get(k, (None, []))
            first = name if first is None else first
            out.append((k, number, us, name, first, pool))
            # pools given are not changed later
            known[k] = (first, pool if name in pool else sorted([*pool, name]))
        state.update((list(known), [pool for _, pool in known.values()], [first for first, _ in known.values()], *(map(list, zip(*waits, strict=True)) if waits else ([], [], [], []))))
        if waits:
            state.setTimeoutTimestamp(max(waits[0][2] // 1000, mark // 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "row", "us", "item", "first_item", "pool"])

    return given.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream of files gives, written to a folder and read back once nothing is left to read."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
