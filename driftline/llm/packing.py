"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are words, or the integers of ``length_col`` (tokens of an encoder, say).
Documents are dealt at random over shards of about ``shard_docs`` documents, so that
the work grows in parallel with the corpus.  In a shard, longest pieces first, each
piece goes to the open bin that it fills best.  If none has room, a bin opens: for each
permitted length, the piece and all that is left to pack tell what such a bin would
hold, taking the longest piece that still fits again and again, and the length opens
whose bin, downsized to that content, costs least a word.  Cost of capacity c =
overhead + c + attention * c^2.  At last each bin takes the smallest permitted length
that holds its contents.

A document over the largest length is cut into pieces of that length and a rest;
no word is lost.  Null, empty and blank texts take no bin (bin_id null, length 0).
Repeated rows are packed like others; a null id stays null.  Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import textkernel as tk
from driftline.llm.shared import written

CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 128.0
ATTENTION = 1 / 8192
SHARD_DOCS = 4096


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """(id, row, n) with the number of words of each text, or its given length; a null or negative length is 0."""
    row = F.monotonically_increasing_id().alias("row")
    if length_col is not None:
        return docs.select(F.col(id_col).cast("long").alias("id"), row, F.greatest(F.lit(0), F.coalesce(F.col(length_col), F.lit(0))).cast("long").alias("n"))

    def run(batches):
        for batch in batches:
            counts = [tk.words(data, offsets)[2] for _, _, data, offsets in tk.chunks(batch.column(2))]
            n = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64))], ["id", "row", "n"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), row, F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, row long, n long")


def content(size: int, capacity: int, ascending: list[int], before: list[int], left: int) -> int:
    """What a bin holds that opens for a piece and takes the longest of the first ``left`` pieces that fits, again and again.

    before[i] is the sum of the first i pieces; neighbours that fit together are taken at once.
    """
    room = capacity - size
    while left and room >= ascending[0]:
        top = bisect_right(ascending, room, 0, left)
        if not top:
            break
        # the longest run ending at top that fits; it holds one piece at least
        low = bisect_left(before, before[top] - room, 0, top)
        room -= before[top] - before[low]
        left = low
    return capacity - room


def best_fit(sizes: list[int], capacities=CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[list[int], list[int], list[int], list[int]]:
    """Packs positive sizes of at most the largest capacity: bin and place in it of each size; capacity and contents of each bin."""
    capacities = sorted(capacities)
    cost = {c: overhead + c + attention * c * c for c in capacities}
    bins, places, used, room = [0] * len(sizes), [0] * len(sizes), [], []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ascending = [sizes[i] for i in reversed(order)]
    before = [0]
    for n in ascending:
        before.append(before[-1] + n)
    for done, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, k = room.pop(at)
        else:
            held = {c: content(size, c, ascending, before, len(order) - done - 1) for c in capacities if c >= size}
            free = min(held, key=lambda c: (cost[capacities[bisect_left(capacities, held[c])]] / held[c], c))
            k = len(used)
            used.append(0)
        bins[i], places[i] = k, used[k]
        used[k] += size
        if free > size:
            insort(room, (free - size, k))
    return bins, places, [capacities[bisect_left(capacities, n)] for n in used], used


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities=CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, shard_docs: int = SHARD_DOCS, length_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start (its first word in the document), length, bin_id, bin_start, bin_capacity, bin_used."""
    rows = written(lengths(docs, id_col, text_col, length_col), "lengths")
    shards = max(1, -(-rows.count() // shard_docs))
    largest = max(capacities)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"], na_position="last", ignore_index=True)
        n = pdf["n"].to_numpy()
        pieces = np.maximum(1, -(-n // largest))
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(largest, n[doc] - piece * largest)
        some = np.flatnonzero(length > 0)
        bins, places, capacity, used = best_fit(length[some].tolist(), capacities, overhead, attention)
        out = pd.DataFrame({"doc_id": pdf["id"].astype("Int64").to_numpy()[doc], "piece": piece, "start": piece * largest, "length": length})
        columns = {"bin_id": (int(pdf["shard"].iloc[0]) << 32) + np.asarray(bins, dtype=np.int64), "bin_start": places, "bin_capacity": np.asarray(capacity, dtype=np.int64)[bins], "bin_used": np.asarray(used, dtype=np.int64)[bins]}
        for name, values in columns.items():
            out[name] = pd.array([None] * len(out), dtype="Int64")
            out.loc[some, name] = pd.array(np.asarray(values, dtype=np.int64), dtype="Int64")
        return out

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, length long, bin_id long, bin_start long, bin_capacity long, bin_used long")


def query(spark, sf_dir):
    """op10: every document packed with the production lengths."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
