"""Exact duplicates with a split for heavy hitters.

Texts are equal when they are identical after lower-casing A-Z.  A Misra-Gries
summary of the digests names the few groups that may hold more than one row in
``heavy`` of all rows.  Their exact sizes and winners are counted with map-side
sums and broadcast (at most about 4/3 * heavy rows), so rows of hot groups never
meet in one task; all other digests take an ordinary shuffle: groups are summed by
digest, and those of several rows join back to their rows.

Null texts count as empty; a null id loses against any other.  Of repeated rows
with the same largest id one stays.  An empty table gives an empty result.
Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import written

#: A digest is heavy if at least one row in so many has it.
HEAVY = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, digest) of each row; row numbers are unique, those of ``row_col`` if given."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [hashlib.sha256((x or b"").lower()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "row", "digest"])

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("binary").alias("text"))
    return kept.mapInArrow(run, "id long, row long, digest binary")


def _merge(counters: dict, more: dict, capacity: int) -> dict:
    """Adds two Misra-Gries summaries and takes them back to the capacity."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) > capacity:
        cut = sorted(counters.values(), reverse=True)[capacity]
        counters = {key: n - cut for key, n in counters.items() if n > cut}
    return counters


def summaries(keys: DataFrame, capacity: int) -> DataFrame:
    """A Misra-Gries summary of each partition of one binary column: (key, n), n never above the true count."""

    def run(batches):
        counters: dict = {}
        for batch in batches:
            counters = _merge(counters, Counter(batch.column(0).to_pylist()), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["key", "n"])

    return keys.mapInArrow(run, "key binary, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, row_col: str | None = None) -> DataFrame:
    """(id, row, digest, keep_id, group_size, kept) for each row."""
    rows = written(digests(docs, id_col, text_col, row_col), "digests")
    total = rows.count()
    least = max(2.0, total / heavy)
    # a partition's counter falls short by its rows / (capacity + 1) at most, so a heavy digest keeps 3/4 of its count
    candidates = summaries(rows.select("digest"), 4 * heavy).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= 0.75 * least)
    winner = F.max(F.struct("id", "row")).alias("winner")
    heavy_rows = rows.join(F.broadcast(candidates.select(F.col("key").alias("digest"))), "digest", "left_semi")
    winners = written(heavy_rows.groupBy("digest").agg(winner, F.count("*").alias("group_size")).where(F.col("group_size") >= least), "winners")
    split = rows.join(F.broadcast(winners), "digest", "left")
    hot = split.where(F.col("winner").isNotNull())
    # sums before the shuffle, and a join that adaptive execution may split, so that a group's size costs no task
    rest = split.where(F.col("winner").isNull()).select("id", "row", "digest")
    groups = written(rest.groupBy("digest").agg(winner, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    met = rest.join(groups, "digest", "left")
    light = met.select("id", "row", "digest", F.coalesce("winner", F.struct("id", "row")).alias("winner"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    columns = ["id", "row", "digest", F.col("winner.id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept")]
    return hot.select(*columns).unionByName(light.select(*columns))


def query(spark, sf_dir):
    """op9: every row of documents with the row that stays for its text."""
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
