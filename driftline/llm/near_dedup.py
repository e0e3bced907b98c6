"""Near duplicates by SuperMinHash signatures, banding, verification and components.

Words are those of the A-Z lower-cased text; a text's set holds its distinct runs
of ``width`` words, or its whole word sequence if it is shorter.  Each element of
a set deals its random values along a random permutation of the signature's places,
one place a step, in ascending order of value; steps stop once no place of the text
can fall any more.  Texts with equal sets form one class, and the rest works on
classes:

1. each band of a signature names a bucket; each class of a bucket is tried against
   the bucket's smallest class;
2. tries whose signatures agree too little (5 standard deviations below the limit)
   or whose profiles rule the limit out are dropped, the others are confirmed on the
   full sets; a profile counts a set's elements in ``SLOTS`` slots, and the sum of the
   lesser counts of two profiles is never below their intersection;
3. confirmed links give components;
4. in buckets that still hold several components, all classes of different
   components are compared by signature and profile, in blocks, each pair in the
   first band that it shares, and survivors confirmed too, so that a link is found
   through any bucket that both its ends share;
5. components of all links.

With 128 places in 32 bands, a pair at the limit of 0.8 shares no bucket with
probability 5e-8.  Sets are sets of 64-bit hashes.

Null, empty and blank texts have an empty set and link with nothing: their
component is their own id.  Repeated rows are one class.  A null id is never the
smallest id unless a component has no other.  Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import textkernel as tk
from driftline.llm.components import components
from driftline.llm.shared import small_or_shuffled, written

WIDTH = 5
SIMILARITY = 80
PLACES = 128
BANDS = 32
SLOTS = 512
#: Classes of a bucket that one task compares with so many others at a time.
BLOCK = 512
#: Text hashes and bucket keys (8 bytes each) up to this number are broadcast to pick texts and buckets; beyond it the pick shuffles.
BROADCAST_TEXTS = 500_000


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, element hash) of some texts, ordered."""
    starts, ends, counts = tk.words(data, offsets)
    hashes = tk.Spans(data, tk.LOWER).hash(starts, ends)
    row = tk.rows_of(counts)
    n = len(hashes)
    begins = np.cumsum(counts) - counts
    place = np.arange(n) - begins[row]
    at = np.flatnonzero((place + width <= counts[row]) | ((place == 0) & (counts[row] < width)))
    size = np.minimum(counts[row[at]], width)
    key = tk.mix(size.astype(np.uint64))
    for step in range(width):
        inside = size > step
        key[inside] = tk.mix(key[inside] * np.uint64(3) + hashes[at[inside] + step])
    row, key, _ = tk.distinct(row[at], key)
    return row, key


def signatures(row: np.ndarray, key: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of the sets of n rows, given distinct (row, key) in row order; rows without elements are all ones.

    A value is step * 2^32 + a random part, so the order is by step first.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(n * places, top, dtype=np.uint64)
    for low in range(0, len(row), 1 << 15):  # bounds the permutations in memory; later elements stop earlier
        r, k = row[low : low + (1 << 15)], key[low : low + (1 << 15)]
        permutation = np.broadcast_to(np.arange(places, dtype=np.int16), (len(r), places)).copy()
        highest = (values.reshape(n, places).max(axis=1) >> np.uint64(32)).astype(np.int64)
        alive = np.arange(len(r))
        for step in range(places):
            alive = alive[highest[r[alive]] >= step]
            if not len(alive):
                break
            random = tk.mix(k[alive] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            swap = step + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
            here = permutation[alive, swap]
            permutation[alive, swap] = permutation[alive, step]
            np.minimum.at(values, r[alive] * places + here, np.uint64(step << 32) | (random >> np.uint64(32)))
            touched = np.unique(r[alive])
            highest[touched] = np.minimum((values.reshape(n, places)[touched].max(axis=1) >> np.uint64(32)), np.uint64(1 << 31)).astype(np.int64)
    return values.reshape(n, places)


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = values.shape[1] // bands
    parts = tk.mix(values).reshape(len(values), bands, rows)
    key = tk.mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(values), bands)))
    for k in range(rows):
        key = tk.mix(key * np.uint64(3) + parts[:, :, k])
    return key.view(np.int64)


def set_names(row: np.ndarray, key: np.ndarray, n: int) -> list[bytes | None]:
    """A 16-byte name for each row's set; null for an empty one."""
    parts = []
    for salt in (1, 2):
        total = np.append(np.uint64(0), np.cumsum(tk.mix(key + np.uint64(salt))))
        at = np.searchsorted(row, np.arange(n + 1))
        parts.append(tk.mix(total[at[1:]] - total[at[:-1]] + np.uint64(salt)))
    sizes = tk.per_row(row, n)
    both = np.stack(parts, axis=1).astype(">u8").tobytes()
    return [both[16 * i : 16 * i + 16] if sizes[i] else None for i in range(n)]


def profiles(row: np.ndarray, key: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """How many elements of each set fall into each slot; 255 means any number from 255."""
    slot = ((key >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
    return np.minimum(np.bincount(row * slots + slot, minlength=n * slots), 255).astype(np.uint8).reshape(n, slots)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements with these profiles can have 100 * intersection >= percent * union."""
    most = np.where((np.minimum(x, y) == 255).any(axis=-1), np.minimum(n, m), np.minimum(x, y).sum(axis=-1, dtype=np.int64))
    most = np.minimum(most, np.minimum(n, m))
    return 100 * most >= percent * (n + m - most)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, n, cls, bands, signature, profile): the class, bucket keys, 16-bit signature places and profile of each row."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(2)):
                n = last - first
                row, key = shingles(data, offsets, width)
                values = signatures(row, key, n)
                keys, cls = band_keys(values), set_names(row, key, n)
                short = (tk.mix(values) & np.uint64(0xFFFF)).astype("<u2")
                sizes, slots = tk.per_row(row, n), profiles(row, key, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(sizes.astype(np.int64)), pa.array(cls, pa.binary()), _lists(keys.ravel(), np.full(n, keys.shape[1])), *(pa.array([x[i].tobytes() for i in range(n)], pa.binary()) for x in (short, slots))],
                    ["id", "text_hash", "n", "cls", "bands", "signature", "profile"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return kept.mapInArrow(run, "id long, text_hash long, n long, cls binary, bands array<long>, signature binary, profile binary")


def full_sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(cls, elements): the sorted set of each row."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(0)):
                row, key = shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(row, key, last - first), pa.binary()), _lists(key.view(np.int64), tk.per_row(row, last - first))], ["cls", "elements"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "cls binary, elements array<long>")


def _agree(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    return (x == y).sum(axis=-1) >= least


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _likely(pairs: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose signatures agree in so many places and whose profiles allow a link."""
    place = classes.select("cls", F.struct("signature", "profile", "n").alias("x"))
    both = pairs.join(place.select(F.col("cls").alias("a"), F.col("x")), "a").join(place.select(F.col("cls").alias("b"), F.col("x").alias("y")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(k).flatten() for k in (2, 3))
                mask = _agree(_rows(x[0], "<u2"), _rows(y[0], "<u2"), least)
                mask &= possible(_rows(x[1], "u1"), _rows(y[1], "u1"), x[2].to_numpy(), y[2].to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), batch.column(1).filter(pa.array(mask))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * intersection >= percent * union on full sets."""
    pairs = written(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = written(classes.join(ends, "cls", "left_semi").select("text_hash").distinct(), "wanted")
    texts = docs.withColumn("__driftline_hash", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    texts = texts.join(small_or_shuffled(wanted.withColumnRenamed("text_hash", "__driftline_hash"), wanted.count(), BROADCAST_TEXTS), "__driftline_hash", "left_semi")
    sets = written(full_sets(texts, text_col, width).where(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("elements").alias("elements")), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.searchsorted(x.view(np.uint64), y.view(np.uint64))
                    shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "confirmed")


def _across(buckets: DataFrame, least: int, percent: int) -> DataFrame:
    """Likely pairs of different components inside each bucket of (band, cls, root, signature, profile, n, bands), block against block."""
    # only buckets of several blocks need their number, and they are few: a block has BLOCK classes
    large = written(buckets.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where(F.col("blocks") > 1), "large-buckets")
    dealt = buckets.join(small_or_shuffled(large, large.count(), BROADCAST_TEXTS), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    part = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    # block i meets block j <= i: each class goes to the meetings of its own block with all blocks
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.greatest("part", "other").alias("i"), F.least("part", "other").alias("j"), "part", "cls", "root", "signature", "profile", "n", "bands")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part, n, band = table.column("part").to_numpy(), table.column("n").to_numpy(), table.column("band")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cls, root = np.array(table.column("cls").to_pylist(), dtype=object), np.array(table.column("root").to_pylist(), dtype=object)
        place, slots = _rows(table.column("signature"), "<u2"), _rows(table.column("profile"), "u1")
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        found: tuple[list, list] = ([], [])
        right = np.flatnonzero(part == j)
        for x in np.flatnonzero(part == i):
            y = right[right > x] if i == j else right
            y = y[root[y] != root[x]]
            y = y[_agree(place[y], place[x], least)]
            y = y[possible(slots[y], slots[x], n[y], n[x], percent)]
            y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == band]
            for other in cls[y]:
                found[0].append(min(cls[x], other))
                found[1].append(max(cls[x], other))
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    return dealt.groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = SIMILARITY) -> DataFrame:
    """(id, n, component_id) of each row: the size of its set and the smallest id that it reaches."""
    rows = written(sketches(docs, id_col, text_col, width), "sketches")
    # a text stands for its class; all texts of a class have the same bands and signature
    classes = written(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.struct("text_hash", "n", "bands", "signature", "profile")).alias("x")).select("cls", "x.*"), "classes")
    s = percent / 100
    least = max(1, math.floor(PLACES * s - 5 * math.sqrt(PLACES * s * (1 - s))))
    banded = classes.select("cls", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("cls").alias("a"), F.count("*").alias("size")).where(F.col("size") > 1).drop("size")
    buckets = written(banded.join(hubs, "band"), "buckets")
    tries = buckets.where(F.col("a") != F.col("cls")).select("a", F.col("cls").alias("b")).distinct()
    links = confirmed(_likely(tries, classes, least, percent), classes, docs, text_col, width, percent)
    roots = written(components(links), "roots")

    rooted = buckets.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("band")
    mixed = written(mixed, "mixed")
    rest = rooted.join(small_or_shuffled(mixed, mixed.count(), BROADCAST_TEXTS), "band", "left_semi").join(classes.select("cls", "signature", "profile", "n", "bands"), "cls")
    tried = written(tries, "tried")
    more = written(_across(rest, least, percent).distinct().join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        added = confirmed(more, classes, docs, text_col, width, percent)
        roots = written(components(links.unionByName(added)), "roots")

    named = rows.select("id", "n", "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("id", "n", F.coalesce("root", "cls").alias("root"))
    named = written(named, "named")
    smallest = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("rows"))
    # written, so that both sides of the join come straight from an exchange and a component with many rows can be split
    grouped = written(smallest.where(F.col("rows") > 1).drop("rows"), "grouped")
    return named.join(grouped, "root", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))


def query(spark, sf_dir):
    """op3: the near-duplicate component of every document, on sets of 4-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
