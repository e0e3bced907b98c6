"""Ranked lexical search: MaxScore over the shards of an inverted index.

Terms are maximal runs of the characters other than ``[\\x00-/:-@[-`{-\\x7F]`` in the whole
text, with A-Z lower-cased only.  Each task that reads documents writes shards of an index:
the documents with a term, their lengths, and for each term its postings (place in the
shard, occurrences), by place.  An index may be held to the terms of the queries, as the
query here does, or hold all terms.

Totals and document frequencies are summed over all shards, so scores are those of the whole
table.  A posting's impact is an integer, (10^9 tf) div (1000 tf + 12 m) with
m = 75 + (25 n N) div L, and a document's score the sum of weight * impact over a query's
terms.  In a shard, a term's upper bound is its weight times its greatest impact there.
Terms are sorted by bound; the last ones whose bounds sum to less than the k-th best
score so far are non-essential: a document in none of the other lists cannot qualify.
Only lists of essential terms are read through.  The postings of non-essential ones are
probed for the candidates, list by list, while a candidate's score and the bounds still to
come can reach the k-th best.  A task carries each query's k best from shard to shard and
gives only those, so little is shuffled.

Queries go to all tasks, in blocks of about ``most_pairs`` (query, term) pairs, one block
after the other.  Of equal scores the smaller id comes first, and a null id last.  Null and
empty texts have no terms: such documents count nowhere, and such queries find nothing.
Repeated documents each take a rank; repeated queries are answered each.  Other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.shared import written

TOP = 20
#: Documents and postings of a shard, at most (a document's postings are not parted).
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
#: (query, term) pairs of a block of queries, on average.
MOST_PAIRS = 200_000
#: Groups of tasks whose results are ranked before all of a query meet.
RANK_GROUPS = 64
SCALE, LENGTH_PART, LENGTH_BASE, SATURATION = 1_000_000_000, 25, 75, 12
_LAST = np.iinfo(np.int64).max

_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8; bytes of other characters than ASCII all belong to terms."""
    return (text or b"").translate(_FOLD).split()


class Shard:
    """A shard in the making."""

    def __init__(self, vocabulary: dict[bytes, int] | None):
        self.fixed, self.numbers = vocabulary is not None, vocabulary or {}
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.held, self.found, self.counts = [], [], [], [], []
        if not self.fixed:
            self.numbers = {}

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms(text)
        if not words:
            return
        if self.fixed:
            counts = Counter(map(self.numbers.get, words))
            counts.pop(None, None)
        else:
            counts = Counter(self.numbers.setdefault(w, len(self.numbers)) for w in words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.held.append(len(counts))
        self.found.extend(counts.keys())
        self.counts.extend(counts.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.found) >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        """The shard as a row: its postings by term, then place."""
        term, place = np.array(self.found, dtype=np.int64), np.repeat(np.arange(len(self.held), dtype=np.int32), self.held)
        order = np.argsort(term, kind="stable")
        number, first = np.unique(term[order], return_index=True)
        names = {n: w for w, n in self.numbers.items()}
        lists = {
            "ids": pa.array(self.ids, pa.int64()), "lengths": pa.array(self.lengths, pa.int64()), "terms": pa.array([names[n] for n in number.tolist()], pa.binary()),
            "sizes": pa.array(np.diff(np.append(first, len(term))).astype(np.int64)), "places": pa.array(place[order]), "counts": pa.array(np.array(self.counts, dtype=np.int64)[order]),
        }
        columns = [pa.array([len(self.ids)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()]
        return pa.RecordBatch.from_arrays(columns, ["docs", "tokens", *lists])


def index(docs: DataFrame, vocabulary: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of an index over all documents, written to the shared folder; of all terms, or of those given."""
    held = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)})

    def run(batches):
        shard = Shard(held.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.full():
                    yield shard.row()
                    shard.clear()
        if shard.ids:
            yield shard.row()

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = "docs long, tokens long, ids array<long>, lengths array<long>, terms array<binary>, sizes array<long>, places array<int>, counts array<long>"
    return written(kept.mapInArrow(run, schema), "lexical-index", "zstd")


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, id, term, repeats) of each query, numbered and written once."""

    def run(batches):
        for batch in batches:
            found = [(q, i, w, n) for q, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, n in Counter(terms(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["query", "id", "term", "repeats"])

    kept = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return written(kept.mapInArrow(run, "query long, id long, term binary, repeats long"), "query-terms")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def max_score(lists: list[tuple[int, int, np.ndarray, np.ndarray]], score: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a shard's documents that may be among the k best, given that k of at least ``least`` are known.

    A list is (greatest score, weight, places, impacts); ``score`` is zero for each document, and is so again afterwards.
    """
    lists = sorted(lists, key=lambda x: -x[0])
    rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0).tolist()
    least, done = max(least, 1), 0
    while done < len(lists) and rest[done] >= least:
        _, w, places, impacts = lists[done]
        score[places] += w * impacts
        done += 1
        # the k-th best of the scores so far is reached by k documents at least; looked for after 1, 2, 4 ... lists
        if done & (done - 1) == 0 and len(score) > k:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
    touched = np.flatnonzero(score)
    among = touched
    for later in range(done, len(lists)):
        among = among[score[among] + rest[later] >= least]
        if not len(among):
            break
        _, w, places, impacts = lists[later]
        at = np.minimum(np.searchsorted(places, among), len(places) - 1)
        hit = places[at] == among
        score[among[hit]] += w * impacts[at[hit]]
    among = among[score[among] >= least]
    if len(among) > k:
        found = score[among]
        among = among[found >= np.partition(found, len(found) - k)[len(found) - k]]
    found = score[among].copy()
    score[touched] = 0
    return among, found


def ranked(shards: DataFrame, of_term: dict[bytes, list[tuple[int, int]]], n: int, tokens: int, top: int) -> DataFrame:
    """(query, doc_id, score, task): the best documents of each query in each task; of_term gives a term's queries and weights there."""
    held = shards.sparkSession.sparkContext.broadcast(of_term)

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, names, sizes, places, counts = (batch.column(name)[i].values for name in ("ids", "lengths", "terms", "sizes", "places", "counts"))
                missing = np.asarray(ids.is_null())
                ids = ids.fill_null(_LAST).to_numpy()
                m = LENGTH_BASE + LENGTH_PART * lengths.to_numpy() * n // tokens
                places, tf, ends = places.to_numpy(), counts.to_numpy(), np.cumsum(sizes.to_numpy())
                impacts = SCALE * tf // (1000 * tf + SATURATION * m[places])
                found: dict[int, list] = {}
                for name, low, high in zip(names.to_pylist(), (ends - sizes.to_numpy()).tolist(), ends.tolist(), strict=True):
                    for query, w in held.value.get(name, ()):
                        found.setdefault(query, []).append((w * int(impacts[low:high].max()), w, places[low:high], impacts[low:high]))
                score = np.zeros(len(ids), dtype=np.int64)
                for query, lists in found.items():
                    known = best.get(query)
                    least = int(known[0][-1]) if known is not None and len(known[0]) == top else 1
                    at, scores = max_score(lists, score, top, least)
                    if not len(at):
                        continue
                    new = scores, missing[at], ids[at]
                    both = new if known is None else tuple(map(np.concatenate, zip(known, new, strict=True)))
                    order = np.lexsort((both[2], both[1], -both[0]))[:top]
                    best[query] = tuple(x[order] for x in both)
        task = TaskContext.get().partitionId()
        for query, (scores, missing, ids) in best.items():
            size = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([query] * size, pa.int64()), pa.array(ids, mask=missing), pa.array(scores), pa.array([task] * size, pa.int64())], ["query", "doc_id", "score", "task"])

    return shards.mapInArrow(run, "query long, doc_id long, score long, task long")


def _first(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, weigh: Callable[[int, int], int] = weight) -> DataFrame:
    """(query, id, rank, doc_id, score) of the best documents of each query."""
    pairs = written(query_terms(queries, query_id, text_col), "query-pairs")
    blocks, found = max(1, -(-pairs.count() // most_pairs)), None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        held = mine.select("query", "term", "repeats").toArrow().to_pylist()
        vocabulary = sorted({r["term"] for r in held})
        shards = index(docs, vocabulary, doc_id, text_col)
        total = shards.agg(F.sum("docs").alias("n"), F.sum("tokens").alias("tokens")).first()
        df = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df"))
        known = {r["term"]: r["df"] for r in df.toArrow().to_pylist()}
        of_term: dict[bytes, list[tuple[int, int]]] = {}
        for r in held:
            if r["term"] in known and (w := weigh(total["n"], known[r["term"]]) * r["repeats"]) > 0:
                of_term.setdefault(r["term"], []).append((r["query"], w))
        part = ranked(shards, of_term, total["n"] or 0, total["tokens"] or 1, top)
        found = part if found is None else found.unionByName(part)
    grouped = _first(found.withColumn("group", F.pmod("task", F.lit(RANK_GROUPS))), top, "query", "group")
    names = pairs.select("query", "id").distinct()
    return _first(grouped.select("query", "doc_id", "score"), top, "query").join(names, "query").select("query", "id", "rank", "doc_id", "score")


def query(spark, sf_dir):
    """op13: the 20 best of all documents for each item of benchmark."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY doc_id
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM lengths
), counted AS (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term, docs
), asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
