"""Linear text classifiers: a bounded labelled sample, its features, and scores for all texts.

Features are 64-bit hashes; a text has each of its features once.  The sample holds
at most ``most`` labelled documents, half of them of either class if there are so many,
picked by a hash of the id; of rows with one id it takes the text of the least hash, so
that repeated rows add nothing.  The model is a table of at most ``most_features``
weights, or as many as the bounded sample has, so its size has a bound and it goes to
all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import textkernel as tk
from driftline.llm.shared import written

#: Labelled documents that a model is fitted on, at most.
MOST_LABELLED = 8000
#: Features of a model, those that tell most; None takes all of the sample.
MOST_FEATURES = 1 << 16
LEAST_TEXTS = 4


@dataclass
class Sample:
    """Rows in compressed form: the features of row i are index[start[i]:start[i+1]]."""

    keys: np.ndarray
    positive: np.ndarray
    negative: np.ndarray
    y: np.ndarray
    index: np.ndarray
    start: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return row_sums(self.start, w[self.index])


def row_sums(start: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values))
    return total[start[1:]] - total[start[:-1]]


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable, id_col: str, text_col: str, most: int) -> DataFrame:
    """(doc_id, text, y, share) of the sampled rows; share is the part of its class that the sample holds."""
    known = labels.where(F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    known = written(known, "known-labels")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = None
    for y, n in sizes.items():
        take = max(most // 2, most - sum(v for k, v in sizes.items() if k != y))
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take).withColumn("share", F.lit(min(1.0, take / n)))
        picks = part if picks is None else picks.unionByName(part)
    if picks is None:
        picks = known.withColumn("share", F.lit(1.0))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(picks), "doc_id").groupBy("doc_id", "y", "share").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    return written(met.select("doc_id", F.col("least.text").alias("text"), "y", "share"), "labelled")


def gather(sample: DataFrame, features, least_texts: int = LEAST_TEXTS, most_features: int | None = MOST_FEATURES, least_tells: float = 0.0, always: np.ndarray | None = None) -> Sample:
    """Counts features by class, selects those that tell most (by log ratio in standard errors), and brings the sample's rows in them to the driver.

    The few keys of ``always`` are features whatever they tell.  Rows come in the order of
    their ids' hashes, whatever the files.
    """

    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in tk.chunks(batch.column(0)):
                row, key, _ = tk.distinct(*features(data, offsets))
                found, at = np.unique(key, return_inverse=True)
                positive = np.bincount(at, weights=y[first:last][row] == 1, minlength=len(found)).astype(np.int64)
                total = np.bincount(at, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(positive), pa.array(total - positive)], ["key", "positive", "negative"])

    counted = sample.select("text", "y").mapInArrow(count, "key long, positive long, negative long").groupBy("key").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    texts = sample.groupBy("y").count().collect()
    of = {r["y"]: r["count"] for r in texts}
    p, q = F.col("positive") + 0.5, F.col("negative") + 0.5
    ratio = F.log(p / (of.get(1, 0) + 1.0)) - F.log(q / (of.get(0, 0) + 1.0))
    # a log ratio in units of its standard error
    tells = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    best = counted.where((F.col("positive") + F.col("negative") >= least_texts) & (tells >= least_tells))
    best = (best if most_features is None else best.orderBy(tells.desc(), "key").limit(most_features)).toPandas()
    if always is not None and len(always):
        wanted = sample.sparkSession.createDataFrame([(int(k),) for k in np.unique(always).view(np.int64)], "key long")
        forced = F.broadcast(wanted).join(counted, "key", "left").select("key", F.coalesce("positive", F.lit(0)).alias("positive"), F.coalesce("negative", F.lit(0)).alias("negative"))
        best = pd.concat([best, forced.toPandas()]).drop_duplicates("key", ignore_index=True)
    keys = best["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    spark = sample.sparkSession
    known = spark.sparkContext.broadcast(keys)

    def rows(batches):
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(0)):
                row, at = lookup(known.value, *features(data, offsets))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tk.per_row(row, last - first))).astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, last - first) for k in (1, 2, 3)] + [lists], ["doc_id", "y", "share", "at"])

    held = sample.select("text", "doc_id", "y", "share").mapInArrow(rows, "doc_id long, y int, share double, at array<int>").collect()
    held.sort(key=lambda r: (hash_of(r["doc_id"]), r["doc_id"], r["at"]))
    start = np.append(0, np.cumsum([len(r["at"]) for r in held])).astype(np.int64)
    index = np.fromiter((i for r in held for i in r["at"]), dtype=np.int64, count=int(start[-1]))
    y, share = np.array([r["y"] for r in held], dtype=np.int64), np.array([r["share"] for r in held], dtype=float)
    return Sample(keys, best["positive"].to_numpy(dtype=float)[order], best["negative"].to_numpy(dtype=float)[order], y, index, start, 1 / share)


def hash_of(number: int) -> int:
    return int(tk.mix(np.array([number], dtype=np.int64).view(np.uint64))[0])


def lookup(keys: np.ndarray, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in keys) of the (row, key) pairs whose key is known, in row order."""
    if not len(keys) or not len(row):
        return row[:0], np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    pair = np.unique((row[hit].astype(np.int64) << 32) | at[hit])
    return pair >> 32, pair & 0xFFFFFFFF


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept that make margins probabilities, by Newton steps on a smoothed target."""
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0 if not len(y) else (4.0 if y[0] == 1 else -4.0)
    n1, n0 = (weight * (y == 1)).sum(), (weight * (y == 0)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        haa, hab, hbb = (h * margin * margin).sum() + 1e-6, (h * margin).sum(), h.sum() + 1e-6
        ga, gb = (g * margin).sum(), g.sum()
        det = haa * hbb - hab * hab
        step_a, step_b = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - step_a, b - step_b
        if abs(step_a) + abs(step_b) < 1e-9:
            break
    return float(a), float(b)


def score_texts(docs: DataFrame, features, keys: np.ndarray, weights: np.ndarray, norms: np.ndarray | None, slope: float, bias: float, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of each row: sigmoid(slope * sum of weights + bias), the sum divided by the root of the sum of norms if given."""
    model = docs.sparkSession.sparkContext.broadcast((keys, weights, norms))

    def run(batches):
        keys, weights, norms = model.value
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(1)):
                row, at = lookup(keys, *features(data, offsets))
                n = last - first
                total = tk.per_row(row, n, weights[at])
                if norms is not None:
                    total = total / np.sqrt(np.maximum(tk.per_row(row, n, norms[at]), 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sigmoid(slope * total + bias))], ["id", "score"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, score double")


def rows_under(docs: DataFrame, features, keys: np.ndarray, weights: np.ndarray, bias: float, text_col: str, threshold: float) -> DataFrame:
    """The rows of docs, as they are, whose sigmoid(bias + sum of weights) is under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast((keys, weights))
    place = docs.columns.index(text_col)

    def run(batches):
        keys, weights = model.value
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(place)):
                row, at = lookup(keys, *features(data, offsets))
                score = sigmoid(tk.per_row(row, last - first, weights[at]) + bias)
                yield batch.slice(first, last - first).filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
