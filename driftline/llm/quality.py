"""Quality by naive Bayes support vectors.

N-gram indicators (words, word pairs, and the same of word shapes: letter case,
digits and marks with runs squeezed) are scaled by the class log-count ratio and
each text to unit length; a linear hinge-loss model is fitted by dual coordinate
descent, and its margins become probabilities by a logistic fit that gives the
sampled classes their true sizes.

Null and empty texts get the score of no features.  Without labels, or with labels
of one class only, all texts get the same score (0.5 without labels).  Repeated rows
score alike, and teach as one; a null id stays null; labels of one document that disagree count as 1.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import linear
from driftline.llm import textkernel as tk
from driftline.llm.shared import remainder, table

ALPHA = 1.0
COST = 1.0
EPOCHS = 20

#: What a byte looks like: upper case A, lower case (and all non-ASCII) a, digit 0, marks themselves.
_LOOK = np.arange(256, dtype=np.uint8)
_LOOK[65:91], _LOOK[97:123], _LOOK[48:58], _LOOK[128:] = 65, 97, 48, 97


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    look = _LOOK[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = look[1:] != look[:-1]
    new[starts] = True
    place = np.append(0, np.cumsum(new))
    return tk.Spans(look[new]).hash(place[starts], place[ends])


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = tk.words(data, offsets)
    row = tk.rows_of(counts)
    found = [tk.Spans(data, tk.LOWER).hash(starts, ends), tk.mix(shapes(data, starts, ends) + np.uint64(11))]
    pair = np.flatnonzero(row[1:] == row[:-1])
    pairs = [tk.mix(tk.mix(key[pair]) + key[pair + 1]) for key in found]
    return np.concatenate([row, row, row[pair], row[pair]]), np.concatenate([*found, *pairs])


def dual_coordinate_descent(start: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, n: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of an L1-loss support vector machine on sparse rows; y is -1 or 1."""
    w, alpha = np.zeros(n + 1), np.zeros(len(y))
    rows = [(index[a:b], value[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
    norm = np.array([1.0 + float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            at, v = rows[i]
            gradient = y[i] * (float(w[at] @ v) + w[n]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                w[n] += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def fit(sample: linear.Sample) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(weights, squared scales, slope, intercept) over the sample's features."""
    p, q = ALPHA + sample.positive, ALPHA + sample.negative
    ratio = np.log(p / p.sum()) - np.log(q / q.sum()) if len(p) else p
    square = ratio * ratio
    length = np.sqrt(np.maximum(linear.row_sums(sample.start, square[sample.index]), 1e-12))
    value = ratio[sample.index] / np.repeat(length, np.diff(sample.start))
    if not len(sample.y) or sample.y.min() == sample.y.max():
        return np.zeros(len(ratio)), square, *linear.platt(np.zeros(len(sample.y)), sample.y, sample.weight)
    sides = np.where(sample.y == 1, 1.0, -1.0)
    halves = np.arange(len(sides)) % 2
    weight = sample.weight / sample.weight.mean()

    def margins(w, chosen):
        return (linear.row_sums(sample.start, w[sample.index] * value) + w[-1])[chosen]

    def part(chosen):
        keep = np.flatnonzero(chosen)
        start = np.append(0, np.cumsum(np.diff(sample.start)[keep]))
        at = np.concatenate([np.arange(sample.start[i], sample.start[i + 1]) for i in keep]) if len(keep) else np.zeros(0, dtype=np.int64)
        return dual_coordinate_descent(start, sample.index[at], value[at], sides[keep], len(ratio), np.full(len(keep), COST))

    # margins of rows that a half's model has not seen
    unseen = np.zeros(len(sides))
    for half in (0, 1):
        unseen[halves == half] = margins(part(halves != half), halves == half)
    slope, intercept = linear.platt(unseen, sample.y, weight)
    w = part(np.ones(len(sides), dtype=bool))
    return w[:-1] * ratio, square, slope, intercept + slope * w[-1]


def quality_scores(docs: DataFrame, labels: DataFrame, usable=None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_labelled: int = linear.MOST_LABELLED, most_features: int | None = linear.MOST_FEATURES) -> DataFrame:
    """(id, score) of each row; only label rows that fit ``usable`` are learned from."""
    picked = linear.labelled(docs, labels, label, F.lit(True) if usable is None else usable, id_col, text_col, most_labelled)
    sample = linear.gather(picked, ngrams, most_features=most_features)
    weights, norms, slope, bias = fit(sample)
    return linear.score_texts(docs, ngrams, sample.keys, weights, norms, slope, bias, id_col, text_col)


def query(spark, sf_dir):
    """op7: the quality of every document, learned from rows whose crc32 modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_scores(docs, labels, remainder("doc_id", 3) != 1).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
