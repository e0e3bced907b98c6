"""Toxicity by a counterfactually regularised linear classifier.

Features are words (runs of letters, lower-cased) and their beginnings.  The model is
a logistic regression with a further penalty: identity terms in labelled sentences
are swapped for others, and the squared change of the score is added to the loss, so
that the model learns not to lean on group mentions.  All terms and their beginnings
are features.  Sentences without a term get one in place of their middle word; of all
sentences of the sample, at most ``most_pairs`` enter the penalty, those with a term
first, then by a hash.  A term that no labelled text holds has no weight but by its
beginnings; swaps for it then change little, and the penalty has little to do.

Null and empty texts get the score of no features.  Without labels, or with labels
of one class only, all texts get the same score (0.5 without labels).  Repeated rows
score alike; a null id stays null; labels of one document that disagree count as 1.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import linear
from driftline.llm import textkernel as tk
from driftline.llm.shared import remainder, table

# Identity terms that may be swapped for one another, by language.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "transgender", "asians", "africans", "europeans", "mexicans", "moroccans", "teenagers", "pensioners", "disabled", "deaf", "blind"),
    ("frauen", "männer", "muslime", "christen", "juden", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "homosexuelle", "asiaten", "afrikaner", "europäer", "jugendliche", "rentner", "behinderte"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "immigrés", "réfugiés", "homosexuels", "asiatiques", "africains", "européens", "adolescents", "retraités", "handicapés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "budistas", "ateos", "inmigrantes", "refugiados", "homosexuales", "asiáticos", "africanos", "europeos", "adolescentes", "jubilados", "discapacitados"),
)
BEGINNINGS = (3, 4, 5, 6, 8)
SWAP_PENALTY = 10.0
#: Sentences that counterfactuals are made of, at most.
MOST_PAIRS = 4000
RIDGE = 1e-4
#: Standard errors that a feature's class log ratio must be from 0.
LEAST_TELLS = 2.5
STEPS = 250

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1; all but letters become spaces."""
    out = np.where(_LETTER[data], tk.LOWER[data], 32).astype(np.uint8)
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _folded(data)
    starts, ends, counts = tk.words(data, offsets)
    spans = tk.Spans(data)
    key = spans.hash(starts, ends)
    # each different word of a text once
    row, _, at = _first(tk.rows_of(counts), key)
    starts, ends = starts[at], ends[at]
    rows, keys = [row], [key[at]]
    for size in BEGINNINGS:
        long = np.flatnonzero(ends - starts > size)
        rows.append(row[long])
        keys.append(tk.mix(spans.hash(starts[long], starts[long] + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(keys)


def _first(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs and the place of one item of each."""
    joint = tk.mix(key + tk.mix(row.astype(np.uint64)))
    _, at = np.unique(joint, return_index=True)
    return row[at], key[at], at


def term_features(groups=IDENTITY_TERMS) -> np.ndarray:
    """Keys of the terms and their beginnings."""
    data, offsets = tk.buffers(pa.array([t for g in groups for t in g], pa.large_string()))
    return word_features(data, offsets)[1]


def counterfactuals(texts: list[str], groups=IDENTITY_TERMS) -> list[tuple[bool, int, str, str]]:
    """For each sentence: whether it names a term, its hash, and two sentences that differ in one term, chosen by the hash."""
    group_of = {t: g for g in groups for t in g}
    named = re.compile(r"\b(" + "|".join(map(re.escape, sorted(group_of, key=len, reverse=True))) + r")\b", re.IGNORECASE)
    out = []
    for text in texts:
        for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
            raw = sentence.encode()
            pick = zlib.crc32(raw) << 31 | zlib.crc32(raw, 7) >> 1
            if hit := named.search(sentence):
                group, own = group_of[hit[0].lower()], hit[0].lower()
                others = [t for t in group if t != own]
                other = others[pick % len(others)]
                out.append((True, pick, sentence, named.sub(lambda m: m[0] if m[0].lower() not in group else other, sentence)))
            elif words := sentence.split():
                group = groups[pick % len(groups)]
                at = pick // 8 % len(group)
                middle = len(words) // 2
                pair = (group[at], group[(at + 1 + pick // 1024 % (len(group) - 1)) % len(group)])
                out.append((False, pick, *(" ".join([*words[:middle], term, *words[middle + 1 :]]) for term in pair)))
    return out


def _matrix(keys: np.ndarray, texts: list[str]) -> np.ndarray:
    """row << 32 | feature of some texts."""
    found = [np.zeros(0, dtype=np.int64)]
    for first, _, data, offsets in tk.chunks(pa.array(texts, pa.large_string())):
        r, a = linear.lookup(keys, *word_features(data, offsets))
        found.append((r + first) << 32 | a)
    return np.concatenate(found)


@dataclass
class Pairs:
    """Features that only one sentence of a pair has: the pair, the feature, and 1 or -1 for its side."""

    row: np.ndarray
    at: np.ndarray
    sign: np.ndarray
    count: int


def pairs_of(sample: DataFrame, keys: np.ndarray, groups=IDENTITY_TERMS, most: int = MOST_PAIRS) -> Pairs:
    """The pairs of the sample's sentences, made in tasks; only their differences in features come to the driver."""
    known = sample.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        for batch in batches:
            made = sorted(set(counterfactuals(batch.column(0).to_pylist(), groups)), key=lambda x: (not x[0], *x[1:]))[:most]
            a, b = (_matrix(known.value, [x[k] for x in made]) for k in (2, 3))
            columns = [pa.array([x[k] for x in made], t) for k, t in ((0, pa.bool_()), (1, pa.int64()))]
            for only in (np.setdiff1d(a, b), np.setdiff1d(b, a)):
                ends = np.append(0, np.cumsum(tk.per_row(only >> 32, len(made))))
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((only & 0xFFFFFFFF).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["named", "pick", "first", "second"])

    found = sample.select("text").mapInArrow(run, "named boolean, pick long, first array<int>, second array<int>").distinct()
    rows = found.orderBy(F.col("named").desc(), "pick", "first", "second").limit(most).collect()
    sides = [(i, at, sign) for i, r in enumerate(rows) for sign, name in ((1.0, "first"), (-1.0, "second")) for at in r[name]]
    row, at, sign = zip(*sides, strict=True) if sides else ((), (), ())
    return Pairs(np.array(row, dtype=np.int64), np.array(at, dtype=np.int64), np.array(sign, dtype=float), len(rows))


def fit(sample: linear.Sample, pairs: Pairs, swap_penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic regression, by full-batch Adam."""
    n, m = len(sample.keys), len(sample.y)
    if not m or sample.y.min() == sample.y.max():
        return np.zeros(n), linear.platt(np.zeros(m), sample.y, sample.weight)[1]
    row = np.repeat(np.arange(m), np.diff(sample.start))
    weight = sample.weight / sample.weight.sum()
    w, b = np.zeros(n), 0.0
    mean, square, mean_b, square_b = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):
        error = weight * (linear.sigmoid(sample.dot(w) + b) - sample.y)
        change = np.bincount(pairs.row, weights=pairs.sign * w[pairs.at], minlength=max(1, pairs.count))
        gradient = np.bincount(sample.index, weights=error[row], minlength=n) + ridge * w
        gradient += swap_penalty * np.bincount(pairs.at, weights=pairs.sign * change[pairs.row], minlength=n) / max(1, pairs.count)
        down = error.sum()
        rate = 0.1 * min(1.0, 2 * (1 - (step - 1) / steps))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
        mean_b, square_b = 0.9 * mean_b + 0.1 * down, 0.99 * square_b + 0.01 * down * down
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (mean / c1) / (np.sqrt(square / c2) + 1e-8)
        b -= rate * (mean_b / c1) / (np.sqrt(square_b / c2) + 1e-8)
    return w, float(b)


def learned(docs: DataFrame, labels: DataFrame, usable=None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", groups=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY, most_labelled: int = linear.MOST_LABELLED, most_pairs: int = MOST_PAIRS, most_features: int | None = linear.MOST_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(keys, weights, bias), learned from label rows that fit ``usable``."""
    picked = linear.labelled(docs, labels, label, F.lit(True) if usable is None else usable, id_col, text_col, most_labelled)
    sample = linear.gather(picked, word_features, most_features=most_features, least_tells=LEAST_TELLS, always=term_features(groups))
    weights, bias = fit(sample, pairs_of(picked, sample.keys, groups, most_pairs), swap_penalty)
    return sample.keys, weights, bias


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score) of each row; options are those of ``learned``."""
    keys, weights, bias = learned(docs, labels, usable, id_col=id_col, text_col=text_col, **options)
    return linear.score_texts(docs, word_features, keys, weights, None, 1.0, bias, id_col, text_col)


def clean_documents(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows whose score is under the threshold, with all their columns; scored and kept in one pass, without a shuffle."""
    keys, weights, bias = learned(docs, labels, usable, id_col=id_col, text_col=text_col, **options)
    return linear.rows_under(docs, word_features, keys, weights, bias, text_col, threshold)


def query(spark, sf_dir):
    """op1: the toxicity of every document, learned from rows whose crc32 modulo 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity_scores(docs, labels, remainder("doc_id", 5) != 0).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
