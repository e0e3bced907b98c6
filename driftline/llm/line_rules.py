"""Quality rules with cross-document line frequency.

Each line with a word is normalised (A-Z lower-cased, words joined by one space)
and hashed, and so is the whole text.  Per host, the different texts that hold a line
are counted; copies of a text are one, whatever their case and spaces.  A line is
boilerplate if over ``max_docs`` different texts of the host, and over ``max_share``
of all its different texts, hold it.  A document is
depleted, and rejected, if less than ``min_left`` of its words is left without
these lines.  Documents that fail the base counts are rejected as well.

Null texts are empty and fail the base (no words); null hosts form one host of
their own; repeated rows count as documents of their own; an empty table gives an
empty result.  Columns besides the id, text and host are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import textkernel as tk
from driftline.llm.shared import BROADCAST_ROWS, numbered, small_or_shuffled, written

MAX_DOCS = 20
#: The count of a host of 1,000 texts as a share; larger hosts follow it.
MAX_SHARE = 0.02
MIN_LEFT = 0.3
#: Boilerplate lines up to this number are broadcast (about 16 bytes each); beyond it the join shuffles.
BROADCAST_LINES = 200_000

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _sequences(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * tk._power(tk._BASE, len(hashes)), out=total[1:])
    return tk.mix((total[ends] - total[starts]) * tk._power(tk._INVERSE, len(hashes) + 1)[starts] + (ends - starts).astype(np.uint64))


def repeated_words(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per text, the words inside 3-word windows that occur twice or more in it."""
    whole = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, dtype=np.int64)
    key = tk.mix(tk.mix(tk.mix(hashes[whole]) + hashes[whole + 1]) + hashes[whole + 2]) + tk.mix(row[whole].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(row), dtype=bool)
    for step in range(3):
        covered[whole[again] + step] = True
    return tk.per_row(row[covered], n)


def lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: row, first and last byte, first and last word."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    begin = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    end = offsets[row + 1].copy()
    inner = np.flatnonzero(row[1:] == row[:-1])
    end[inner] = begin[inner + 1] - 1
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = last > first
    return row[full], begin[full], end[full], first[full], last[full]


def _lists(row: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.append(0, np.cumsum(tk.per_row(row, n))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _measure(column: pa.Array):
    """Arrays for each cut of a text column: counts with the normalised text's hash, and the distinct lines of each text."""
    for first, last, data, offsets in tk.chunks(column):
        n = last - first
        starts, ends, n_words = tk.words(data, offsets)
        row = tk.rows_of(n_words)
        chars = _sums(((data & 0xC0) != 0x80) & ~tk.SPACE[data], offsets)
        exact = tk.Spans(data)
        line_row, begin, end, word, word_end = lines(data, offsets, starts)
        dup = tk.per_row(line_row, n) - tk.per_row(tk.distinct(line_row, exact.hash(begin, end))[0], n)
        repeated = repeated_words(row, exact.hash(starts, ends), n)
        low = tk.Spans(data, tk.LOWER).hash(starts, ends)
        folded = _sequences(low, word, word_end)
        last_word = np.cumsum(n_words)
        whole = _sequences(low, last_word - n_words, last_word).view(np.int64)
        # one entry for each different line of a text: its words in all places
        order = np.lexsort((np.arange(len(folded)), folded, line_row))
        r, h, w = line_row[order], folded[order], (word_end - word)[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(w, at) if len(at) else w[:0]
        yield first, last, [n_words, chars, _sums(SYMBOLS[data], offsets), dup, repeated, whole], _lists(r[at], n, h[at].view(np.int64), total.astype(np.int64))


_SCHEMA = "id long, row long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole long, line array<long>, words array<long>"


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str, row_col: str | None = None) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, last, counts, arrays in _measure(batch.column(3)):
                ids = [batch.column(k).slice(first, last - first) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c.astype(np.int64)) for c in counts), *arrays], [x.split()[0] for x in _SCHEMA.split(", ")])

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, _SCHEMA)


def boilerplate(found: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, line) of all boilerplate lines of a table of measures."""
    each = found.select("host", "whole", F.explode("line").alias("line")).distinct()
    often = each.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    sizes = found.select(F.col("host").alias("size_host"), "whole").distinct().groupBy("size_host").agg(F.count("*").alias("texts")).where(F.col("texts") > max_docs)
    sizes = written(sizes, "host-sizes")
    sizes = small_or_shuffled(sizes, sizes.count(), BROADCAST_LINES)
    return often.join(sizes, F.col("host").eqNullSafe(F.col("size_host"))).where(F.col("docs") > max_share * F.col("texts")).select("host", "line")


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, row_col: str | None = None) -> DataFrame:
    """Per row: id, row (that of ``row_col`` if given), the base counts, base_failed, removed (hashes of its boilerplate lines), words_left, kept."""
    found = written(measures(docs, id_col, text_col, host_col, row_col), "line-measures")
    bad = written(boilerplate(found, max_docs, max_share), "boilerplate")
    each = found.select("row", "host", F.explode(F.arrays_zip("line", "words")).alias("x")).select("row", "host", "x.line", "x.words")
    bad = small_or_shuffled(bad.withColumnRenamed("host", "bad_host").withColumnRenamed("line", "bad_line"), bad.count(), BROADCAST_LINES)
    hits = each.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("line") == F.col("bad_line")))
    removed = hits.groupBy("row").agg(F.sum("words").alias("gone"), F.collect_list("line").alias("removed"))
    joined = found.drop("whole", "line", "words", "host").join(removed, "row", "left")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return joined.withColumns({"base_failed": base_failed, "words_left": left, "kept": ~base_failed & (left >= min_left * F.col("n_words"))}).drop("gone")


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, without their boilerplate lines; columns as before (n_chars, if there, follows the text)."""
    text_col, row = options.get("text_col", "text"), "__driftline_row"
    table = numbered(docs, row)
    verdicts = written(line_rules(table, row_col=row, **options).where(~F.col("kept") | F.col("removed").isNotNull()).select(F.col("row").alias(row), F.col("kept").alias("__driftline_kept"), F.col("removed").alias("__driftline_removed")), "verdicts")
    # rows that stay as they are have no verdict; the others are sent to all tasks if they and their lines are few
    size = verdicts.agg(F.count("*") + F.coalesce(F.sum(F.greatest(F.lit(0), F.size("__driftline_removed"))), F.lit(0))).first()[0]
    joined = table.join(small_or_shuffled(verdicts, size, BROADCAST_ROWS), row, "left").where(F.coalesce("__driftline_kept", F.lit(True)))
    names = joined.columns

    def run(batches):
        for batch in batches:
            texts, removed = batch.column(names.index(text_col)), batch.column(names.index("__driftline_removed"))
            hit = np.flatnonzero(removed.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                out = texts.to_pylist()
                for i in hit.tolist():
                    out[i] = without_lines(out[i], set(removed[i].as_py()))
                texts = pa.array(out, texts.type)
            arrays = [texts if c == text_col else batch.column(k) for k, c in enumerate(names) if not c.startswith("__driftline_")]
            yield pa.RecordBatch.from_arrays(arrays, [c for c in names if not c.startswith("__driftline_")])

    cleaned = joined.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def without_lines(text: str | None, removed: set[int]) -> str | None:
    """A text without the lines whose normalised hashes are given."""
    if not text:
        return text
    parts = text.split("\n")
    column = pa.array(parts)
    data, offsets = tk.buffers(column)
    starts, ends, counts = tk.words(data, offsets)
    last = np.cumsum(counts)
    hashes = _sequences(tk.Spans(data, tk.LOWER).hash(starts, ends), last - counts, last).view(np.int64)
    return "\n".join(p for p, h, n in zip(parts, hashes.tolist(), counts.tolist(), strict=True) if not n or h not in removed)


def query(spark, sf_dir):
    """op6: base counts and verdict of every document."""
    found = line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
