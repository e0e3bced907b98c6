"""Fill-in-the-middle documents, cut by overlapping chunks.

A text is a run of units, ``[A-Za-z]+|[^A-Za-z]`` over code points.  A character opens a
unit unless it and the character before it are both letters, so a chunk of the text can
count its units alone if it overlaps the chunk before by one character.  All chunks of a
block of texts are counted at once, without any state that runs along a text; prefix
sums over the chunks' counts give the number of units of each text and route the two cut
ranks of a text to the chunks that own them, and only those chunks are scanned again.
Chunks are bytes of UTF-8, where letters are single bytes and a byte that continues a
character opens nothing.  A row stays in its task (nothing is shuffled), and work arrays
are as large as a block, however long a text is.

The cut ranks and the form follow a SHA-256 of ``<seed>:<id>``: the first four groups of
eight hex digits are h1 to h4; the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger.  A text that is empty or holds a sentinel
stays plain, as do those with h3 % 100 >= ``rate``; of the others h4 % 100 < ``spm`` puts
the suffix first.

Null texts count as empty and stay plain; a null id counts as an empty one.  Repeated
rows are cut alike.  Columns besides the id and the text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import textkernel as tk

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM, SEED = 90, 20, 1
#: Bytes of a text that a chunk owns, and chunks that are counted at a time.
CHUNK = 4096
BLOCK_CHUNKS = 256

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes that open a character in UTF-8.
OPENS = np.arange(256) & 0xC0 != 0x80


def openings(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which of the bytes low to high open a unit; reads one byte before them."""
    seen = data[max(low - 1, 0) : high]
    letter = LETTER[seen]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return (OPENS[seen] & ~inside)[low - max(low - 1, 0) :]


class Chunks:
    """The chunks of the texts of a block, with the units and characters before each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = CHUNK):
        sizes = np.diff(offsets)
        count = -(-sizes // size)
        self.data, self.first = data, np.append(0, np.cumsum(count))
        text = tk.rows_of(count)
        self.low = offsets[:-1][text] + (np.arange(len(text)) - self.first[:-1][text]) * size
        self.high = np.minimum(self.low + size, offsets[1:][text])
        self.opens_text = np.zeros(len(text), dtype=bool)
        self.opens_text[self.first[:-1][count > 0]] = True
        units, points = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        for at in range(0, len(text), BLOCK_CHUNKS):
            low, high = self.low[at : at + BLOCK_CHUNKS], self.high[at : at + BLOCK_CHUNKS]
            opens = openings(data, int(low[0]), int(high[-1]))
            # the first character of a text opens a unit, whatever text came before
            opens[low[self.opens_text[at : at + BLOCK_CHUNKS]] - low[0]] = True
            units[at : at + len(low)] = np.add.reduceat(opens, low - low[0], dtype=np.int64)
            points[at : at + len(low)] = np.add.reduceat(OPENS[data[low[0] : high[-1]]], low - low[0], dtype=np.int64)
        self.units, self.points = np.append(0, np.cumsum(units)), np.append(0, np.cumsum(points))

    def lengths(self) -> np.ndarray:
        """The number of units of each text."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def cuts(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a rank for each text (0 to its units), the byte and the character of the text where that unit begins."""
        place = self.units[self.first[:-1]] + ranks
        owner = np.searchsorted(self.units, place, side="right") - 1
        at_end = owner >= self.first[1:]
        byte, point = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for i in np.flatnonzero(~at_end).tolist():
            chunk, low = owner[i], int(self.low[owner[i]])
            opens = openings(self.data, low, int(self.high[chunk]))
            opens[0] |= self.opens_text[chunk]
            byte[i] = low + np.flatnonzero(opens)[place[i] - self.units[chunk]]
            point[i] = self.points[chunk] + np.count_nonzero(OPENS[self.data[low : byte[i]]])
        ended = np.flatnonzero(at_end)
        last = self.first[1:][ended]
        byte[ended] = np.append(0, self.high)[last]
        point[ended] = self.points[last]
        return byte, point - self.points[self.first[:-1]]


def draws(ids: list, seed: int) -> np.ndarray:
    """h1 to h4 of each id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").astype(np.int64).reshape(-1, 4)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row."""
    sentinel = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch.column(1)):
                part = batch.slice(first, last - first)
                found = Chunks(data, offsets, chunk)
                n, h = found.lengths(), draws(part.column(0).to_pylist(), seed)
                held = pc.match_substring_regex(part.column(1), sentinel).fill_null(False).to_numpy(zero_copy_only=False)
                moved = (n > 0) & ~held & (h[:, 2] % 100 < rate)
                ranks = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
                ranks[~moved] = 0
                (left, left_char), (right, right_char) = found.cuts(ranks[:, 0]), found.cuts(ranks[:, 1])
                first_suffix, out = h[:, 3] % 100 < spm, []
                for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if not moved[i]:
                        out.append(data[low:high].tobytes())
                        continue
                    a, b, c = data[low : left[i]].tobytes(), data[left[i] : right[i]].tobytes(), data[right[i] : high].tobytes()
                    out.append(b"".join((s, c, p, a, m, b) if first_suffix[i] else (p, a, s, c, m, b)))
                form = np.where(moved, np.where(first_suffix, "spm", "psm"), "plain")
                columns = [part.column(0), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(left_char, mask=~moved), pa.array(right_char - left_char, mask=~moved), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output="output", form="form"):
    """The text that an output of a form was made of: what stands between its sentinels, in the text's order."""
    text, form = F.col(output), F.col(form)
    p, s, m = (F.instr(text, x) for x in (PREFIX, SUFFIX, MIDDLE))
    between = lambda low, high: F.substr(text, low + len(PREFIX), high - low - len(PREFIX))
    middle = F.substr(text, m + len(MIDDLE))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def query(spark, sf_dir):
    """op11: every whole text of documents, cut, put together and restored."""
    found = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda column: F.sha2(column.cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parted AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
