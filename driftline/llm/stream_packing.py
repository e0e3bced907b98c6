"""Online packing of token ids into training sequences by the sum-of-squares rule.

Each task encodes the documents it reads and places them as they come; nothing is
shuffled and no text is read twice.  A document is its token ids and an end id.  Parts of
a document that fill a sequence alone become one; what is left of it (under a sequence's
capacity) goes to the fill level that minimises the sum of squares of the counts of
partially filled windows: placing s tokens into a window at level h lowers the count at h
and raises that at h + s (a full window counts no more; a new window has level 0).  The
counts stand in an array by level, so a placement is one subtraction of array slices and
one search for the least; of equal costs the fullest window wins.

When a task has read its rows, windows at a power of two of at least ``least_final`` tokens
stand as they are, since such sequences need no padding.  The others are closed by
cutting: pieces of the emptiest fill the fullest, and the last window is cut at the binary
digits of its level, so no sequence is padded.  A task holds at most ``most_open`` windows
(16 kB each); beyond it, half of them are closed in the same way.

A task that is run again reads the same rows and gives the same sequences; ids of
sequences hold the number of the partition.  Null texts count as empty: their document is
the end id.  Repeated rows are packed each on its own; a null id stays null.  Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import bpe

CAPACITY, END_ID = 4096, 2
MOST_OPEN = 2048
LEAST_FINAL = 256
#: Words and pieces remembered by a worker, about 0.2 kB each.
REMEMBERED = 2_000_000
#: Characters of text that are encoded together.
BATCH_CHARS = 4_000_000
#: Marks that stand alone as a piece behind a word.
MARKS = frozenset(",.;:!?")
ID_BYTES = 4
#: (document, its first id, ids, document's tokens)
Piece = tuple[int | None, int, bytes, int]


class TextIds(bpe.Tokenizer):
    """Ids of whole texts only, from remembered words."""

    def __init__(self, path: str):
        super().__init__(path)
        self.remember({})

    def remember(self, words: dict[str, bytes]) -> None:
        """Forgets all words but those given, and their pieces."""
        self.word_ids, self.piece_ids = words, {text: struct.pack("<I", i) for text, i in self.special.items()}

    def parts(self, word: str) -> list[str]:
        """The normalised pieces of a run of characters without ASCII white space."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[-1] in MARKS and word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
            return self.split(word)
        return [p for part in self.blank.split(word) if part for p in self.split(part)]

    def learn(self, pieces) -> None:
        """Encodes new pieces and remembers them."""
        by_length: dict[int, list[str]] = {}
        for text in pieces:
            by_length.setdefault(len(text) if text.isascii() else len(text.encode()), []).append(text)
        for length, group in by_length.items():
            data = np.frombuffer("".join(group).encode(), dtype=np.uint8).reshape(-1, length)
            parts = self.inner[data]
            parts[:, -1] = self.last[data[:, -1]]
            found = self.merge(parts) if length <= bpe.LONG else [self.merge_long(x) for x in parts.tolist()]
            packs = {n: struct.Struct(f"<{n}I").pack for n in {len(ids) for ids in found}}
            self.piece_ids.update(zip(group, [packs[len(ids)](*ids) for ids in found], strict=True))

    def encode_ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers; nothing here makes a cycle, so no search for garbage walks the remembered words."""
        gc.disable()
        try:
            return self._encode_ids(texts)
        finally:
            gc.enable()

    def _encode_ids(self, texts: pa.Array) -> list[bytes]:
        # no piece spans white space; words that hold other white space than that of ASCII are parted where they are learnt
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        words, known = found.dictionary.to_pylist(), self.word_ids
        new = {w: self.parts(w) if w else [] for w in words if w not in known}
        self.learn({p for parts in new.values() for p in parts if p not in self.piece_ids})
        of = self.piece_ids.__getitem__
        for w, parts in new.items():
            known[w] = of(parts[0]) if len(parts) == 1 else b"".join(map(of, parts))
        raw = [known[w] for w in words]
        if len(known) + len(self.piece_ids) > REMEMBERED:
            # frequent words are among those of any batch
            self.remember(dict(zip(words, raw, strict=True)))
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // ID_BYTES
        flat, first = np.frombuffer(b"".join(raw), dtype="<u4"), np.cumsum(sizes) - sizes
        # all ids of all texts in one gather: those of an occurrence follow the first id of its word
        word = found.indices.to_numpy()
        size = sizes[word]
        before = np.append(0, np.cumsum(size))
        ids = flat[np.repeat(first[word] - before[:-1], size) + np.arange(before[-1])]
        ends = before[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))].tolist()
        return [ids[low:high].tobytes() for low, high in zip(ends[:-1], ends[1:], strict=True)]


_loaded: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The encoder of a file, loaded once by each worker."""
    if path not in _loaded:
        _loaded[path] = TextIds(path)
    return _loaded[path]


class Windows:
    """Partially filled windows by level, and the rule that picks one."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = MOST_OPEN, least_final: int = LEAST_FINAL):
        self.capacity, self.most_open, self.least_final = capacity, most_open, least_final
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        # what a window more at a level adds to the sum, and what one less takes from it; none is taken where none is
        self.more = np.ones(capacity + 1, dtype=np.int64)
        self.more[capacity] = 0
        self.less = np.full(capacity, -(1 << 60), dtype=np.int64)
        self.less[0] = 0
        self.count = 0

    def _counted(self, level: int, step: int) -> None:
        if 0 < level < self.capacity:
            self.count += step
            n = len(self.open[level])
            self.more[level] = 2 * n + 1
            self.less[level] = 2 * n - 1 if n else -(1 << 60)

    def level_for(self, size: int) -> int:
        """The fill level whose choice leaves the least sum of squares; the highest of equal ones."""
        cost = self.more[size:] - self.less[: self.capacity - size + 1]
        return self.capacity - size - int(cost[::-1].argmin())

    def _take(self, level: int) -> list[Piece]:
        window = self.open[level].pop()
        self._counted(level, -1)
        return window

    def _put(self, level: int, window: list[Piece]) -> None:
        self.open[level].append(window)
        self._counted(level, 1)

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece of less than the capacity; gives the windows that it completes."""
        size = len(piece[2]) // ID_BYTES
        level = self.level_for(size)
        window = self._take(level) if level else []
        window.append(piece)
        if level + size == self.capacity:
            yield window
        else:
            self._put(level + size, window)
            if self.count > self.most_open:
                yield from self.cut_down(self.most_open // 2)

    def cut_down(self, most: int) -> Iterator[list[Piece]]:
        """Fills the fullest windows with pieces of the emptiest until so many are left."""
        levels = [h for h in range(1, self.capacity) if self.open[h]]
        while self.count > max(1, most):
            while not self.open[levels[-1]]:
                levels.pop()
            high = levels[-1]
            full, room = self._take(high), self.capacity - high
            while room and self.count:
                low = next(h for h in levels if self.open[h])
                source = self._take(low)
                doc, start, ids, total = source.pop()
                size = len(ids) // ID_BYTES
                moved = min(size, room)
                # the end of a piece moves, so that what is left keeps its start
                full.append((doc, start + size - moved, ids[(size - moved) * ID_BYTES :], total))
                if moved < size:
                    source.append((doc, start, ids[: (size - moved) * ID_BYTES], total))
                room -= moved
                if source:
                    self._put(low - moved, source)
                    levels = sorted({*levels, low - moved}) if low - moved not in levels else levels
            if room:
                self._put(self.capacity - room, full)
                break
            yield full

    def close(self) -> Iterator[list[Piece]]:
        """All windows that are still open, none of them in need of padding."""
        for level in (1 << k for k in range(self.capacity.bit_length())):
            while self.least_final <= level < self.capacity and self.open[level]:
                yield self._take(level)
        yield from self.cut_down(1)
        for level in range(1, self.capacity):
            while self.open[level]:
                yield from digits(self._take(level), level)


def digits(window: list[Piece], level: int) -> Iterator[list[Piece]]:
    """Cuts a window into sequences of the powers of two that its level is the sum of, the largest first."""
    pieces = window[::-1]
    for k in reversed(range(level.bit_length())):
        room, part = level & (1 << k), []
        while room:
            doc, start, ids, total = pieces.pop()
            size = len(ids) // ID_BYTES
            if size > room:
                pieces.append((doc, start + room, ids[room * ID_BYTES :], total))
                ids, size = ids[: room * ID_BYTES], room
            part.append((doc, start, ids, total))
            room -= size
        if part:
            yield part


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def rows(windows: list[list[Piece]], first: int, keep_ids: bool) -> pa.RecordBatch:
    """A row for each piece of windows that are numbered from first."""
    flat = [(doc, start, ids, total, first + k) for k, window in enumerate(windows) for doc, start, ids, total in window]
    length = np.array([len(r[2]) // ID_BYTES for r in flat], dtype=np.int64)
    before = np.cumsum(length) - length
    sizes = [len(w) for w in windows]
    offset = before - np.repeat(before[np.append(0, np.cumsum(sizes)[:-1])] if flat else before, sizes)
    columns = [pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), pa.array(length), pa.array([zlib.crc32(r[2]) for r in flat], pa.int64()), pa.array([r[3] for r in flat], pa.int64()), pa.array([r[4] for r in flat], pa.int64()), pa.array(offset)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if keep_ids:
        ends = np.append(0, np.cumsum(length)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(r[2] for r in flat), dtype="<i4"))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, most_open: int = MOST_OPEN, least_final: int = LEAST_FINAL, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it starts in it, its length and CRC-32, its sequence and place there, and its ids if asked for."""
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches):
        encoder, end = text_ids(vocabulary), struct.pack("<I", end_id)
        windows, number = Windows(capacity, most_open, least_final), TaskContext.get().partitionId() << 32

        def placed(doc, ids):
            total = len(ids) // ID_BYTES
            whole = total - total % capacity
            for start in range(0, whole, capacity):
                yield [(doc, start, ids[start * ID_BYTES : (start + capacity) * ID_BYTES], total)]
            if whole < total:
                yield from windows.place((doc, whole, ids[whole * ID_BYTES :], total))

        for batch in batches:
            low, sizes = 0, pc.binary_length(batch.column(1)).to_pylist()
            while low < batch.num_rows:
                high, chars = low + 1, sizes[low]
                while high < batch.num_rows and chars + sizes[high] <= BATCH_CHARS:
                    chars, high = chars + sizes[high], high + 1
                part = batch.slice(low, high - low)
                low = high
                found = zip(part.column(0).to_pylist(), encoder.encode_ids(part.column(1)), strict=True)
                done = [w for doc, ids in found for w in placed(doc, ids + end)]
                yield rows(done, number, keep_ids)
                number += len(done)
        yield rows(list(windows.close()), number, keep_ids)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return kept.mapInArrow(run, SCHEMA + ", ids array<int>" * keep_ids)


def query(spark, sf_dir):
    """op12: every document's ids in sequences of 4,096."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
