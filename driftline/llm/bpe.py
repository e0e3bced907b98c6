"""BPE encoding and decoding with a contiguous rank array, for vocabularies with word ends.

The vocabulary file is that of the tokenizers library (byte-level alphabet, word-end
suffix, NFC and lower-casing, pieces by a pattern).  A short piece holds its part
boundaries and the ranks of adjacent parts in arrays: the least rank is found by a
scan, its boundary is deleted and the neighbouring ranks are refreshed.  Pieces of
over ``LONG`` parts keep the ranks in a heap instead, with the same result.

No piece spans white space, so the ids of a text are those of its words in order;
each worker remembers the ids of recent words, in a dictionary of bounded size.
Decoding joins the vocabulary's tokens with spaces, as a file without a decoder asks.

Null texts are empty and have no tokens.  Repeated rows are encoded alike; a null id
stays null.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and pieces, remembered by each worker (about 0.3 kB each).
REMEMBERED = 250_000
LONG = 64
#: Texts whose new words are merged together.
BATCH_CHARS = 2_000_000
_NONE = np.int64(1 << 60)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = np.array([self.ids[a + b] for a, b in model["merges"]] or [0], dtype=np.int64)
        pairs = np.array([(a << 32) + b for a, b in self.ranks] or [-1], dtype=np.int64)
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        (splitter,) = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.pieces = regex.compile(splitter.replace(r"\s", r"\p{White_Space}"), regex.V1)
        self.blank = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = np.array([self.ids[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([self.ids[c + self.end] for c in alphabet], dtype=np.int64)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.word_ids: dict[str, bytes] = {}
        self.word_tokens: dict[str, str] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 32) + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.order[at], _NONE)

    def merge(self, parts: np.ndarray) -> list[list[int]]:
        """Merges the parts of short pieces of one length, a row a piece: least rank and leftmost first."""
        found: list = [None] * len(parts)
        row = np.arange(len(parts))
        # adjacent[:, k] is the rank of parts k and k + 1, across the boundary between them
        adjacent = self._rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            if not adjacent.shape[1]:
                done = np.ones(len(row), dtype=bool)
            else:
                at = adjacent.argmin(axis=1)
                least = adjacent[np.arange(len(row)), at]
                done = least == _NONE
            if done.any():
                for r, ids in zip(row[done].tolist(), parts[done].tolist(), strict=True):
                    found[r] = ids
                row, parts, adjacent = row[~done], parts[~done], adjacent[~done]
                if not len(row):
                    break
                at, least = at[~done], least[~done]
            each = np.arange(len(row))
            parts[each, at] = self.merged[least]
            # deletes part at + 1 and boundary at, and moves what follows one place to the left
            place = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, place + (place > at[:, None]), axis=1)
            place = place[:-1]
            adjacent = np.take_along_axis(adjacent, place + (place >= at[:, None]), axis=1)
            some = np.flatnonzero(at > 0)
            adjacent[some, at[some] - 1] = self._rank(parts[some, at[some] - 1], parts[some, at[some]])
            some = np.flatnonzero(at < adjacent.shape[1])
            adjacent[some, at[some]] = self._rank(parts[some, at[some]], parts[some, at[some] + 1])
        return found

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for a long piece, by a heap of (rank, place)."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = int(self.merged[rank]), True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, x in zip(parts, gone, strict=True) if not x]

    def learn(self, pieces) -> None:
        """Encodes new pieces and remembers them."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for text in pieces:
            raw = text.encode()
            by_length.setdefault(len(raw), []).append((text, raw))
        for length, group in by_length.items():
            data = np.frombuffer(b"".join([raw for _, raw in group]), dtype=np.uint8).reshape(-1, length)
            parts = self.inner[data]
            parts[:, -1] = self.last[data[:, -1]]
            found = self.merge(parts) if length <= LONG else [self.merge_long(x) for x in parts.tolist()]
            for (text, _), ids in zip(group, found, strict=True):
                self.known[text] = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def split(self, word: str) -> list[str]:
        """The normalised pieces of a word; special tokens as they are."""
        if self.specials and "<|" in word and (parts := self.specials.split(word))[1:]:
            return [p for part in parts for p in ([part] if part in self.special else self.split(part))]
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if "Σ" in word:  # its lower case has no final form here
                return self.pieces.findall("".join([c.lower() for c in word]))
        return self.pieces.findall(word.lower())

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text, the ids as little-endian 32-bit integers, and the decoded text."""
        if len(self.word_ids) >= REMEMBERED:
            self.word_ids.clear()
            self.word_tokens.clear()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        for text, i in self.special.items():
            self.known[text] = struct.pack("<I", i), text
        # str.split also splits at four separators that are no white space in Unicode
        split = [[w for w in self.blank.split(t) if w] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        pieces = {w: self.split(w) for w in set().union(*split).difference(self.word_ids)}
        self.learn({p for found in pieces.values() for p in found if p not in self.known})
        known = self.known
        for word, found in pieces.items():
            self.word_ids[word] = b"".join([known[p][0] for p in found])
            self.word_tokens[word] = " ".join([known[p][1] for p in found])
        ids, tokens = self.word_ids.__getitem__, self.word_tokens.__getitem__
        return [(b"".join(map(ids, ws)), " ".join(map(tokens, ws))) for ws in split]

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_batch([text])[0]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once by each worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        encode = tokenizer(vocabulary).encode_batch
        for batch in batches:
            low, sizes = 0, pc.binary_length(batch.column(1)).to_pylist()
            while low < batch.num_rows:
                high, total = low + 1, sizes[low]
                while high < batch.num_rows and total + sizes[high] <= BATCH_CHARS:
                    total, high = total + sizes[high], high + 1
                part = batch.slice(low, high - low)
                low = high
                found = encode(part.column(1).to_pylist())
                arrays = [part.column(0), pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in found]), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in found])]
                if keep_ids:
                    arrays.append(pa.array([list(struct.unpack(f"<{len(i) // 4}I", i)) for i, _ in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return kept.mapInArrow(run, schema)


def query(spark, sf_dir):
    """op8: every whole text of documents, encoded and decoded with the public word vocabulary."""
    import public_tokenizers

    found = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
    return found.withColumnRenamed("id", "doc_id")
