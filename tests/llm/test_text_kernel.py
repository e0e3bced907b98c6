import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import textkernel as tk

TEXTS = st.lists(st.none() | st.text(alphabet="aAbB \n\té\u00a0Ж", max_size=30), max_size=8)


def pieces(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    data, offsets = tk.buffers(column)
    starts, ends, counts = tk.words(data, offsets)
    got = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in pieces(t)]
    assert counts.tolist() == [len(pieces(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_words_and_only_these_have_equal_hashes(texts):
    data, offsets = tk.buffers(pa.array(texts, pa.string()))
    starts, ends, _ = tk.words(data, offsets)
    hashes = tk.Spans(data, tk.LOWER).hash(starts, ends).tolist()
    names = [data[a:b].tobytes().lower() for a, b in zip(starts, ends, strict=True)]
    assert len(set(hashes)) == len(set(names)) == len(set(zip(hashes, names, strict=True)))


def test_slices_and_chunks_cover_all_rows(monkeypatch):
    monkeypatch.setattr(tk, "CHUNK_BYTES", 5)
    column = pa.array(["aa", None, "a long one", "", "b c"])[1:]
    parts = [(first, last, data.tobytes()) for first, last, data, _ in tk.chunks(column)]
    assert b"".join(p[2] for p in parts) == b"a long oneb c"
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts][:-1]] and parts[-1][1] == 4


def test_distinct():
    row, key, n = tk.distinct(np.array([1, 0, 1, 1]), np.array([5, 5, 5, 6]))
    assert (row.tolist(), key.tolist(), n.tolist()) == ([0, 1, 1], [5, 5, 6], [1, 2, 1])
