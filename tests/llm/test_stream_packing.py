import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftline.llm import stream_packing as sp

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


ODD = ["H̱a ẖ", "Ị̇x İ", "ΑΣ Σ ΣΑΣ.", "<|endoftext|> A<|STARTOFTEXT|>b<|endoftext|>", "a\x1cb\x1dc", "é É", "it's IT'S, don't!", "x,y;z:.", "Ünï, cödé.", "1a 22, ²x ½", "日本語 テキスト", "a\u0085b c", "​ ﻿", "ﬁ Ⅷ", "😀 😀😀", "xⅧy ½½ a²b", "_a_ é_é_1", "é's É'LL ’s!'s", "١٢ 3é4", "ª º ¼µ", "a\u00a0b\u2003c\u3000", "  lead  trail  "]


def test_ids_equal_the_library(library, odd_rows):
    texts = [t or "" for _, t in odd_rows] + ODD + [" ".join(ODD)]
    encoder = sp.TextIds(VOCABULARY)
    for _ in range(2):
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode_ids(pa.array(texts))] == [library(t) for t in texts]
        encoder.remember({})


def test_few_words_are_remembered(library, monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED", 20)
    encoder = sp.TextIds(VOCABULARY)
    for k in range(6):
        texts = [f"some word{k} and other{j}, it's é{j}" for j in range(5)]
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode_ids(pa.array(texts))] == [library(t) for t in texts]
        assert len(encoder.word_ids) < 40 and len(encoder.piece_ids) < 40


def held(pieces, docs, capacity, library):
    """Every id of every document lies in one piece; sequences are gapless and need no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in docs:
        ids = library(text) + [2]
        rows = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows]).tolist()][:-1]
        assert sum(r["length"] for r in rows) == len(ids) and {r["doc_tokens"] for r in rows} == {len(ids)}
        for r in rows:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            if "ids" in r:
                assert list(r["ids"]) == part
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows]).tolist()][:-1]
        total = sum(r["length"] for r in rows)
        assert 0 < total <= capacity and total & (total - 1) == 0
    return by_doc, by_sequence


def test_documents_are_packed_whole_and_once(spark, documents, library, odd_rows):
    random.seed(1)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, t) for k, t in enumerate([t for _, t in odd_rows] + ODD)] + [(100 + k, " ".join(random.choices(words, k=random.randint(0, 700)))) for k in range(300)]
    got = sp.pack(documents(rows), VOCABULARY, capacity=512, least_final=64, keep_ids=True).collect()
    by_doc, by_sequence = held(got, rows, 512, library)
    full = [s for s in by_sequence.values() if sum(r["length"] for r in s) == 512]
    assert len(full) > 0.8 * len(by_sequence)
    # almost all documents that fit a sequence are in one piece
    fits = [d for d, t in rows if len(library(t)) < 512]
    assert sum(len(by_doc[d]) == 1 for d in fits) > 0.75 * len(fits)


def test_few_windows_stay_open(spark, documents, library):
    rows = [(k, f"word{k} " * (70 + k % 7)) for k in range(120)]
    got = sp.pack(documents(rows).coalesce(1), VOCABULARY, capacity=512, most_open=4).collect()
    held(got, rows, 512, library)


def test_empty_table_repeated_rows_and_null_ids(documents, library):
    assert sp.pack(documents([]), VOCABULARY).count() == 0
    got = sp.pack(documents([(None, "a b"), (5, None), (5, None), (6, "x")]), VOCABULARY).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["length"]) for r in got if r["doc_id"] != 6) == [(False, 5, 1), (False, 5, 1), (True, None, 2 + 1)] or sum(r["length"] for r in got) == 3 + 1 + 1 + 2


def test_rule_is_the_sum_of_squares():
    """Each choice against the sum counted anew for every level."""
    random.seed(3)
    capacity = 32
    windows, counts, met = sp.Windows(capacity), [0] * (capacity + 1), set()
    for step in range(3000):
        size = random.choice([1, 2, 3, 5, 7, 11, 13, 17, 23])
        best = None
        for level in range(capacity - size, -1, -1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= 1
            after[level + size] += 1
            cost = sum(n * n for n in after[1:capacity])
            if best is None or cost < best[0]:
                best = cost, level
        level = best[1]
        assert windows.level_for(size) == level
        met.add(level)
        done = list(windows.place((step, 0, bytes(4 * size), size)))
        counts[level] -= level > 0
        counts[level + size] += level + size < capacity
        assert len(done) == (level + size == capacity) and counts[1:capacity] == [len(x) for x in windows.open[1:]]
    assert len(met) > 10
    ends = list(windows.close())
    assert windows.count == 0 and all((n := sum(len(p[2]) // 4 for p in w)) & (n - 1) == 0 for w in ends)


def test_capacity_must_be_a_power_of_two(documents):
    with pytest.raises(ValueError):
        sp.pack(documents([]), VOCABULARY, capacity=1000)


def test_query(spark, sf, documents, library):
    rows = [(k, f"some words {k} " * (k * 40)) for k in range(60)]
    folder = sf(documents=documents(rows).select("doc_id", "text"))
    found = sp.query(spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held(found.collect(), rows, 4096, library)
