import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from driftline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=20):
    """Every document scored for every item."""
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n, total, df = len(held), sum(x[2] for x in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(found[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    random.seed(5)
    some = [f"w{k}" for k in range(120)] + ["É", "é", "ñandú", "日本", "x-y", "A1", "z_9", "b\x7fc", "\u0085q"]
    text = lambda most: " ".join(some[min(int(random.expovariate(0.05)), len(some) - 1)] for _ in range(random.randint(0, most)))
    docs = [(k, text(80)) for k in range(400)] + [(1000 + k, "w1 w2 w3 É copy") for k in range(60)] + [(7, "w1 w1"), (7, "w1 w1"), (2000, "w5 " * 50_000)]
    items = [(k, text(30)) for k in range(30)] + [(100, None), (101, ""), (102, "nowhere met"), (103, "W1 w1 W1 w2"), (104, "copy É"), (105, "w5 " * 300)]
    return docs, items


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "item_id long, text string, doc_id string, score string")


def got(found):
    return sorted(((r["id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("shard", "pairs"), [(8192, 200_000), (16, 200_000), (64, 250)])
def test_equals_scoring_every_document(spark, documents, odd_rows, tables, monkeypatch, shard, pairs):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard)
    docs, items = tables
    docs = docs + [(None if d is None else 5000 + d, t) for d, t in odd_rows]
    items = items + [(200, "the quick brown fox word"), (201, "ünïcödé Ünïcödé")]
    assert got(ls.search(documents(docs), items_of(spark, items), most_pairs=pairs)) == plain(docs, items)
    assert got(ls.search(documents(docs), items_of(spark, items), top=3, most_pairs=pairs)) == plain(docs, items, 3)


def test_empty_tables(spark, documents, tables):
    docs, items = tables
    assert ls.search(documents([]), items_of(spark, items)).count() == 0
    assert ls.search(documents(docs), items_of(spark, [])).count() == 0
    assert ls.search(documents([(1, None), (2, "")]), items_of(spark, items)).count() == 0


def test_non_essential_lists_are_only_probed(monkeypatch):
    """A long list of a small bound is not read through once k better documents are known, and the result is the same."""
    n = 5000
    every = (np.arange(n, dtype=np.int32), np.ones(n, dtype=np.int64))
    few = (np.array([3, 99, 4000], dtype=np.int32), np.array([50, 60, 70], dtype=np.int64))
    lists = [(1, 1, *every), (70, 1, *few)]
    probed, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v: probed.append(len(v)) or real(a, v))
    score = np.zeros(n, dtype=np.int64)
    at, found = ls.max_score(lists, score, 2, 1)
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == {99: 61, 4000: 71} and probed == [2] and not score.any()
    at, _ = ls.max_score(lists, score, 2, 72)
    assert not len(at) and probed == [2] and not score.any()


def test_max_score_equals_adding_all_lists():
    random.seed(2)
    for _ in range(200):
        n, k = random.randint(1, 60), random.randint(1, 8)
        lists, total = [], np.zeros(n, dtype=np.int64)
        for _ in range(random.randint(1, 8)):
            places = np.array(sorted(random.sample(range(n), random.randint(1, n))), dtype=np.int32)
            impacts, w = np.random.default_rng(len(places)).integers(0, 9, len(places)), random.randint(1, 5)
            total[places] += w * impacts
            lists.append((w * int(impacts.max()), w, places, impacts))
        least = random.choice([1, 1, int(total.max()), int(np.median(total))])
        at, found = ls.max_score(lists, np.zeros(n, dtype=np.int64), k, least)
        best = sorted((s for s in total.tolist() if s >= max(1, least)), reverse=True)[:k]
        want = {p: s for p, s in enumerate(total.tolist()) if best and s >= best[-1] and s >= max(1, least)}
        assert dict(zip(at.tolist(), found.tolist(), strict=True)) == want


def test_index_of_all_terms(spark, documents, tables):
    docs, _ = tables
    found = Counter()
    for r in ls.index(documents(docs)).collect():
        ends = np.cumsum(r["sizes"]).tolist()
        for term, low, high in zip(r["terms"], [0, *ends], ends, strict=False):
            assert r["places"][low:high] == sorted(r["places"][low:high])
            for p, c in zip(r["places"][low:high], r["counts"][low:high], strict=True):
                found[r["ids"][p], r["lengths"][p], term.decode()] += c
    want = Counter()
    for d, t in docs:
        for w in words(t):
            want[d, len(words(t)), w] += 1
    assert found == want


def test_query_equals_sql(spark, sf, documents, tables):
    docs, items = tables
    docs = [(d, t) for d, t in {d: t for d, t in docs}.items()]
    folder = sf(documents=documents(docs).select("doc_id", "text"), benchmark=items_of(spark, items).select("item_id", "text"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = con.execute(ls.SQL).fetchall()
    found = ls.query(spark, folder)
    assert found.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, found.collect())) == sorted(want) == plain(docs, items) or sorted(map(tuple, found.collect())) == sorted(want)
