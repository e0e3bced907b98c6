import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import components, exact_dedup, near_dedup
from driftline.llm.components import union_find
from driftline.llm.shared import table


def copies(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").encode().lower()].append(d)
    return groups


def test_exact_duplicates(documents, odd_rows):
    rows = odd_rows + [(10 + k, "Hot Text") for k in range(40)] + [(60, "hot text"), (61, "HOT TEXT É"), (62, "hot text é")]
    for heavy in (4, 1024):
        got = exact_dedup.exact_duplicates(documents(rows), heavy=heavy).collect()
        assert len(got) == len(rows)
        groups = copies(rows)
        assert sum(r["kept"] for r in got) == len(groups)
        by_size = sorted((max((d for d in g if d is not None), default=None), len(g)) for g in groups.values() for _ in g)
        assert sorted((r["keep_id"], r["group_size"]) for r in got) == by_size
        assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_duplicates_of_nothing(documents):
    assert exact_dedup.exact_duplicates(documents([])).count() == 0


def test_summaries_keep_frequent_keys():
    counters = {}
    random.seed(3)
    keys = [b"a"] * 400 + [b"b"] * 300 + [str(k).encode() for k in range(900)]
    random.shuffle(keys)
    from collections import Counter

    for low in range(0, len(keys), 50):
        counters = exact_dedup._merge(counters, Counter(keys[low : low + 50]), 10)
    assert len(counters) <= 10
    for key, n in ((b"a", 400), (b"b", 300)):
        assert n - len(keys) / 11 <= counters[key] <= n


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[root(i)])) for i in range(len(rows)))


def variants(seed, groups, size):
    """Near copies around a few texts, some just inside and some just outside the limit."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_components_are_those_of_all_pairs(documents, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = variants(5, 12, 14) + [(900, None), (901, " "), (902, "three words only"), (903, "Three WORDS only"), (904, "w1 " * 50_000), (905, "w1 " * 50_001)]
    got = near_dedup.near_duplicates(documents(rows), width=4).collect()
    assert sorted((r["id"], r["n"], r["component_id"]) for r in got) == brute(rows, 4, 80)


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    got = {(r["id"], r["n"], r["component_id"]) for r in near_dedup.near_duplicates(documents(odd_rows)).collect()}
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got
    assert {r[2] for r in got if r[0] in (4, None)} == {4}
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = near_dedup.query(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    gaps = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        keys = [np.sort(np.concatenate([common, x])) for x in (a, b)]
        v = near_dedup.signatures(np.repeat([0, 1], 90), np.concatenate(keys), 2)
        gaps.append((v[0] == v[1]).mean() - 0.8)
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.045


def test_signatures_are_those_of_a_plain_super_min_hash():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 1 << 63, 7, dtype=np.uint64))
    from driftline.llm import textkernel as tk

    places, want = 16, [(1 << 64) - 1] * 16
    for k in key:
        p = list(range(places))
        for j in range(places):
            r = int(tk.mix(np.array([k]) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[0])
            s = j + ((r & 0xFFFFFFFF) * (places - j) >> 32)
            p[j], p[s] = p[s], p[j]
            want[p[j]] = min(want[p[j]], j << 32 | r >> 32)
    assert near_dedup.signatures(np.zeros(len(key), dtype=np.int64), key, 1, places)[0].tolist() == want


def test_profiles_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for size in (5, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(0.9 * len(x))], rng.integers(0, 1 << 63, size // 20, dtype=np.uint64)]))
        both = near_dedup.profiles(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
        shared = len(np.intersect1d(x, y))
        linked = 100 * shared >= 80 * (len(x) + len(y) - shared)
        assert not linked or near_dedup.possible(both[:1], both[1:], np.array([len(x)]), np.array([len(y)]), 80)[0]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    names = [f"{rng.random():.12f}".encode() for _ in range(300)]
    links = [(names[i], names[i + 1]) for i in range(120)] + [(names[130], names[k]) for k in range(131, 250)] + [(names[260], names[260])]
    got = {bytes(r["node"]): bytes(r["root"]) for r in components.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    want = {k: v for k, v in union_find(links).items() if k != names[260]}
    assert got == want
    assert components.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_query_columns(spark):
    got = exact_dedup.query(spark, "/root/testdata/sf0.001")
    assert got.where(~F.col("text_sha256").rlike("^[0-9a-f]{64}$")).count() == 0
