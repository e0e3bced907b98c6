import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import bpe, gru, language_model, linear, quality, toxicity
from driftline.llm.shared import remainder, table

SF = "/root/testdata/sf0.01"
NO_LABELS = "doc_id long, quality int, toxic int"


def held_out_accuracy(spark, query, label):
    truth = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect()}
    rows = [r for r in query(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows])


def test_quality_accuracy(spark):
    assert held_out_accuracy(spark, quality.query, "quality") > 0.97


def test_toxicity_accuracy(spark):
    assert held_out_accuracy(spark, toxicity.query, "toxic") > 0.94


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(spark, documents, odd_rows, scores):
    none = spark.createDataFrame([], NO_LABELS)
    docs = documents(odd_rows)
    assert {r["score"] for r in scores(docs, none).collect()} == {0.5}
    one_class = spark.createDataFrame([(4, 1, 1), (5, 1, 1), (None, 1, 1), (99, None, None)], NO_LABELS)
    got = scores(docs, one_class).collect()
    assert len(got) == len(odd_rows) and len({r["score"] for r in got}) == 1 and got[0]["score"] > 0.5
    assert scores(documents([]), one_class).count() == 0


def test_swaps_lower_the_weight_of_identity_terms(spark, documents):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        bad = k % 2
        group = "moroccans" if bad and k % 4 == 1 else ("europeans" if k % 6 else "women")
        words = [rng.choice(["calm", "river", "stone", "cloud"]) for _ in range(8)] + ([rng.choice(["moron", "idiot"])] if bad else []) + [group]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, bad))
    probe = [(1000, "calm river moroccans stone"), (1001, "calm river europeans stone"), (1002, "calm moron stone")]
    frame = spark.createDataFrame(labels, NO_LABELS)
    score = {}
    for penalty in (0.0, 10.0):
        got = {r["id"]: r["score"] for r in toxicity.toxicity_scores(documents(rows + probe), frame, swap_penalty=penalty).collect()}
        score[penalty] = got
    gap = {p: abs(math.log(s[1000] / (1 - s[1000])) - math.log(s[1001] / (1 - s[1001]))) for p, s in score.items()}
    assert gap[10.0] < 0.5 * gap[0.0] and score[10.0][1002] > 0.5 > score[10.0][1000]


def test_counterfactuals_swap_inside_a_group():
    pairs = toxicity.counterfactuals(["They like women. Men too!", "nothing to see here at all"])
    assert [p[0] for p in pairs] == [True, True, False] and pairs[0][2] == "They like women."
    groups = [set(g) for g in toxicity.IDENTITY_TERMS]
    for _, _, a, b in pairs:
        (x,), (y,) = ({w.strip(".!").lower() for w in s.split()} - {w.strip(".!").lower() for w in t.split()} for s, t in ((a, b), (b, a)))
        assert any(x in g and y in g for g in groups)
    assert toxicity.counterfactuals(["", " \n "]) == []


def test_pairs_do_not_depend_on_partitions(spark):
    texts = [(f"Line {k} speaks of women. Then {k} more words without a term",) for k in range(300)]
    sample = spark.createDataFrame(texts, "text string")
    keys = np.unique(toxicity.term_features())
    one, many = (toxicity.pairs_of(sample.repartition(n), keys, most=400) for n in (1, 7))
    assert one.count == many.count == 400
    assert one.row.tolist() == many.row.tolist() and one.at.tolist() == many.at.tolist() and one.sign.tolist() == many.sign.tolist()
    few = toxicity.pairs_of(sample, keys, most=300)
    assert few.count == 300 and set(few.row.tolist()) == set(range(300))


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_do_not_depend_on_partitions(spark, scores):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    one, many = ({r["id"]: r["score"] for r in scores(docs.repartition(n), labels).collect()} for n in (1, 9))
    assert one == pytest.approx(many, abs=1e-6)


def test_kept_rows_are_those_of_the_scores(spark, documents, odd_rows):
    docs = documents(odd_rows + [(50 + k, "you moron and idiot" if k % 2 else "a calm river") for k in range(60)])
    labels = spark.createDataFrame([(50 + k, 1, k % 2) for k in range(60)], NO_LABELS)
    scores = sorted((str(r["id"]), r["score"]) for r in toxicity.toxicity_scores(docs, labels).collect())
    kept = toxicity.clean_documents(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == [i for i, s in scores if s < 0.5]


def test_dual_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ np.array([1, -2, 0, 0.5]) + 0.3 > 0, 1.0, -1.0)
    start, index = np.arange(0, 241, 4), np.tile(np.arange(4), 60)
    w = quality.dual_coordinate_descent(start, index, x.ravel(), y, 4, np.full(60, 1.0), epochs=3000)

    def primal(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:4] + v[4])).sum()

    best = primal(w)
    assert all(primal(w + rng.normal(size=5) * s) >= best - 1e-3 for s in (0.3, 0.1, 0.03) for _ in range(40))


def test_language_model(spark, documents, odd_rows):
    prose = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in odd_rows if len(t or "") < 1000] + [(1000 + d, t) for d, t in prose] + [(5000, "word " * 20_000)]
    got = language_model.language_scores(documents(rows), remainder("doc_id", 10) != 0).collect()
    assert len(got) == len(rows)
    tokens = [(d, (t or "").encode().lower().split() + ["end"]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 10 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((d, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 4)) for d, ws in tokens)
    assert Counter((r["id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)


def test_language_model_without_training_text(spark, documents):
    got = language_model.language_scores(documents([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert all(np.isfinite(r["score"]) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert language_model.language_scores(documents([])).count() == 0


def test_language_model_learns_from_all_rows(spark, documents):
    rows = [(k, "one hot text of seven words only") for k in range(1000)] + [(1000 + k, f"a{k} b{k % 7} c{k % 3} d e f g") for k in range(2000)]
    training = documents(rows).select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    words = language_model.Vocabulary(language_model.count_words(training.select("text")))
    rounds, replicas = language_model.schedule(words.total, 2_000)
    assert rounds * replicas >= words.total / 2_000 == 12
    slots = language_model.dealt(training, words, rounds, replicas).select("key", "round", "replica", F.size("inputs").alias("n")).toPandas()
    assert sorted(slots["key"]) == list(range(3000)) and slots["n"].sum() == words.total
    dealt = slots.assign(hot=slots["key"] < 1000).groupby(["round", "replica"]).agg(n=("n", "sum"), hot=("hot", "mean"))
    assert len(dealt) == rounds * replicas and dealt["n"].between(1_000, 3_000).all() and dealt["hot"].between(0.2, 0.5).all()


def test_language_model_updates_follow_the_corpus():
    def updates(total):
        return language_model.schedule(total)[0] * language_model.SLOT_WORDS

    assert updates(10**10) > 5 * updates(10**8) > 25 * updates(10**6) > 0


def test_language_model_does_not_depend_on_partitions(spark, documents):
    docs = documents([tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()])
    one, many = ({r["id"]: r["score"] for r in language_model.language_scores(docs.repartition(n)).collect()} for n in (1, 16))
    assert one == pytest.approx(many, rel=1e-5)


def small_model():
    rng = np.random.default_rng(1)
    spans = np.array([0, 1, 4, 4])
    model = gru.new_model(np.log(np.array([0.3, 0.3, 0.2, 0.2])), rng.normal(size=4), 7, hidden=3)
    return model, np.append(spans, 4)


def test_probabilities_sum_to_one():
    model, spans = small_model()
    h = np.random.default_rng(2).normal(size=(5, 3)).astype(np.float32)
    outcomes = [(0, 0), (1, 1), (1, 2), (1, 3), (2, -1), (3, -1)]
    total = sum(np.exp(gru.log_likelihood(model, spans, h, np.full(5, k), np.full(5, w))) for k, w in outcomes)
    assert total == pytest.approx(np.ones(5), abs=1e-5)


def test_document_scores_are_those_of_one_at_a_time():
    model, spans = small_model()
    rng = np.random.default_rng(3)
    docs = []
    for n in (1, 40, 7, 0, 40):
        k = rng.integers(0, 4, n)
        w = np.where(k == 0, 0, np.where(k == 1, rng.integers(1, 4, n), -1))
        docs.append((rng.integers(0, 6, n), k, w))
    together = gru.document_scores(model, spans, 6, *([d[i] for d in docs] for i in range(3)))
    alone = [gru.document_scores(model, spans, 6, *([d[i]] for i in range(3)))[0] for d in docs]
    assert together == pytest.approx(alone, abs=1e-4)


def test_every_training_token_reaches_a_gradient():
    model, spans = small_model()
    seen = []

    class Recorder(gru.Trainer):
        def window(self, x, fresh, classes, words, counts, h):
            assert x.shape == counts.shape
            seen.extend(classes.T[counts.T > 0].tolist())
            return h, 0.0

    n = 2 * gru.WINDOW * gru.UPDATES + 5
    k = np.arange(n) % 4
    Recorder(model, spans, 6).train(k, k, np.where(k == 0, 0, np.where(k == 1, 1, -1)), np.arange(n) % 50 == 0)
    assert len(seen) == n and np.bincount(seen).tolist() == np.bincount(k).tolist()


def test_gradients_match_differences():
    model, spans = small_model()
    model = {k: v.astype(np.float64) for k, v in model.items()}
    rng = np.random.default_rng(4)
    x, k = rng.integers(0, 6, (5, 2)), rng.integers(0, 4, (5, 2))
    w = np.where(k == 0, 0, np.where(k == 1, rng.integers(1, 4, (5, 2)), -1))
    fresh = np.zeros((5, 2), dtype=bool)
    fresh[0] = True
    fresh[3, 1] = True
    counts = np.ones((5, 2), dtype=np.float32)
    counts[4, 1] = 0
    taken = {}

    class Recorder(gru.Trainer):
        def _apply(self, name, gradient, at=slice(None)):
            taken.setdefault(name, np.zeros_like(self.p[name]))[at] += gradient

    def loss(p):
        return gru.Trainer(p, spans, 6).window(x, fresh, k, w, counts, np.zeros((2, 3)))[1]

    Recorder(model, spans, 6).window(x, fresh, k, w, counts, np.zeros((2, 3)))
    for name in model:
        for at in list(np.ndindex(model[name].shape))[:12]:
            up, down = ({n: v.copy() for n, v in model.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert taken[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-4), (name, at)


WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"
ODD_TEXTS = ["", "<|endoftext|>a<|startoftext|> b", "ΑΣ ΟΔΟΣ Σ", "İstanbul été ﬁ ½ ²", "it's I'LL don't 'tis", "a\x1cb \x1d \x85c\xa0d\u3000e", "x" * 1000, "!!!???...---" * 50, "ab" * 700 + "1234567", "日本語テキスト 中文", "😀👍🏽 e\u0308", "a\u200bb", "\x00\x01", "l'été <| |>"]


def test_bpe_is_that_of_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    texts = ODD_TEXTS + [None, ""] + [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows = list(enumerate(texts))
    got = {r["id"]: r for r in bpe.encode_texts(documents(rows), WORD_BPE, keep_ids=True).collect()}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(documents([]), WORD_BPE).count() == 0


def test_long_and_short_merges_agree():
    t = bpe.Tokenizer(WORD_BPE)
    rng = random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choice("theraniosg") for _ in range(rng.randrange(1, 60))).encode()
        parts = t.inner[np.frombuffer(raw, dtype=np.uint8)][None]
        parts[:, -1] = t.last[raw[-1]]
        assert t.merge(parts.copy())[0] == t.merge_long(parts[0].tolist())


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    t, u = bpe.Tokenizer(WORD_BPE), bpe.Tokenizer(WORD_BPE)
    texts = ["one two three four", "two five six", "one one nine"]
    assert [t.encode(x) for x in texts] == u.encode_batch(texts)


def test_a_repeated_id_is_sampled_once(spark, documents):
    rows = [(k, f"word{k % 7} text{k} {'bad' if k % 2 else 'good'} line") for k in range(300)] + [(5, f"again {k}") for k in range(2000)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(300)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    sample = linear.labelled(docs, labels, "toxic", F.lit(True), "doc_id", "text", 100).collect()
    assert len(sample) == len({r["doc_id"] for r in sample}) == 100
    assert {r["y"] for r in sample} == {0, 1} and sum(r["y"] for r in sample) == 50
    # the same row whatever the partitions
    again = linear.labelled(docs.repartition(7, "text"), labels, "toxic", F.lit(True), "doc_id", "text", 100).collect()
    assert sorted(map(tuple, sample)) == sorted(map(tuple, again))
    few, every = (linear.gather(linear.labelled(docs, labels, "quality", F.lit(True), "doc_id", "text", 300), quality.ngrams, least_texts=1, most_features=n) for n in (20, None))
    assert len(few.keys) == 20 < len(every.keys) and set(few.keys.tolist()) < set(every.keys.tolist())
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        found = scores(docs, labels, most_labelled=200, most_features=None)
        assert found.count() == len(rows)
