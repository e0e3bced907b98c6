from collections import Counter

import corpus_pipeline
from driftline.llm import registry
from driftline.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pass_on_what_they_keep(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"] for r in docs.collect()}
        assert left and left <= ids
        if number + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            if name in ("exact_dedup", "near_dedup"):
                texts = Counter((r["text"] or "").lower() for r in docs.collect())
                assert max(texts.values()) == 1
        else:
            assert left == ids
        ids = left
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.collect()} == ids


def test_stages_on_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, documents([]), SF).count() == 0


def test_one_row_of_repeated_ones_stays(spark, documents, odd_rows):
    left = corpus_pipeline.exact_duplicates(spark, documents(odd_rows), SF).collect()
    assert Counter((r["text"] or "").lower() for r in left) == Counter(set((t or "").lower() for _, t in odd_rows))


def test_all_queries_are_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def components(texts, width, percent):
    """Plain components of texts by their sets of word runs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and min(len(a), len(sets[j])) * 100 >= percent * max(len(a), len(sets[j])) and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_near_stage_keeps_one_of_each_plain_component(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = components([r["text"] for r in rows], 5, 80)
    place = {r["doc_id"]: i for i, r in enumerate(rows)}
    kept = [want[place[r["doc_id"]]] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(kept) == len(set(kept)) == len(set(want))


def test_rows_with_null_and_equal_ids_are_judged_each(spark, documents):
    a, b = ("one two three four five six seven " * 3 + tail for tail in ("eight nine", "ten"))
    docs = documents([(None, a), (None, a + " again and again"), (None, b * 9 + " other words all along"), (7, a), (7, "another text of quite a few words here"), (7, a)])
    left = [r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(left) == len(set(components(left, 5, 80))) and "another text of quite a few words here" in left
    assert set(components([*left, a], 5, 80)) == set(components(left, 5, 80))
