"""The vector table, and results met by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import compare, vector_index
from driftline.plans.base import table

SF = "/root/testdata/sf0.01"


def plain_nearest(rows, query, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-30)
    return [x[1] for x in sorted((-float(unit(v) @ unit(query)), key) for key, v in rows)[:k]]


def test_vector_table(spark, tmp_path):
    vectors = table(spark, SF, "embeddings").select("vec_id", "embedding")
    index = vector_index.VectorTable(spark, str(tmp_path / "t"), "vec_id", "embedding")
    with pytest.raises(ValueError, match="no table"):
        index.rows()
    index.create(vectors.where("vec_id < 400"), 16)
    assert index.rows().count() == 400 and index.rows().select("cell").distinct().count() > 8
    # later rows are added, and a key that is there is replaced
    changed = vectors.where("vec_id = 3").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    index.upsert(vectors.where("vec_id >= 400").unionByName(changed))
    rows = [(r["vec_id"], r["embedding"]) for r in index.rows().collect()]
    assert sorted(k for k, _ in rows) == list(range(500)) and dict(rows)[3] == changed.first()["embedding"]
    queries = vectors.where("vec_id % 100 = 0")
    exact = index.search(queries, 10)
    got = {}
    for r in exact.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["key"])
    assert got == {r["vec_id"]: plain_nearest(rows, r["embedding"], 10) for r in queries.collect()}
    found = vector_index.recall(index.search(queries, 10, 12), exact).collect()
    assert len(found) == 5 and np.mean([r["recall"] for r in found]) >= 0.9
    # a probe of all cells is exact
    assert min(r["recall"] for r in vector_index.recall(index.search(queries, 10, 16), exact).collect()) == 1


def test_probes_read_their_cells_only(spark, tmp_path):
    vectors = table(spark, SF, "embeddings").select("vec_id", "embedding")
    index = vector_index.VectorTable(spark, str(tmp_path / "t"), "vec_id", "embedding")
    index.create(vectors, 16)
    plan = index.search(vectors.where("vec_id = 0"), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan.replace("\n", "") or "cell" in plan.split("PartitionFilters:")[1][:80]


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [])], "vec_id long, embedding array<double>")
    found = vector_index.nearest_to_each(rows, rows.where("vec_id = 1"), "vec_id", "embedding", 9, query_rows=1)
    assert [(r["key"], round(r["similarity"], 6)) for r in found.orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (3, 0.0), (5, 0.0)]
    assert vector_index.nearest_to_each(rows.limit(0), rows, "vec_id", "embedding", 3).count() == 0


def test_queries_go_in_blocks(spark):
    vectors = table(spark, SF, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0")
    one, many = (sorted(map(tuple, vector_index.nearest_to_each(vectors, queries, "vec_id", "embedding", 4, query_rows=n).select("query", "key", "rank").collect())) for n in (100, 3))
    assert one == many and len(one) == 40


def test_differences(spark):
    left = spark.createDataFrame([(1, "a", 1.0, 5.0), (2, "a", 2.0, None), (3, None, 3.0, 1.0), (4, "x", 4.0, 1.0)], "k int, s string, v double, w double")
    right = spark.createDataFrame([(1, "a", 1.0005, None), (2, "a", 2.5, None), (3, None, 3.0, 1.0), (9, "y", 0.0, 0.0), (10, "y", 0.0, 0.0)], "k int, s string, v double, w double")
    got = {r["column"]: tuple(r)[1:] for r in compare.differences(left, right, ["k", "s"], ["v", "w"], 0.001).collect()}
    assert got["v"] == (3, 1, 2, 1, 0.5) and got["w"] == (3, 1, 2, 1, 0.0)
