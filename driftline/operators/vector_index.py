"""A stored table of vectors by nearest centroid: upserted by key, probed by cell, with an exact way over all rows.

Centroids come from a sample of bounded size; every row is indexed.  A table keeps its
vectors in folders by cell, so that a probe reads the cells that it asks for and no others.
Queries go to all tasks in blocks of bounded size; each task gives the best of its rows
for each query, and those few meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that centroids are learned from, and queries of a block, at most.
SAMPLE_ROWS, QUERY_ROWS = 20_000, 4_096
#: Centroids stay as they were between so many rounds at most.
ROUNDS = 25


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-30)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; null ones are zero."""
    rows = [v if v is not None else [] for v in column.to_pylist()]
    size = max(map(len, rows), default=0)
    out = np.zeros((len(rows), size))
    for i, v in enumerate(rows):
        if v:
            out[i, : len(v)] = v
    return out


def centroids(vectors: DataFrame, vector: str, key: str, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> np.ndarray:
    """Unit centroids of a sample of the vectors, picked by a hash of the key, by spherical k-means."""
    sample = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample_rows)
    x = unit(matrix(sample.select(vector).toArrow().column(0).combine_chunks()))
    if not len(x):
        return np.zeros((1, 1))
    found = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(ROUNDS):
        cell = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, x)
        moved = np.where((sums != 0).any(axis=1, keepdims=True), unit(sums), found)
        if np.allclose(moved, found):
            break
        found = moved
    return found


def assigned(vectors: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Adds cell, the number of the nearest centroid."""
    names, held = vectors.columns, vectors.sparkSession.sparkContext.broadcast(centres)
    place = names.index(vector)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(place))
            x = np.pad(x, ((0, 0), (0, held.value.shape[1] - x.shape[1]))) if x.shape[1] < held.value.shape[1] else x
            cell = (unit(x) @ held.value.T).argmax(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*names, "cell"])

    return vectors.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes) + ", cell int")


class VectorTable:
    """A table of (key, vector, cell), with its centroids, under a path that the cluster shares.

    An upsert writes a whole new version beside the last one; it counts once its number is in the
    table of versions, which is written last, so readers never see part of one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    def _at(self, version: int) -> str:
        return f"{self.path}/rows/version={version}"

    def version(self) -> int:
        """The number of the last whole version."""
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            raise ValueError(f"no table at {self.path}") from None

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self._at(self.version()))

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r["centre"] for r in found])

    def create(self, vectors: DataFrame, cells: int) -> None:
        centres = centroids(vectors, self.vector, self.key, cells)
        self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{self.path}/centroids")
        self._write(vectors.select(self.key, self.vector), centres, 0)

    def _write(self, vectors: DataFrame, centres: np.ndarray, version: int) -> None:
        # a salt by key spreads a cell that holds many rows over several files
        salt = F.pmod(F.xxhash64(self.key), F.lit(8))
        assigned(vectors, self.vector, centres).repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(self._at(version))
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def upsert(self, vectors: DataFrame) -> None:
        """Replaces the rows of the given keys and adds new ones; of equal keys given, the one with the least vector counts."""
        version = self.version() + 1
        fresh = vectors.groupBy(self.key).agg(F.min(self.vector).alias(self.vector))
        kept = self.rows().drop("cell").join(fresh.select(self.key), self.key, "left_anti")
        self._write(kept.unionByName(fresh), self.centres(), version)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, similarity, rank): the k most like each query (key, vector), from the ``probes`` nearest cells, or from all rows."""
        centres = self.centres() if probes is not None else None
        return nearest_to_each(self.rows(), queries, self.key, self.vector, k, centres, probes)


def nearest_to_each(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, centres: np.ndarray | None = None, probes: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, key, similarity, rank): the k rows most like each query by cosine, ties by key; exact over the rows that are read."""
    spark = rows.sparkSession
    asked = queries.select(F.col(key).alias("query"), vector)
    blocks, found = max(1, -(-asked.count() // query_rows)), None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
        x = unit(matrix(mine.column(1).combine_chunks()))
        wanted = None if centres is None else np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        source = rows
        if wanted is not None:
            # only cells that some query of the block asks for are read
            source = rows.where(F.col("cell").isin(np.unique(wanted).tolist()))
        held = spark.sparkContext.broadcast((mine.column(0).to_pylist(), x, wanted))

        def run(batches, held=held):
            ids, x, wanted = held.value
            best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
            for batch in batches:
                y = unit(matrix(batch.column(1)))
                if not len(y) or not len(ids):
                    continue
                size = max(x.shape[1], y.shape[1])
                like = np.pad(x, ((0, 0), (0, size - x.shape[1]))) @ np.pad(y, ((0, 0), (0, size - y.shape[1]))).T
                keys, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for q in range(len(ids)):
                    ok = slice(None) if wanted is None else np.isin(cells, wanted[q])
                    score, name = np.concatenate([best[q][0], like[q][ok]]), np.concatenate([best[q][1], keys[ok]])
                    order = np.lexsort((name, -score))[:k]
                    best[q] = score[order], name[order]
            for q, (score, name) in zip(ids, best, strict=True):
                if len(name):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(name), pa.int64()), pa.array(name, pa.int64()), pa.array(score)], ["query", "key", "similarity"])

        cell = F.col("cell") if wanted is not None else F.lit(0)
        part = source.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector, cell.cast("int").alias("cell")).mapInArrow(run, "query long, key long, similarity double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, recall): which part of the exact answers a search has found."""
    hit = exact.join(found.select("query", "key", F.lit(1).alias("_hit")), ["query", "key"], "left")
    return hit.groupBy("query").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
