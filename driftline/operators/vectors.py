"""Vector retrieval and the learning state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], vector: str, key: str, k: int) -> DataFrame:
    """The k vectors most like a query."""
    like = cosine(F.col(vector), F.array(*map(F.lit, query)))
    return vectors.select(key, like.alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(k)


def text_vector(text: Column, size: int = 384) -> Column:
    """A reproducible unit vector of a text, from hashes of it; a stand-in where no model is at hand."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(2_000_001)) / 1_000_000.0 - 1)
    return F.transform(raw, lambda x: x / F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, y: s + y * y)))


def learn(state: DataFrame, bias: DataFrame) -> DataFrame:
    """The state after new findings (category, severity, snippet): a category's newest replaces it, snippets that are new are added."""
    newest = state.select("category", "severity", "snippet", "at").unionByName(bias.select("category", "severity", "snippet", "at"))
    latest = newest.groupBy("category").agg(F.max_by("severity", "at").alias("severity"), F.max("at").alias("at"), F.array_sort(F.collect_set("snippet")).alias("snippets"))
    return latest.select("category", "severity", "at", "snippets")
