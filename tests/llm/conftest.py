import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text[, source]) rows, with columns whose names clash with those of operators."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        from pyspark.sql import functions as F

        clash = ("id", "row", "digest", "kept", "score", "host", "line", "cls", "root", "key", "n", "shard", "bands", "words", "label", "y", "part")
        return df.withColumns({c: F.lit("clash") for c in clash})

    return make


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """Writes tables to a folder as the queries read them."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


PROSE = "the quick brown fox jumps over the lazy dog while rain falls on quiet hills and rivers run to the wide open sea beyond"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated and very long texts, and null ids."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (None, PROSE.upper()), (5, "word " * 60_000), (6, "x" * 300_000), (7, "Ünïcödé é\u00a0b")]
