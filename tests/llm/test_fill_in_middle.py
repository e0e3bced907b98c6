import hashlib
import re

import duckdb
import numpy as np
import pytest

from driftline.llm import fill_in_middle as fim


def plain(doc_id, text):
    """The contract, read off unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), output, text


ODD = ["a<P>b", "x <S", "<M>", "<P <S <M", "é", "aé", "éa", "Z", "a b", "ab1cd", "日本 word 語x", "\n\n", "😀a😀", "<", "<<P", "P>", "a<", "\x00a\x00"]


def rows_of(odd_rows):
    rows = list(odd_rows) + [(100 + k, t) for k, t in enumerate(ODD)] + [(1000 + k, t * 3 + str(k)) for k, t in enumerate(ODD * 6)]
    return rows + [(5000 + k, ("ab é,"[: k % 6] or "q") * (k * 37)) for k in range(60)] + [(9000, "letters" * 3000), (9001, "é" * 9000), (9002, "a é" * 5000)]


@pytest.mark.parametrize("chunk", [3, 7, 64, 4096])
def test_equals_the_contract_whatever_the_chunks(spark, documents, odd_rows, chunk):
    rows = rows_of(odd_rows)
    found = fim.transform(documents(rows), chunk=chunk)
    got = sorted((tuple(r) for r in found.withColumn("text", fim.restored()).collect()), key=repr)
    assert got == sorted((plain(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_given_rates(documents):
    assert fim.transform(documents([])).count() == 0
    rows = [(k, f"word {k} more") for k in range(50)]
    assert {r["form"] for r in fim.transform(documents(rows), rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(documents(rows), rate=100, spm=100).collect()} == {"spm"}


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    text = ("word é, " * 40_000).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    chunks = fim.Chunks(data, np.array([0, len(text)]))
    n = int(chunks.lengths()[0])
    seen, real = [], fim.openings
    monkeypatch.setattr(fim, "openings", lambda d, low, high: seen.append(high - low) or real(d, low, high))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())
    assert n == len(units)
    for rank in (0, 1, n // 3, n - 1, n):
        byte, point = chunks.cuts(np.array([rank]))
        assert text[: byte[0]].decode() == "".join(units[:rank]) and point[0] == sum(map(len, units[:rank]))
    assert len(seen) == 4 and max(seen) <= fim.CHUNK


def test_query_equals_sql(spark, sf, documents, odd_rows):
    rows = [r for r in rows_of(odd_rows) if r[0] is not None and "\x00" not in (r[1] or "")]
    folder = sf(documents=documents(rows).select("doc_id", "text"))
    duckdb.sql("SET threads=2")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(fim.SQL).fetchall()
    found = fim.query(spark, folder)
    assert found.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
