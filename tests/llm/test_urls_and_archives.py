import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import urls, warc
from driftline.llm.shared import new_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "sha1", "row", "digest", "payload", "bad")})


def test_parts_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?x#y", ""), (2, "https://a.example.com/en/1", ""), (3, "http://example.com", ""), (4, "http://x.net/es/9", ""), (5, "http://notexample.org/en/", ""),
        (6, None, ""), (7, "no scheme/en/", ""), (8, "a://b://c/d", ""), (9, "http://com/q", ""), (10, "http://h.org?q=/en/", ""), (11, "http://ÄÖ.com/É", ""), (11, "http://ÄÖ.com/É", ""),
    ]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages(spark, rows), labels).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/1", "example.com/en/", "block"), 3: ("example.com", "", None, "allow"), 4: ("x.net", "/es/9", "net/es/", "block"),
        5: ("notexample.org", "/en/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("b:", "//c/d", None, "allow"), 9: ("com", "/q", "com/", "allow"), 10: ("h.org", "", None, "allow"), 11: ("ÄÖ.com".replace("A", "a"), "/É", "com/", "allow"),
    }
    assert urls.judge(pages(spark, []), labels).count() == 0


def test_bad_hosts_are_blocked_and_rare_ones_are_not(spark):
    rows = [(k, f"http://bad.spam.org/x/{k}", "") for k in range(60)] + [(100 + k, f"http://good{k % 5}.fine.org/x/{100 + k}", "") for k in range(100)]
    rows += [(300, "http://once.fine.org/x/300", ""), (301, "http://new.fine.org/x/y", "")]
    labels = [(k, 0, 0) for k in range(60)] + [(100 + k, 1, 0) for k in range(100)] + [(300, None, 1)]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[k]["verdict"] == "block" for k in range(60))
    assert all(got[100 + k]["verdict"] == "allow" for k in range(100))
    assert got[300]["verdict"] == "allow" and 0 < got[300]["bad_rate"] < 1  # one bad page does not make a bad host
    assert got[301]["verdict"] == "allow"


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, least):
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", "".join(rng.choice("ab<é>\r\n") for _ in range(rng.randrange(4000)))) for k in range(300)]
    rows += [(400, None, None), (401, "http://x y/\n", ""), (402, "u", rows[5][2]), (403, "u", rows[5][2]), (None, "u", "unique null id"), (404, "u", "z" * 3_000_000), (405, "r", "twice given"), (405, "r", "twice given"), (406, "s", "short"), (407, "s", "short")]
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, rows), folder, min_bytes=least)
    got = warc.read_records(index, folder, keep_payload=True).collect()
    assert len(got) == len(rows) == index.count()
    first = {}
    for d, _, h in rows:
        first.setdefault((h or "").encode(), []).append(-1 if d is None else d)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"]) and r["payload_bytes"] == len(r["payload"])
            assert r["refers_to"] is None
    text = {d: (h or "").encode() for d, _, h in rows}
    responses = {}
    for r in got:
        body = text[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r["record_type"] == "revisit":
            assert len(body) >= least and r["refers_to"] == max(first[body])
        else:
            responses[body] = responses.get(body, 0) + 1
    for body, n in responses.items():
        assert n == (1 if len(body) >= least else len(first[body]))


def test_selected_records_are_read_by_few_ranges(spark):
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, [(k, f"http://h/{k}", "x" * k) for k in range(100)]), folder)
    got = warc.read_records(index.where("page_id % 10 = 3"), folder)
    assert sorted(r["page_id"] for r in got.collect()) == list(range(3, 100, 10))
    assert warc.ranges([(0, 10), (10, 10), (50, 5), (100, 10)], gap=30, most=60) == [[0, 55, 3], [100, 110, 1]]
    assert warc.read_records(warc.write_archives(pages(spark, []), folder), folder).count() == 0
