from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from almanac.llm import warc

SCHEMA = "record_id long, kind string, url string, at timestamp, status int, headers array<struct<name:string,value:string>>, payload string, canonical int, source_id int"
T = datetime(2024, 1, 1)


def resolve(spark, rows):
    df = spark.createDataFrame([(i, k, u, None if h is None else T + timedelta(hours=h), 200 if k == "response" else 304, hs, p, 0, 0) for i, k, u, h, hs, p in rows], SCHEMA)
    return {r.record_id: r for r in warc.resolve(df).collect()}


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@WWW.Ex.COM:80/a/?b=2&utm_x=1&a=1#f": "ex.com/a?a=1&b=2",
        "https://ex.com": "ex.com",
        "https://ex.com/?": "ex.com",
        "https://ex.com:8080/A//": "ex.com:8080/A",
        "ftp:nothing ": "ftp:nothing",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_outcomes_and_merging(spark):
    e = lambda v: [("ETag", v)]
    rows = [
        (1, "response", "http://a.com/x", 0, [("Content-Type", "text/html"), ("ETag", '"1"'), ("Date", "old")], "one"),
        (2, "response", "https://www.a.com/x/", 5, [("ETag", 'W/"2"'), ("Last-Modified", "m")], "two"),
        (3, "revisit", "http://A.com/x#f", 3, [("etag", '"1"'), ("date", "new"), ("Content-Type", "no"), ("Connection", "no")], None),
        (4, "revisit", "http://a.com/x", 6, e('"2"'), None),
        (5, "revisit", "http://a.com/x", 7, e('"1"'), None),
        (6, "revisit", "http://a.com/x", 0, e('"1"'), None),
        (7, "revisit", "http://a.com/x", 8, None, None),
        (8, "revisit", "http://a.com/x", 8, [("Last-Modified", "m")], None),
        (9, "revisit", None, 8, None, None),
        (10, "revisit", "http://a.com/x", None, None, None),
        (11, "revisit", "http://b.com/", 9, None, None),
        (12, "response", "http://a.com/x", 5, e('"tie"'), "tie"),
    ]
    got = resolve(spark, rows[:-1])
    assert {i: (r.outcome, r.source_id) for i, r in got.items()} == {3: ("merged", 1), 4: ("merged", 2), 5: ("mismatch", 2), 6: ("no_earlier", None), 7: ("unverified", 2), 8: ("merged", 2), 9: ("no_url", None), 10: ("no_url", None), 11: ("no_earlier", None)}
    assert [tuple(h) for h in got[3].headers] == [("content-type", "text/html"), ("date", "new"), ("etag", '"1"')]
    assert (got[3].payload, got[3].status, got[5].payload, got[5].headers) == ("one", 200, None, None)
    assert resolve(spark, rows)[5].source_id == 12  # of responses at one time, the greatest id


@pytest.mark.parametrize("meet", [4096, 5])
def test_hot_url_against_brute_force(spark, monkeypatch, meet):
    monkeypatch.setattr(warc, "MEET", meet)
    rows, want = [], {}
    answers = [(i, i % 37 * 10 + i % 3) for i in range(0, 900, 3)]
    rows += [(i, "response", "http://hot.com/", h, [("ETag", "x")], f"b{i}") for i, h in answers]
    for i in range(5000, 5600):
        h = i * 7 % 400
        rows.append((i, "revisit", f"http://hot.com/#{i}", h, [("ETag", "x")], None))
        want[i] = max(((t, a) for a, t in answers if t < h), default=(0, None))[1]
    rows += [(9000 + i, "revisit", f"http://u{i}.com/", i, None, None) for i in range(50)]
    got = resolve(spark, rows)
    assert {i: r.source_id for i, r in got.items() if i < 9000} == want
    assert all(r.payload == (f"b{r.source_id}" if r.source_id is not None else None) for r in got.values())


def test_empty_and_repeats(spark):
    assert resolve(spark, []) == {}
    rows = [(1, "response", "http://a.com", 0, [("etag", "x")], "p")] + [(2, "revisit", "http://a.com", 1, [("etag", "x")], None)] * 3
    df = spark.createDataFrame([(i, k, u, T + timedelta(hours=h), 200, hs, p, 0, 0) for i, k, u, h, hs, p in rows], SCHEMA)
    assert [(r.record_id, r.payload) for r in warc.resolve(df).collect()] == [(2, "p")] * 3


def test_clashing_columns_are_ignored(spark):
    rows = [(1, "response", "http://a.com", T, 200, [("etag", "x")], "p", "a", 1, 2), (2, "revisit", "http://a.com", T + timedelta(hours=1), 304, [("etag", "x")], None, "b", 3, 4)]
    df = spark.createDataFrame(rows, SCHEMA.split(", canonical")[0] + ", outcome string, lot int, lots int")
    assert [(r.record_id, r.outcome, r.source_id, r.payload) for r in warc.resolve(df).collect()] == [(2, "merged", 1, "p")]


def test_repeated_and_null_ids_are_each_resolved_by_their_own_time(spark):
    e = [("etag", "1")]
    rows = [
        (1, "response", "http://a.com", T + timedelta(days=1), e, "one"),
        (2, "response", "http://a.com", T + timedelta(days=3), [("etag", "2")], "two"),
        (5, "response", "http://b.com", T, e, "b"),
        (None, "response", "http://a.com", T + timedelta(days=1, hours=5), e, "no id"),
        *[(9, "revisit", "http://a.com", T + timedelta(days=d), e, None) for d in (2, 4)],
        (9, "revisit", "http://b.com", T + timedelta(days=2), e, None),
        *[(None, "revisit", u, T + timedelta(days=2), e, None) for u in ("http://a.com", "http://c.com", None)],
        (None, "revisit", "http://a.com", None, e, None),
    ]
    df = spark.createDataFrame([(i, k, u, at, 200, h, p) for i, k, u, at, h, p in rows], SCHEMA.split(", canonical")[0])
    got = sorted(((r.record_id, r.url, r.at and (r.at - T).days, r.outcome, r.source_id, r.payload) for r in warc.resolve(df).collect()), key=str)
    want = [
        (9, "http://a.com", 2, "merged", 1, "one"), (9, "http://a.com", 4, "mismatch", 2, None), (9, "http://b.com", 2, "merged", 5, "b"),
        (None, "http://a.com", 2, "merged", 1, "one"), (None, "http://c.com", 2, "no_earlier", None, None), (None, None, 2, "no_url", None, None), (None, "http://a.com", None, "no_url", None, None),
    ]
    assert got == sorted(want, key=str)
