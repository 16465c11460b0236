import base64
import hashlib

from tablegauge.llm import webarchive as w
from tablegauge.session import scratch_folder, staged


def build(spark, pages, **more):
    folder = scratch_folder(spark, "test")
    captures = staged(w.write_archives(pages, f"{folder}/warc", **more), "captures")
    return captures, staged(w.build_index(captures, f"{folder}/index", block_lines=3), "directory")


def test_round_trip_lookup_and_revisits(spark):
    html = lambda i: None if i == 4 else "" if i == 5 else "same" if i % 3 == 0 else f"<p>{i} é</p>" * (i * 50)
    rows = [(i, f"http://www.h{i % 4}.example.com/p?{i}#x" if i else None, html(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS offset", "'x' AS archive").repartition(3)
    captures, directory = build(spark, pages)
    found = {r.page_id: r for r in w.read_back(directory, "bigint").collect()}
    first = {}
    for i, _, text in rows:
        payload = (text or "").encode()
        first.setdefault(payload, i)
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[payload] == i else ("revisit", first[payload]))
    lookup = w.Lookup([tuple(r)[:5] for r in directory.collect()])
    for i, url, text in rows:
        hits = lookup.captures(url)
        assert [h["page_id"] for h in hits] == [i]
        if hits[0]["record_type"] == "response":
            assert w.read_payload(hits[0]) == (text or "").encode()
    assert lookup.captures("http://nowhere.example.org/") == []


def test_hot_url_and_payload_over_blocks(spark):
    pages = spark.range(30).selectExpr("id AS page_id", "'http://one.example/' AS url", "if(id % 2 = 0, 'a', 'long ' || id) AS html")
    _, directory = build(spark, pages, min_bytes=4)
    assert {r.record_type for r in w.read_back(directory, "bigint").collect()} == {"response"}
    hits = w.Lookup([tuple(r)[:5] for r in directory.collect()]).captures("HTTP://one.example/#top")
    assert sorted(h["page_id"] for h in hits) == list(range(30)) and directory.count() >= 10


def test_nulls_repeats_and_empty_table(spark):
    pages = spark.createDataFrame([(None, None, "x"), (2, "u", "x"), (2, "u", "x"), (3, "u", "x")], "page_id long, url string, html string")
    _, directory = build(spark, pages)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in w.read_back(directory, "bigint").collect()) == [
        (0, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 2)]
    _, directory = build(spark, pages.limit(0))
    assert w.read_back(directory, "bigint").count() == 0


def test_url_keys():
    assert w.url_key("https://www.a.Example.com:8080/P?q=1#f") == "com,example,a:8080)/p?q=1"
    assert w.url_key("http://a.b") == "b,a)/" and w.url_key(None) == ""
