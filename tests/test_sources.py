"""Readers, stores and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import feeds, logs, records, sitemaps, store
from lodestar.streaming import audits

LINES = [
    '1.2.3.4 - bob [10/Oct/2025:13:55:36 +0200] "GET https://ex.com/a?x=1#f HTTP/1.1" 200 12 "http://ref" "Googlebot \\"x\\""', '1.2.3.4 - - [10/Oct/2025:13:55:36 +0000] "GET /b? HTTP/1.0" 503 -', "", "garbage",
    '1.2.3.4 - - [99/Oct/2025:13:55:36 +0000] "GET /b HTTP/1.0" 503 -', '1.2.3.4 - - [10/oct/2025:23:00:00 -0200] "get /b HTTP/1.0" 503 -',
]


def test_access_log(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(LINES))
    parsed = logs.read_access_log(spark, str(tmp_path / "log"))
    rows = logs.hits(parsed).select(F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "method", "path", "status", "user_agent", "parameterised").collect()
    assert [tuple(r) for r in rows] == [("2025-10-10 11:55", "GET", "/a", 200, 'Googlebot "x"', True), ("2025-10-10 13:55", "GET", "/b", 503, "", False)]
    assert logs.skipped(parsed) == 3 and "bob" not in str(rows) and "1.2.3.4" not in str(rows)


def test_feeds(spark, tmp_path):
    tsv = tmp_path / "f.tsv"
    tsv.write_text("id\tlink\tprice\tavailability\tg:gtin\n1\thttps://ex.com/a\t9.50 EUR\tIn_Stock\t0123\n2\thttps://ex.com/b\t3 SEK\tout_of_stock\t\n")
    out = feeds.items(feeds.read_tsv(spark, str(tsv))).orderBy("id").collect()
    assert [(r.id, r.price, r.currency, r.availability, r.gtin, r.brand) for r in out] == [("1", 9.5, "EUR", "in stock", "0123", None), ("2", 3.0, "SEK", "out of stock", None, None)]
    xml = tmp_path / "f.xml"
    xml.write_text('<rss xmlns:g="http://base.google.com/ns/1.0"><channel><item><g:id>1</g:id><link>https://ex.com/a?x=1&amp;y=2</link><g:price>9.50 EUR</g:price><g:availability>in stock</g:availability></item></channel></rss>')
    assert feeds.items(feeds.read_rss(spark, str(xml))).first().link == "https://ex.com/a?x=1&y=2"
    tsv.write_text("id\tlink\tprice\tavailability\n1\tex.com\t9,50\tx\n1\thttps://ex.com/b\t3 SEK\t\n")
    with pytest.raises(ValueError, match="id is repeated"):
        feeds.items(feeds.read_tsv(spark, str(tsv)))
    tsv.write_text("id\tlink\n")
    with pytest.raises(ValueError, match="price, availability"):
        feeds.read_tsv(spark, str(tsv))


SITEMAP = b"""<?xml version="1.0"?><urlset xmlns:news="n" xmlns:video="v"><url><loc> https://ex.com/a </loc><news:news><news:publication><news:name>P</news:name><news:language>en</news:language></news:publication>
<news:publication_date>2026-01-01</news:publication_date><news:title>T &amp; U</news:title></news:news></url><url><loc>https://ex.com/b</loc><video:video><video:title>V</video:title><video:content_loc>c</video:content_loc></video:video></url></urlset>"""


def test_sitemaps(spark):
    index = b"<sitemapindex><sitemap><loc>https://ex.com/1.xml</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([("a", SITEMAP), ("cut", SITEMAP[:-60]), ("gz", gzip.compress(SITEMAP)), ("index", index), ("none", b""), ("null", None)], "url string, body binary")
    out = {r.url: r for r in sitemaps.parsed(docs).collect()}
    assert out["a"].urls == ["https://ex.com/a", "https://ex.com/b"] and not out["a"].cut and out["a"].news[0].title == "T & U" and out["a"].news[0].publication_name == "P" and out["a"].video[0].content_url == "c"
    assert out["cut"].urls == ["https://ex.com/a"] and out["cut"].cut and out["gz"].urls == out["a"].urls and out["index"].sitemaps == ["https://ex.com/1.xml"] and out["index"].urls == []
    assert out["none"].urls == [] == out["null"].urls


def test_catalogue(spark, tmp_path):
    entry = {"id": "1.1", "phase": 1, "automation": "automated", "launchGate": True, "applicability": {"universal": True}, "detectors": ["http-status"]}
    (tmp_path / "phase-1.json").write_text(json.dumps([entry]))
    row = records.catalogue(spark, str(tmp_path)).first()
    assert (row.id, row.launch_gate, row.detectors) == ("1.1", True, ["http-status"])
    (tmp_path / "phase-2.json").write_text(json.dumps([entry, {**entry, "id": "2.1", "phase": 9, "automation": "magic"}]))
    with pytest.raises(ValueError, match=r"2\.1: automation 'magic' is unknown; 2\.1: phase is not one of 0 to 7; 1\.1: repeated"):
        records.catalogue(spark, str(tmp_path))


def test_lighthouse(spark, tmp_path):
    snippet = '<img src="/hero.png" loading="lazy" class="x">'
    report = {
        "finalDisplayedUrl": "https://ex.com/", "fetchTime": "2026-01-01T00:00:00Z", "configSettings": {"formFactor": "mobile"},
        "audits": {"largest-contentful-paint": {"numericValue": 2100.5}, "largest-contentful-paint-element": {"details": {"items": [{"items": [{"node": {"snippet": snippet}}]}]}}},
    }
    (tmp_path / "r.json").write_text(json.dumps(report))
    r = records.lighthouse_reports(spark, str(tmp_path / "r.json")).first()
    assert (r.url, r.test_profile, r.metrics) == ("https://ex.com/", "mobile", {"lcp": 2100.5}) and (r.lcp_element.tag, r.lcp_element.src, r.lcp_element.loading) == ("img", "/hero.png", "lazy")


def test_import_is_all_or_nothing(spark):
    ddl = "site_id string, run_id string, result string"
    log = spark.createDataFrame([("s", "1", "passed"), ("s", "2", "passed")], ddl)
    new, wrong = records.import_runs(log, spark.createDataFrame([("s", "1", "passed"), ("s", "3", "failed")], ddl))
    assert [r.run_id for r in new.collect()] == ["3"] and wrong.count() == 0
    _, wrong = records.import_runs(log, spark.createDataFrame([("s", "2", "failed")], ddl))
    assert wrong.count() == 1


def test_blobs(spark):
    bodies = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "body string")
    stored = store.blobs(bodies)
    assert stored.count() == 2 and all(r.path == f"sha256/{r.hash[:2]}/{r.hash[2:]}" for r in stored.collect())
    assert store.put_if_absent(stored, stored.limit(1)).count() == 1
    good = stored.where("body = 'a'").first().hash
    renders = spark.createDataFrame([(1, good), (2, None), (3, "f" * 64), (4, "0" * 64)], "id int, body_hash string")
    broken = stored.select("hash", "body").union(spark.createDataFrame([("0" * 64, "z")], "hash string, body string"))
    assert {r.id: r.state for r in store.read_back(renders, broken).collect()} == {1: "ok", 2: "not-stored", 3: "missing", 4: "corrupt"}


def test_walk_and_variants(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "source string, target string")
    out = store.frontier(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()
    assert {(r.url, r.depth) for r in out} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    sites = spark.createDataFrame([("1", "https://www.ex.com"), ("2", "http://localhost:80"), ("3", "http://1.2.3.4"), ("4", "http://single")], "crawl_id string, origin string")
    assert sorted(r.url for r in store.host_variants(sites).collect()) == ["http://ex.com/", "http://www.ex.com/", "https://ex.com/"]


def test_streams_agree_with_batches(spark, tmp_path):
    lines = spark.createDataFrame([(line,) for line in LINES[:2] * 3], "value string")
    lines.write.text(str(tmp_path / "logs"))
    counted = audits.run_to_end(audits.daily_hits(spark.readStream.text(str(tmp_path / "logs"))), "hits_by_day")
    assert [(r.hits, r.errors) for r in counted.collect()] == [(3, 0)]
    pages = spark.createDataFrame([("https://ex.com/a", "<title>T</title>"), ("https://ex.com/b", None)], "url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    stream = audits.extracted_stream(audits.arriving_pages(spark, str(tmp_path / "pages"), "url string, html string"))
    query = audits.observe_stream(stream, lambda b: b.select("normalized_url", F.col("extracted.title").alias("title")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert {(r.normalized_url, r.title) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("https://ex.com/a", "T"), ("https://ex.com/b", None)}
