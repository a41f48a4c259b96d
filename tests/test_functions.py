"""URLs, robots.txt, documents and structured data."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.functions import images, language, robots
from lodestar.functions import url as U
from lodestar.functions.extract import extract


@pytest.mark.parametrize(
    ("text", "normal"),
    [
        ("HTTP://Example.COM:80", "http://example.com/"), ("https://ex.com:443/a/../b?utm_source=x&q=1#f", "https://ex.com/b?q=1"), ("https://ex.com/?utm_source=x", "https://ex.com/"),
        ("https://ex.com/?a=1&b=2", "https://ex.com/?a=1&b=2"), ("https://ex.com/a b", "https://ex.com/a%20b"), ("https://ex.com/für", "https://ex.com/f%C3%BCr"), ("ftp://ex.com/", None), ("/a", None),
        ("http://", None), ("https://ex.com/?ref=x", "https://ex.com/?ref=x"), ("http://bücher.de/", "http://xn--bcher-kva.de/"), ("https://ex.com:8080/x/", "https://ex.com:8080/x/"), ("http://ex.com:99999/", None), (None, None),
    ],
)
def test_normalize(text, normal):
    assert U.normalize(text) == normal


@given(st.text(max_size=40))
def test_normalizing_twice_changes_nothing(text):
    once = U.normalize("https://example.com/" + text)
    assert once is None or U.normalize(once) == once


@pytest.mark.parametrize(
    ("href", "found"),
    [("../x", "https://b.org/x"), ("?q", "https://b.org/d/e?q"), ("//c.org/y", "https://c.org/y"), ("", None), (" #x", None), ("mailto:a@b", "mailto:a@b"), ("g#h", "https://b.org/d/g#h"), ("/", "https://b.org/")],
)
def test_resolve(href, found):
    assert U.resolve(href, "https://b.org/d/e?z#f") == found


def test_parts_of_urls():
    assert U.same_site("https://a.com/x", "https://A.com") and not U.same_site("https://a.com:8443/", "https://a.com") and not U.same_site("https://www.a.com/", "https://a.com")
    assert U.path_depth("https://a.com/b//c/") == 2 and U.registrable_domain("www.a.co") == "a.co" and U.registrable_domain("localhost") is None and U.registrable_domain("1.2.3.4") is None
    assert U.is_tracking("UTM_anything") and U.is_tracking("gclid") and not U.is_tracking("ref")
    assert U.template("/a/12/foo-bar/deadbeef01/x1/") == "/a/:id/:slug/:id/:id/"


def test_url_columns(spark):
    urls = ["https://u@ex.com:8443/a/1?x=1&y#f", "https://ex.com/foo_bar/abc"]
    row = spark.createDataFrame([(u,) for u in urls], "u string").select(
        U.host(U.F.col("u")).alias("h"), U.netloc(U.F.col("u")).alias("n"), U.path(U.F.col("u")).alias("p"), U.path_template(U.F.col("u")).alias("t"), U.query_pairs(U.F.col("u")).alias("q"), U.route(U.F.col("u")).alias("r")
    ).collect()
    assert (row[0].h, row[0].n, row[0].p, row[0].t) == ("ex.com", "ex.com:8443", "/a/1", "https://ex.com:8443/a/:id")
    assert [(q.key, q.value) for q in row[0].q] == [("x", "1"), ("y", "")] and row[1].t == "https://ex.com/:slug/abc"


def test_matchers():
    import re

    def fits(pattern, url):
        return bool(re.search(U.matcher(pattern, "https://ex.com")[0], url))

    assert fits("/a/*", "https://ex.com/a/b") and not fits("/a/*", "https://ex.com/a/b/c") and fits("/a/**", "https://ex.com/a/b/c") and fits("/A/*/", "https://ex.com/a/b")
    assert fits("/a", "https://ex.com/a") and not fits("/a", "https://ex.com/a/") and U.matcher("/a", "https://ex.com")[1]


ROBOTS = """
User-agent: *
Disallow: /private/   # comment
Allow: /private/open
Disallow: /*.pdf$
Disallow:

User-agent: FooBot
User-agent: Foo
Crawl-delay: 1.5
Disallow: /

Sitemap: https://ex.com/s.xml
"""


def test_robots():
    found = robots.parse(ROBOTS)
    assert found.sitemaps == ["https://ex.com/s.xml"] and [g.agents for g in found.groups] == [["*"], ["foobot", "foo"]]
    for agent, url, ok in [
        ("Googlebot", "https://ex.com/private/x", False), ("Googlebot", "https://ex.com/private/open/x", True), ("Googlebot", "https://ex.com/a.pdf", False), ("Googlebot", "https://ex.com/a.pdf?x", True),
        ("FooBot/1.0", "https://ex.com/", False), ("Googlebot", "https://ex.com/", True),
    ]:
        assert found.allows(agent, url) is ok
    assert found.delay_ms("foobot") == 1500 and found.delay_ms("x") == 0 and robots.allowed(None, "x", "https://ex.com/")
    tie = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a")
    assert tie.allows("x", "https://ex.com/a")


def test_language_tags(spark):
    known = language.codes(spark)
    assert [language.problem(t, known).split(":")[0] for t in ("en", "en-GB", "zh-Hant-TW", "xx", "iw", "en_GB", "es-419", "de-ZZ")] == ["", "", "", "invalid", "invalid", "invalid", "unsupported", "invalid"]


def test_icon_sizes():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (32).to_bytes(4, "big") + (16).to_bytes(4, "big")
    assert images.icon_size(png, "image/png") == (32, 16) and images.icon_size(b"\0\0\1\0\1\0\0\x20", None) == (256, 32)
    assert images.icon_size("<svg viewBox='0 0 10 20'>", "image/svg+xml") == (10, 20) and images.icon_size(None, None) is None


HTML = """<!doctype html><html lang="en"><head><title> A &amp; B </title><base href="/base/"><meta name="description" content=" d  e "><meta name=robots content=noindex>
<link rel=canonical href="/c?utm_source=1"><link rel=alternate hreflang=de href="https://ex.com/de"><meta property="og:title" content="og"><meta name=viewport content=x>
<script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "Product", "name": "P", "offers": {"@type": "Offer", "price": "9,50", "priceCurrency": "eur", "availability": "https://schema.org/InStock"}}]}</script>
<script type="application/ld+json">{broken</script><script>var t = "</p><h1>no</h1>";</script><style>p{}</style></head>
<body><nav><a href="x">X</a></nav><main><h1>Head <b>line</b></h1><p>one two<p>three <a href="#frag">f</a><a href="#page-2">p</a><a href="/y" rel="nofollow ugc"><img src=i.png alt=""></a>
<h2>Q?</h2><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3<td>4</table></main><video muted loop src=v.mp4></video><div id=comments><form><textarea name=comment></textarea></form><a href="https://other.com/">o</a></div>
<ol class=Breadcrumb><li><a href="/">Home</a></ol></body></html>"""


def test_extract():
    x = extract(HTML, "https://ex.com/dir/page")
    assert (x["title"], x["meta_description"], x["meta_robots"], x["lang"]) == ("A & B", "d e", "noindex", "en")
    assert (x["canonical"], x["canonical_target"]) == ("https://ex.com/c?utm_source=1", "https://ex.com/c")
    assert x["headings"] == [{"level": 1, "text": "Head line"}, {"level": 2, "text": "Q?"}] and x["has_viewport_meta"]
    assert [(k["url"], k["nofollow"], k["name"]) for k in x["links"]] == [("https://ex.com/base/x", False, "X"), ("https://ex.com/y", True, ""), ("https://other.com/", False, "o"), ("https://ex.com/", False, "Home")]
    assert x["fragment_page_links"] == ["#page-2"] and x["images"][0]["alt"] == "" and x["json_ld_errors"] == 1 and len(x["json_ld"]) == 1
    assert [n["types"] for n in x["json_ld_nodes"]] == [[], ["Product"]] and x["json_ld_nodes"][1]["schema_context"]
    product = x["derived"]["product"]
    assert product["offers"][0]["price"] == 9.5 and product["offers"][0]["currency"] == "EUR" and product["availability"] == ["instock"]
    assert x["tables"] == [{"rows": 2, "columns": 2, "has_headers": False, "presentational": False}] and x["media"][0]["ambient"]
    assert x["comment_regions"][0]["has_form"] and x["comment_regions"][0]["links"][0]["url"] == "https://other.com/"
    assert x["breadcrumbs"] == [{"links": ["https://ex.com/"], "labels": ["Home"], "targets": ["https://ex.com/"]}]
    assert x["content"]["root"] == "main" and [(s["heading"]["text"], s["words"]) for s in x["content"]["sections"]] == [("Head line", 5), ("Q?", 6)]
    assert "no" not in x["text"].split() and x["landmarks"] == ["nav", "main"] and x["hreflang"][0]["target"] == "https://ex.com/de"


@pytest.mark.parametrize("html", ["", "plain", "<p>a<p>b", "<html>", "<title>t</title>x", "<a href=http://[>x</a>", "</div></p>", "<table><td><p>x</table>y", "<!-- x"])
def test_extract_takes_anything(html):
    x = extract(html, "https://ex.com/")
    assert x["word_count"] == len(x["text"].split())


def test_repeated_pages_are_parsed_once(spark, monkeypatch):
    """Of many crawls, and whatever a task forgets in between (F5)."""
    import pyarrow as pa

    from lodestar.functions import extract as E

    pages = [(f"<title>{i % 7}</title><meta property='og:type' content='a{i % 7}'><a href=/x>x</a>", f"https://ex.com/{i % 3}") for i in range(600)] + [(None, "https://ex.com/1"), ("<p>a</p>", None), (None, None)]
    kind, parsed = E.extracted_type(), []
    monkeypatch.setattr(E, "extract", lambda h, u: parsed.append((h, u)) or extract(h, u))
    wanted = pa.array([None if h is None else E._pairs(extract(h, u or "")) for h, u in pages], kind)
    for known in (512, 20, 0):
        monkeypatch.setattr(E, "_KNOWN", known)
        parsed.clear()
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pages, strict=True)], names=["html", "url"])
        out = pa.Table.from_batches(E._extracting(0, 1, ["html", "url"], kind)(iter([batch, batch])))
        assert out.column("extracted").to_pylist() == wanted.to_pylist() * 2
        assert out.column("normalized_url").to_pylist() == [u and U.normalize(u) for _, u in pages] * 2
        assert len(parsed) == 22 if known == 512 else 22 < len(parsed) < 200
