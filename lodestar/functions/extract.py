"""What an HTML document says: one nested record per page (``schemas.EXTRACTED``)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestar.functions import fixed
from lodestar.functions.dom import Node, body_of, clean, read
from lodestar.functions.jsonld import derived
from lodestar.functions.url import normalize, resolve
from lodestar.schemas import EXTRACTED

#: fixed values: types that are articles
ARTICLE_TYPES = frozenset(
    "Article AdvertiserContentArticle NewsArticle AnalysisNewsArticle AskPublicNewsArticle BackgroundNewsArticle OpinionNewsArticle ReportageNewsArticle ReviewNewsArticle "
    "Report SatiricalArticle ScholarlyArticle MedicalScholarlyArticle SocialMediaPosting BlogPosting LiveBlogPosting DiscussionForumPosting TechArticle APIReference".split()
)
_SILENT = frozenset("script style noscript template".split())
_LANDMARKS = "header nav main article aside footer section".split()
_FRAGMENT_PAGE = re.compile(fixed.FRAGMENT_PAGE, re.I)
_ICON = re.compile(r"(^|\s)(shortcut\s+)?icon(\s|$)|apple-touch-icon|mask-icon", re.I)
_COMMENTS = re.compile("comment|reply", re.I)
_HEADING = re.compile(r"h[1-6]$")
#: pages, and characters of them, whose records a task remembers: crawls of one site repeat pages
_KNOWN, _KNOWN_CHARS = 512, 1 << 20


def _has(node: Node, name: str, *parts: str) -> bool:
    value = (node.get(name) or "").lower()
    return any(p in value for p in parts)


def _role(node: Node) -> str:
    return (node.get("role") or "").strip().lower()


def _within(node: Node, test: Callable[[Node], bool]) -> bool:
    return test(node) or any(map(test, node.above()))


def _hidden(node: Node) -> bool:
    return node.get("aria-hidden") == "true"


def _trail(n: Node) -> bool:
    classed = _has(n, "class", "breadcrumb")
    return (n.tag == "nav" and _has(n, "aria-label", "breadcrumb")) or _has(n, "itemtype", "breadcrumblist") or (classed and (n.tag in ("ol", "ul", "nav") or n.get("role") == "navigation"))


def _comment_box(n: Node) -> bool:
    return _has(n, "id", "comment", "disqus", "respond") or _has(n, "class", "comment", "respond")


def _aside(n: Node) -> bool:
    """Parts of a page that are not its reading matter."""
    return n.tag in ("nav", "aside", "form", "dialog") or n.get("role") in ("navigation", "complementary", "search") or _hidden(n)


class Page:
    def __init__(self, html: str, url: str) -> None:
        self.root = read(html)
        self.all = list(self.root.walk())
        self.by_tag: dict[str, list[Node]] = {}
        for node in self.all:
            self.by_tag.setdefault(node.tag, []).append(node)
        self.ids = {}
        for node in self.all:
            if node.get("id"):
                self.ids.setdefault(node.get("id"), node)
        based = next((n.get("href") for n in self.tag("base") if n.get("href") is not None), None)
        self.base = (based and resolve(based, url)) or url

    def tag(self, *names: str) -> list[Node]:
        if len(names) == 1:
            return self.by_tag.get(names[0], [])
        return [n for n in self.all if n.tag in names]

    def meta(self, name: str, value: str) -> str | None:
        found = next((n for n in self.tag("meta") if n.get(name) == value and n.get("content") is not None), None)
        first = next((n for n in self.tag("meta") if n.get(name) == value), None)
        return clean(found.get("content")) if found is not None and found is first else None

    def url(self, node: Node, name: str) -> str | None:
        value = node.get(name)
        return None if value is None else resolve(value, self.base)

    def name_of(self, node: Node) -> str:
        """The name by which assistive technology calls a link."""
        if said := clean(node.get("aria-label") or ""):
            return said
        named = [self.ids[i].text() for i in (node.get("aria-labelledby") or "").split() if i in self.ids]
        if said := clean(" ".join(named)):
            return said
        inner = [node.text()]
        for child in node.walk():
            label = child.get("aria-label")
            if label is None and child.tag == "img":
                label = child.get("alt")
            if label is not None and not _within(child, _hidden):
                inner.append(label)
        return clean(" ".join(inner)) or clean(node.get("title") or "")

    def link(self, node: Node) -> dict[str, Any] | None:
        href = node.get("href") or ""
        url = resolve(href, self.base)
        if url is None:
            return None
        rel = node.get("rel")
        return {
            "url": url, "href": href, "anchor_text": clean(node.text()), "name": self.name_of(node), "rel": rel,
            "nofollow": rel is not None and re.search(r"\bnofollow\b", rel, re.I) is not None, "target": normalize(url),
        }

    def links(self, under: list[Node]) -> list[dict[str, Any]]:
        return [x for n in under if n.tag == "a" and n.get("href") is not None and (x := self.link(n))]

    def images(self) -> Iterator[dict[str, Any]]:
        for n in self.tag("img"):
            exempt = _within(n, _hidden) or _role(n) in ("presentation", "none") or any(clean(n.get(a) or "") for a in ("aria-label", "aria-labelledby", "title"))
            yield {
                "src": self.url(n, "src"), "alt": n.get("alt"), "width": n.get("width"), "height": n.get("height"), "loading": n.get("loading"),
                "has_srcset": n.get("srcset") is not None, "alt_exempt": exempt,
            }

    def media(self) -> Iterator[dict[str, Any]]:
        for n in self.tag("video", "audio"):
            below = list(n.walk())
            tracks = [t for t in below if t.tag == "track"]
            source = n.get("src")
            if source is None:
                source = next((s.get("src") for s in below if s.tag == "source" and s.get("src") is not None), None)
            yield {
                "kind": n.tag, "src": None if source is None else resolve(source, self.base), "poster": self.url(n, "poster"),
                "has_captions": any((t.get("kind") or "").lower() in ("captions", "subtitles") for t in tracks), "has_track": bool(tracks),
                "has_fallback_text": clean(n.text()) != "",
                "ambient": n.tag == "video" and n.get("muted") is not None and n.get("controls") is None and (n.get("autoplay") is not None or n.get("loop") is not None),
            }

    def breadcrumbs(self) -> Iterator[dict[str, Any]]:
        for n in filter(_trail, self.all):
            if any(map(_trail, n.above())):
                continue
            below = list(n.walk())
            urls = [u for a in below if a.tag == "a" and (u := self.url(a, "href"))]
            labels = [t for c in below if c.tag in ("li", "a", "span") and (t := clean(c.text()))]
            if urls or labels:
                yield {"links": urls, "labels": list(dict.fromkeys(labels)), "targets": [t for u in urls if (t := normalize(u))]}

    def comment_regions(self) -> Iterator[dict[str, Any]]:
        def asks(form: Node) -> bool:
            fields = [f for f in form.walk() if f.tag in ("input", "textarea", "select")]
            return any(_COMMENTS.search(f.get(a) or "") for f in fields for a in ("name", "id", "placeholder"))

        roots = list(filter(_comment_box, self.all))
        for form in filter(asks, self.tag("form")):
            roots.append(next((n for n in (form, *form.above()) if _comment_box(n)), form.parent or form))
        known = set(map(id, roots))
        for n in dict.fromkeys(roots):
            if any(id(a) in known for a in n.above()):
                continue
            below = list(n.walk())
            yield {"has_form": any(asks(f) for f in ([n] if n.tag == "form" else below) if f.tag == "form"), "links": self.links(below)}

    def tables(self) -> Iterator[dict[str, Any]]:
        for n in self.tag("table"):
            below = list(n.walk())
            rows = [r for r in below if r.tag == "tr" and next(a for a in r.above() if a.tag == "table") is n]
            widths = [sum(isinstance(c, Node) and c.tag in ("td", "th") for c in r.children) for r in rows]
            heads = any(b.tag == "th" or b.get("scope") is not None or b.get("headers") is not None or b.get("role") in ("columnheader", "rowheader") for b in below)
            yield {"rows": len(rows), "columns": max(widths, default=0), "has_headers": heads, "presentational": _role(n) in ("presentation", "none")}

    def json_ld(self) -> tuple[list[str], list[dict[str, Any]], int]:
        """Blocks, their nodes (top level, arrays and @graph only) and blocks that don't parse."""
        blocks, nodes, errors = [], [], 0

        def visit(node: Any, context: bool) -> None:
            if isinstance(node, list):
                for each in node:
                    visit(each, context or _schema_org(each))
            elif isinstance(node, dict):
                types = node.get("@type")
                types = [t for t in (types if isinstance(types, list) else [types]) if isinstance(t, str)]
                nodes.append({"types": types, "id": node["@id"] if isinstance(node.get("@id"), str) else None, "schema_context": context, "json": json.dumps(node, ensure_ascii=False)})
                if isinstance(node.get("@graph"), list):
                    visit(node["@graph"], context)

        for n in self.tag("script"):
            if n.get("type") != "application/ld+json":
                continue
            try:
                block = json.loads(n.text(), parse_constant=_no_constant)
            except ValueError:
                errors += 1
                continue
            blocks.append(json.dumps(block, ensure_ascii=False))
            visit(block, _schema_org(block))
        return blocks, nodes, errors

    def content(self) -> dict[str, Any]:
        """Words by section of the main part, without navigation and the like."""
        main = next((n for n in self.all if n.tag == "main" or n.get("role") == "main"), None)
        articles = self.tag("article")
        kind, top = ("main", main) if main is not None else ("article", articles[0]) if len(articles) == 1 else ("body", body_of(self.root))
        sections: list[dict[str, Any]] = [{"heading": None, "words": 0}]
        links: list[str] = []
        said: list[str] = []

        def visit(node: Node) -> None:
            for child in node.children:
                if isinstance(child, str):
                    text = clean(child)
                    if text:
                        said.append(text)
                        sections[-1]["words"] += len(text.split(" "))
                    continue
                framed = child.tag in ("header", "footer") and not any(a.tag == "article" for a in child.above())
                if child.tag in _SILENT or _aside(child) or framed:
                    continue
                if _HEADING.match(child.tag):
                    heading = clean(child.text(_SILENT))
                    sections.append({"heading": {"level": int(child.tag[1]), "text": heading}, "words": 0})
                    if heading:
                        said.append(heading)
                    continue
                if child.tag == "a" and (url := self.url(child, "href")):
                    links.append(url)
                visit(child)

        visit(top)
        return {"root": kind, "sections": sections if sections[0]["words"] else sections[1:], "links": links, "text": clean(" ".join(said))}

    def byline(self) -> str | None:
        marks: list[Callable[[Node], bool]] = [
            lambda n: "author" in (n.get("rel") or "").split(),
            lambda n: n.get("itemprop") == "author",
            lambda n: _has(n, "class", "byline"),
            lambda n: _has(n, "class", "author"),
        ]
        body = list(body_of(self.root).walk())
        for mark in marks:
            for n in filter(mark, body):
                if n.tag != "nav" and not any(a.tag == "nav" for a in n.above()) and (said := clean(" ".join(n.pieces(_SILENT)))):
                    return said[:120]
        return None

    def record(self) -> dict[str, Any]:
        meta = self.tag("meta")
        links = self.tag("link")
        canonical = next((n for n in links if n.get("rel") == "canonical"), None)
        title = next((n.text() for n in self.tag("title") if not any(a.tag == "svg" for a in n.above())), "")
        blocks, nodes, errors = self.json_ld()
        text = clean(body_of(self.root).text(_SILENT))
        anchors = [n for n in self.tag("a") if n.get("href") is not None]
        scripts = self.tag("script")
        resolved = [None if n.get("src") is None else resolve(n.get("src"), self.base) for n in scripts]
        html = next(iter(self.tag("html")), None)
        named = None if canonical is None or canonical.get("href") is None else resolve(canonical.get("href"), self.base)
        return {
            "title": clean(title) if title else None,
            "meta_description": self.meta("name", "description"),
            "meta_robots": self.meta("name", "robots"),
            "canonical": named, "canonical_target": normalize(named),
            "lang": None if html is None else html.get("lang"),
            "charset": next((n.get("charset") for n in meta if n.get("charset") is not None), None),
            "has_viewport_meta": any(n.get("name") == "viewport" for n in meta),
            "headings": [{"level": int(n.tag[1]), "text": clean(n.text())} for n in self.all if _HEADING.match(n.tag)],
            "links": self.links(anchors),
            "images": list(self.images()),
            "hreflang": [{"hreflang": n.get("hreflang"), "url": u, "href": n.get("href"), "target": normalize(u)} for n in links if n.get("rel") == "alternate" and n.get("hreflang") is not None and (u := self.url(n, "href"))],
            "json_ld": blocks, "json_ld_errors": errors, "json_ld_nodes": nodes,
            "open_graph": {n.get("property"): clean(n.get("content")) for n in meta if (n.get("property") or "").startswith("og:") and n.get("content") is not None},
            "twitter": {n.get("name"): clean(n.get("content")) for n in meta if (n.get("name") or "").startswith("twitter:") and n.get("content") is not None},
            "scripts": [u for u in resolved if u],
            "inline_scripts": [t for n in scripts if n.get("src") is None and (t := n.text()).strip()],
            "script_tags": [{"src": u, "text": "" if u else n.text()} for n, u in zip(scripts, resolved, strict=True)],
            "stylesheets": [u for n in links if n.get("rel") == "stylesheet" and (u := self.url(n, "href"))],
            "icons": [{"rel": clean(n.get("rel")), "url": u, "sizes": n.get("sizes"), "type": n.get("type")} for n in links if _ICON.search(n.get("rel") or "") and (u := self.url(n, "href"))],
            "media": list(self.media()),
            "frames": [{"src": u, "title": n.get("title"), "loading": n.get("loading")} for n in self.tag("iframe") if (u := self.url(n, "src"))],
            "breadcrumbs": list(self.breadcrumbs()),
            "comment_regions": list(self.comment_regions()),
            "tables": list(self.tables()),
            "fragment_page_links": [n.get("href") for n in anchors if _FRAGMENT_PAGE.match(n.get("href").strip())],
            "landmarks": [t for t in _LANDMARKS if self.tag(t)],
            "content": self.content(),
            "authorship": {
                "meta_author": self.meta("name", "author"), "byline": self.byline(), "article_author": self.meta("property", "article:author"),
                "published_time": self.meta("property", "article:published_time"), "modified_time": self.meta("property", "article:modified_time"),
                "times": [t for n in self.tag("time") if (t := clean(n.get("datetime") if n.get("datetime") is not None else n.text()))],
            },
            "derived": derived([json.loads(b) for b in blocks], next((clean(n.get("content")) or None for n in meta if n.get("property") == "og:site_name" and n.get("content") is not None), None), ARTICLE_TYPES),
            "text": text, "word_count": len(text.split(" ")) if text else 0,
        }


def _schema_org(block: Any) -> bool:
    return isinstance(block, dict) and "@context" in block and "schema.org" in json.dumps(block["@context"]).lower()


def _no_constant(name: str) -> None:
    raise ValueError(name)


def extract(html: str, url: str) -> dict[str, Any]:
    return Page(html, url).record()


def extracted_type() -> pa.DataType:
    """Needs a session; executors get it with the function."""
    return to_arrow_type(StructType.fromDDL(f"x {EXTRACTED}")[0].dataType, prefers_large_types=False)


def _extracting(html_at: int, url_at: int, columns: list[str], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, str | None], int] = {}  # pages parsed before, by their places in ``records``
        normal, records = pa.array([], pa.string()), pa.array([], kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # records are larger than their pages
                if len(known) > _KNOWN or sum(len(h or "") for h, _ in known) > _KNOWN_CHARS:
                    known, normal, records = {}, normal[:0], pa.array([], kind)
                part = batch.slice(at, 256)
                pages = list(zip(part.column(html_at).to_pylist(), part.column(url_at).to_pylist(), strict=True))
                fresh = [p for p in dict.fromkeys(pages) if p not in known]
                if fresh:
                    known |= {p: len(known) + i for i, p in enumerate(fresh)}
                    normal = pa.concat_arrays([normal, pa.array([normalize(u) or u for _, u in fresh], pa.string())])
                    records = pa.concat_arrays([records, pa.array([None if h is None else _pairs(extract(h, u or "")) for h, u in fresh], kind)])
                places = pa.array([known[p] for p in pages], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, normal.take(places), records.take(places)], names=[*columns, "normalized_url", "extracted"])

    return run


def _pairs(record: dict[str, Any]) -> dict[str, Any]:
    return record | {k: list(record[k].items()) for k in ("open_graph", "twitter")}


def with_extracted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with normalized_url and extracted (null where the html is)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(_extracting(pages.columns.index(html), pages.columns.index(url), pages.columns, extracted_type()), f"{fields}, normalized_url string, extracted {EXTRACTED}")


def raw_pages(pages: DataFrame, crawl_id: str = "crawl") -> DataFrame:
    """A bare table (page_id, url, html) as crawled pages: all fetched with 200, at depth 1."""
    from lodestar.schemas import RENDER

    read_ = with_extracted(pages.select("page_id", "url", "html"))
    fetch = F.struct(
        F.col("url").alias("requested_url"), F.col("normalized_url").alias("final_url"), F.lit(200).alias("status"), F.map_from_arrays(F.array(F.lit("content-type")), F.array(F.lit("text/html"))).alias("headers"),
        F.array().cast("array<struct<url:string,status:int,location:string>>").alias("redirect_chain"), F.octet_length("html").cast("long").alias("byte_length"), F.lit(False).alias("truncated"),
        F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"), F.col("html").alias("body"),
    )
    return read_.select(
        F.lit(crawl_id).alias("crawl_id"), F.col("page_id").cast("int").alias("ordinal"), "url", "normalized_url", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("discovered_from"),
        fetch.alias("fetch"), "extracted", F.lit(None).cast(RENDER).alias("rendered"), F.lit(None).cast(RENDER).alias("rendered_mobile"),
    )
