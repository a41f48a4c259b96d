"""Small crawls for detector tests: cases are written as dicts, many crawls at once."""

from datetime import datetime

from lodestar import schemas
from lodestar.functions.extract import extract
from lodestar.functions.url import normalize
from lodestar.operators.audit import Audit

NOW = datetime(2026, 3, 1, 12)
ORIGIN = "https://example.com"


def fetched(url, status=200, html="", headers=None, chain=(), final=None, truncated=False, error=None, kind="text/html", size=None):
    headers = {"content-type": kind, **(headers or {})}
    return {
        "requested_url": url, "final_url": final or (normalize(url) or url), "status": status, "headers": headers, "redirect_chain": [{"url": a, "status": s, "location": b} for a, s, b in chain],
        "byte_length": len(html) if size is None else size, "truncated": truncated, "content_type": kind, "error": error, "body": html,
    }


def rendered(url, html, error=None, paint=None, axe=None, requests=(), status=200):
    return {
        "error": error, "final_url": normalize(url), "status": status, "extracted": None if html is None else extract(html, url), "largest_paint": paint, "accessibility": axe, "requests": list(requests),
    }


def page(url="/", html="<html lang=en><title>T</title><body><h1>H</h1>text</body></html>", depth=1, render=None, mobile=None, **fetch):
    full = url if url.startswith("http") else ORIGIN + url
    kind = fetch.get("kind", "text/html")
    parsed = extract(html, full) if html is not None and "html" in kind and fetch.get("error") is None and fetch.get("status", 200) else None
    return {
        "url": full, "normalized_url": normalize(full), "depth": depth, "discovered_from": None, "fetch": fetched(full, html=html or "", **fetch), "extracted": parsed,
        "rendered": None if render is None else rendered(full, **render), "rendered_mobile": None if mobile is None else rendered(full, **mobile),
    }


_SITE = ("origin crawled_at environment flags robots_txt robots_status robots_error protocol rdap ai_policy production_origin settings release_id").split()
_TABLES = {
    "sitemaps": schemas.SITEMAPS, "sitemap_urls": schemas.SITEMAP_URLS, "sitemap_news": schemas.SITEMAP_NEWS, "sitemap_video": schemas.SITEMAP_VIDEO, "auxiliary": schemas.AUXILIARY,
    "blocked": schemas.URLS, "not_reached": schemas.URLS, "seeds": schemas.URLS, "previous_pages": schemas.PREVIOUS_PAGES, "previous_probes": schemas.PREVIOUS_PROBES, "gates": schemas.GATES,
}


def _names(ddl):
    depth, names, word = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            names.append(word.split()[0].split(":")[0])
            word = ""
        else:
            word += c
    return names


def audit(spark, cases):
    """An Audit of cases {crawl_id: {pages, site fields, tables, inputs}}."""

    def table(rows, ddl):
        names = _names(ddl)
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    sites, pages, tables, inputs = [], [], {n: [] for n in _TABLES}, {}
    for crawl, case in cases.items():
        given = {"origin": ORIGIN, "crawled_at": NOW, "flags": [], **{k: v for k, v in case.items() if k in _SITE}}
        sites.append({"crawl_id": crawl, **given})
        pages += [{"crawl_id": crawl, "ordinal": i, **p} for i, p in enumerate(case.get("pages", []))]
        for name in _TABLES:
            for row in case.get(name, []):
                row = {"url": row} if isinstance(row, str) else row
                row = {"normalized_url": normalize(row["url"]), **row} if name == "sitemap_urls" else row
                tables[name].append({"crawl_id": crawl, **row})
        for section, record in case.get("inputs", {}).items():
            inputs.setdefault(section, []).append({"crawl_id": crawl, "owner": "me", "recorded_at": NOW, **record})
    return Audit(
        spark, table(sites, schemas.SITES), table(pages, schemas.PAGES), **{n: table(r, _TABLES[n]) for n, r in tables.items()},
        inputs={s: table(r, f"{schemas.HELD}, {schemas.INPUTS[s]}") for s, r in inputs.items()},
    )
