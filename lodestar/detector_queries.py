"""Queries that run detectors over many crawls built from the driver's tables, each
with the SQL that its outcomes must agree with.

Every customer (or other row) is a crawl; what its pages and records say follows from
its columns, so that each outcome of a detector occurs in some crawls.  The SQL tells
the outcome from the columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions.extract import with_extracted
from lodestar.operators.audit import Audit
from lodestar.operators.page_detectors import page_observations
from lodestar.operators.site_detectors import SITE
from lodestar.queries import ORACLES, QUERIES, read
from lodestar.record_queries import crawls, held
from lodestar.sources.scratch import written

Tables = dict[str, Callable[[DataFrame], DataFrame]]
AT = "https://example.com"
_CHAIN = "array<struct<url:string,status:int,location:string>>"


def registered(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls: k counts them, n is one of 25, bal a figure, seg one of five."""
    return read(spark, sf_dir, "customer").selectExpr("string(c_custkey) as crawl_id", "c_custkey as k", "c_nationkey as n", "c_acctbal as bal", "c_mktsegment as seg")


#: the same in DuckDB
C = "(SELECT c_custkey::VARCHAR AS crawl_id, c_custkey AS k, c_nationkey AS n, c_acctbal AS bal, c_mktsegment AS seg FROM customer)"


def built_pages(rows: DataFrame, **given: str) -> DataFrame:
    """Pages (in the schema of crawls) of rows that have crawl_id; ``given`` are SQL
    expressions of what differs from a page at the root answered with 200."""
    told = {
        "url": f"'{AT}/'", "html": "'<html lang=en><head><title>T</title></head><body><h1>H</h1>text</body></html>'", "ordinal": "0", "depth": "1", "status": "200", "headers": "map('content-type', 'text/html')",
        "chain": f"cast(array() as {_CHAIN})", "final": "cast(null as string)", "error": "cast(null as string)", "truncated": "false", "kind": "'text/html'", "size": "cast(null as bigint)",
        "shown": "cast(null as string)", "render_error": "cast(null as string)", "paint": "cast(null as struct<element:string,src:string,loading:string>)", "rendered": "false",
        "axe": "cast(null as struct<error:string,violations:array<struct<id:string,impact:string,nodes:int>>>)", "requests": "cast(array() as array<string>)", "render_final": "cast(null as string)",
        "mobile": "cast(null as string)", "mobile_rendered": "false", "mobile_error": "cast(null as string)",
    } | given
    # only what rows say goes to the parser and back, not what is made of it
    parsed = with_extracted(rows.selectExpr("*", *[f"{told[n]} as `{n}_`" for n in ("html", "url")]), "html_", "url_").withColumnsRenamed({"extracted": "raw_x", "normalized_url": "raw_url"})
    raw = parsed.selectExpr("crawl_id", *[f"{e} as `{n}`" for n, e in (told | {"html": "html_", "url": "url_"}).items()], "raw_url", "raw_x")
    desk = with_extracted(raw, "shown", "url").withColumnRenamed("extracted", "desk_x").drop("normalized_url") if "shown" in given else raw.withColumn("desk_x", F.lit(None).cast(schemas.EXTRACTED))
    both = with_extracted(desk, "mobile", "url").withColumnRenamed("extracted", "phone_x").drop("normalized_url") if "mobile" in given else desk.withColumn("phone_x", F.lit(None).cast(schemas.EXTRACTED))
    body = "coalesce(html, '')"
    fetch = (
        f"named_struct('requested_url', url, 'final_url', coalesce(final, raw_url), 'status', int(status), 'headers', cast(headers as map<string,string>), 'redirect_chain', chain, "
        f"'byte_length', coalesce(size, bigint(octet_length({body}))), 'truncated', truncated, 'content_type', kind, 'error', error, 'body', {body})"
    )
    render = (
        "if({0}, named_struct('error', {1}, 'final_url', coalesce({2}, raw_url), 'status', int(status), 'extracted', {3}, 'largest_paint', {4}, 'accessibility', {5}, 'requests', {6}), null)"
    )
    shown = render.format("rendered", "render_error", "render_final", "desk_x", "paint", "axe", "requests")
    phone = render.format("mobile_rendered", "mobile_error", "cast(null as string)", "phone_x", "paint", "axe", "requests")
    return both.selectExpr(
        "crawl_id", "int(ordinal) as ordinal", "url", "raw_url as normalized_url", "int(depth) as depth", "cast(null as string) as discovered_from",
        f"cast({fetch} as {schemas.FETCH}) as fetch", "raw_x as extracted", f"cast({shown} as {schemas.RENDER}) as rendered", f"cast({phone} as {schemas.RENDER}) as rendered_mobile",
    )


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: parsing their pages costs far more than dealing them out."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def several(rows: DataFrame, count: int, at: str = "i") -> DataFrame:
    """Every row ``count`` times, numbered."""
    return rows.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def fetches(rows: DataFrame, reason: str, url: str, status: str = "200", final: str = "cast(null as string)", error: str = "cast(null as string)", body: str = "''", kind: str = "'text/html'", hops: str = "0", agent: str = "cast(null as string)", first: str = "301") -> DataFrame:
    """Requests beside the crawl's pages."""
    chain = f"transform(slice(array(0, 1, 2, 3), 1, {hops}), i -> named_struct('url', string({url}), 'status', int({first}), 'location', ''))"
    fetch = (
        f"named_struct('requested_url', {url}, 'final_url', coalesce({final}, {url}), 'status', int({status}), 'headers', map('content-type', {kind}), 'redirect_chain', {chain}, 'byte_length', bigint(octet_length({body})), "
        f"'truncated', false, 'content_type', {kind}, 'error', {error}, 'body', {body})"
    )
    return rows.selectExpr("crawl_id", f"'{reason}' as reason", f"{url} as url", f"{agent} as agent", f"cast({fetch} as {schemas.FETCH}) as fetch")


def case(
    probe: str, sql: str, section: str | None = None, columns: dict[str, str] | None = None, *, site: dict[str, str] | None = None, pages: Callable[[DataFrame], DataFrame] | None = None,
    tables: Tables | None = None, inputs: dict[str, dict[str, str]] | None = None, by_page: bool = False, once: bool = False,
) -> None:
    """Registers a query of one detector over all customers as crawls.

    ``sql``: the outcome in terms of k, n, bal and seg; null where the detector says
    nothing.  ``columns`` of a record in ``section`` (owner and next_review_at too),
    ``site`` and ``tables`` say what the crawl holds.  A detector that reads pages ``once``
    needs no written table of them, whose many columns cost more than what it reads."""
    name = f"detector_{probe.replace('-', '_')}"
    wanted = {**(inputs or {}), **({section: columns or {}} if section else {})}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = customers(spark, sf_dir)
        audit = crawls(spark, rows, **{n: F.expr(e) for n, e in (site or {}).items()})
        if pages is not None:
            audit.pages = pages(dealt(rows)) if once else written(pages(dealt(rows)), "pages")
        for table, make in (tables or {}).items():
            setattr(audit, table, make(rows))
        for part, told in wanted.items():
            given = rows.where(told.get("given", "true"))
            audit.inputs[part] = held(given, part, **{n: F.expr(e) for n, e in told.items() if n != "given"})
        found = SITE[probe](audit)
        return found.select("crawl_id", "page_url", "outcome") if by_page else found.select("crawl_id", "outcome")

    registered(name, sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT crawl_id, {sql} AS outcome FROM {C}", run)


#: a record without an owner where n is a multiple of 5, and one due for review where of 7
OWNED = {"owner": "if(n % 5 = 0, ' ', 'me')", "next_review_at": "if(n % 7 = 1, timestamp '1999-01-01', timestamp '2001-01-01')"}
HOLDS = "(n % 5 = 0 OR n % 7 = 1)"

# ---- records judged on their own

case(
    "ci-extended-checks", f"CASE WHEN k % 11 = 0 THEN 'not-applicable' WHEN bal < 0 OR seg = 'BUILDING' OR k % 4 = 3 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "ci_rules",
    {"rules": "if(k % 11 = 0, array(), array(named_struct('name', 'a', 'owner', if(bal < 0, ' ', 'o'), 'severity', if(seg = 'BUILDING', null, 'high'), 'false_positive_rate', (k % 4) / 25D), named_struct('name', 'b', 'owner', 'o', 'severity', 'low', 'false_positive_rate', null)))", **OWNED},
)
case(
    "inherited-domain-history", f"CASE WHEN bal < 0 OR n % 6 = 0 OR n % 6 = 1 THEN 'fail' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "domain_history",
    {"checks": "filter(array(named_struct('kind', 'Manual action', 'resolved', bal >= 0, 'issue', ''), named_struct('kind', if(k % 2 = 0, 'Wayback machine', 'archive'), 'resolved', true, 'issue', '')), c -> not (n % 6 = 0 and contains(c.kind, 'Manual')) and not (n % 6 = 1 and not contains(c.kind, 'Manual')))", **OWNED},
)
case(
    "security-manual-actions",
    f"CASE WHEN n % 6 IN (0, 1) THEN 'fail' WHEN n % 6 IN (2, 3) THEN 'warn' WHEN bal < 0 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "search_console",
    {
        "manual_actions": "case n % 6 when 0 then array('x') when 2 then null else array() end", "security_issues": "case n % 6 when 1 then array('malware') when 3 then null else array() end",
        "issues_checked_at": "if(bal < 0, timestamp '1999-11-01', if(k % 2 = 0, timestamp '1999-12-20', null))", **OWNED,
    },
)
case(
    "ai-visibility-baseline",
    f"CASE WHEN n % 8 = 0 THEN 'fail' WHEN n % 8 IN (1, 2) THEN 'fail' WHEN n % 8 = 3 THEN 'warn' WHEN n % 8 = 4 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "ai_baseline",
    {
        "entries": "if(n % 8 = 3, array(), array(named_struct('engine', case n % 8 when 1 then 'Bing and Copilot' when 2 then 'All engines' else 'ChatGPT' end, 'period', if(n % 8 = 4, 'last month', concat('2025-0', 1 + k % 9, '-01 to 2025-12-01')), "
        "'available_from', if(n % 8 = 0, '2025-11-01', if(k % 2 = 0, '2024-01-01', null)))))", **OWNED,
    },
)
case(
    "digital-pr-tracking", f"CASE WHEN n % 4 = 0 OR (n % 4 = 1 AND bal < 1000) THEN 'fail' WHEN n % 4 = 2 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "digital_pr",
    {"wins": "if(n % 4 = 2, array(), array(named_struct('url', '/a', 'paid', n % 4 = 0, 'owner', 'o'), named_struct('url', '/b', 'paid', false, 'owner', if(n % 4 = 1 and bal < 1000, null, 'o'))))", **OWNED},
)
case(
    "offpage-reputation-governance", f"CASE WHEN bal < 0 THEN 'fail' WHEN n % 4 = 0 OR (n % 4 = 1 AND seg = 'MACHINERY') THEN CASE WHEN n % 4 = 0 THEN 'warn' ELSE 'warn' END WHEN {HOLDS} THEN 'warn' ELSE 'pass' END",
    "review_destinations",
    {"entries": "if(n % 4 = 0 and bal >= 0, array(), array(named_struct('url', '/', 'owner', if(n % 4 = 1 and seg = 'MACHINERY', '', 'o'), 'next_check_at', if(bal < 0, timestamp '1999-06-01', if(k % 3 = 0, null, timestamp '2000-06-01')))))", **OWNED},
)
case(
    "competitor-serp-baseline", f"CASE WHEN n % 5 = 1 OR n % 5 = 2 OR n % 5 = 3 THEN 'fail' WHEN n % 7 = 1 OR n % 5 = 0 THEN 'warn' ELSE 'pass' END", "competitors",
    {"entries": "if(n % 5 = 1, array(), array(named_struct('keyword', if(n % 5 = 2, ' ', 'tea'), 'competitor', if(n % 5 = 3, 'https://www.Example.com/x', 'rival.com'), 'rank', 1, 'url', '/'), named_struct('keyword', 'tea', 'competitor', seg, 'rank', 2, 'url', '/')))", **OWNED},
)
case(
    "prelaunch-baseline-snapshot", "CASE WHEN k % 3 = 0 THEN 'not-applicable' WHEN bal < 0 THEN 'fail' WHEN n % 4 = 0 THEN 'warn' WHEN n % 4 IN (1, 2) THEN 'pass' ELSE 'warn' END",
    site={"release_id": "if(k % 3 = 0, null, 'r')", "settings": "if(n % 4 = 0, null, '{}')"}, inputs={"crux": {"given": "n % 4 = 1"}, "lighthouse": {"given": "n % 4 = 2"}},
    tables={"previous_pages": lambda rows: previous(rows.where("bal >= 0"))},
)
case(
    "release-regression-review", "CASE WHEN k % 3 = 0 THEN 'not-applicable' WHEN n % 4 = 1 OR (n % 4 = 2 AND bal < 0) THEN 'fail' ELSE 'pass' END",
    tables={"gates": lambda rows: rows.where("k % 3 <> 0").selectExpr("crawl_id", "array('1.1', '1.2') as passed_before", "if(n % 4 in (1, 2), array('1.2', '9.9'), array('9.9')) as failing_now", "case when n % 4 = 2 and bal >= 0 then array('1.2') when n % 4 = 2 then array('1.1') end as reopened")},
)
case(
    "reporting-anomaly-thresholds",
    f"CASE WHEN n % 6 = 0 OR (bal < 0 AND n % 6 <> 1 AND n % 6 <> 2) THEN 'fail' WHEN n % 6 = 1 THEN 'warn' WHEN n % 6 = 2 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "reporting",
    {
        "thresholds": "case when n % 6 = 1 then array() when n % 6 = 2 then array(named_struct('metric', 'clicks', 'engine', 'bing', 'change', -0.2D)) else array(named_struct('metric', 'clicks', 'engine', 'Google', 'change', -0.2D), named_struct('metric', 'impressions', 'engine', 'google', 'change', 0.5D)) end",
        "anomalies": "case when n % 6 = 0 then array(named_struct('metric', 'position', 'engine', 'google', 'period', '', 'disposition', ' ')) when n % 6 = 3 and bal >= 0 then array(named_struct('metric', 'clicks', 'engine', 'google', 'period', '', 'disposition', 'known')) else array() end", **OWNED,
    },
    inputs={"search_console": {"performance": (
        "array(named_struct('page', '/', 'query', null, 'clicks', 100D, 'impressions', 100D, 'period', 'a'), named_struct('page', '/', 'query', null, 'clicks', if(bal < 0, 79D, 81D), 'impressions', 120D, 'period', 'b'))"
    )}},
)

# ---- records met with pages, sitemaps and requests


def previous(rows: DataFrame, **given: str) -> DataFrame:
    """Pages of the previous audit."""
    names = [f.strip().split(" ", 1) for f in _columns(schemas.PREVIOUS_PAGES)][1:]
    told = {"url": f"'{AT}/'", "status": "200", "title": "'T'", "h1": "'H'", "words": "100"} | given
    return rows.selectExpr("crawl_id", *[f"cast({told.get(n, 'null')} as {t}) as {n}" for n, t in names])


def _columns(ddl: str) -> list[str]:
    depth, parts, word = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(word)
            word = ""
        else:
            word += c
    return parts


NOINDEX = "<meta name=\"robots\" content=\"noindex\">"
#: one page at /a: it answers by n % 8 (5: noindex), and is not there where it is 7
_A = {"url": f"'{AT}/a'", "status": "case n % 8 when 4 then 404 when 6 then 500 else 200 end", "html": f"concat('<html><head><title>T</title>', if(n % 8 = 5, '{NOINDEX}', ''), '</head><body><h1>H</h1></body></html>')"}


def _page_a(rows: DataFrame) -> DataFrame:
    return built_pages(rows.where("n % 8 <> 7"), **_A)


case(
    "product-checkout-qa", f"CASE WHEN k % 6 = 0 OR n % 8 IN (4, 6) THEN 'fail' WHEN {HOLDS} THEN 'warn' WHEN n % 8 = 7 THEN 'warn' ELSE 'pass' END", "checkout",
    {"cases": "array(named_struct('name', 'buy', 'url', '/a', 'result', if(k % 6 = 0, 'fail', 'pass')))".replace("'/a'", f"'{AT}/a'"), **OWNED}, pages=_page_a,
)
case(
    "availability-canary",
    f"CASE WHEN n % 8 IN (4, 6) OR k % 5 IN (1, 2, 3) THEN 'fail' WHEN n % 8 = 7 OR k % 5 = 0 OR bal < 0 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "canary",
    {
        "urls": f"array('{AT}/a')", "target_minutes": "10D", "recipient": "if(bal < 0, '', 'ops')", "last_test_alert_at": "if(k % 5 = 0, null, timestamp '1999-12-30 10:00:00')",
        "delivered_at": "case k % 5 when 1 then null when 2 then timestamp '1999-12-30 09:00:00' when 3 then timestamp '1999-12-30 10:11:00' else timestamp '1999-12-30 10:10:00' end", **OWNED,
    }, pages=_page_a,
)
case(
    "keyword-intent-map",
    "CASE WHEN n % 8 IN (4, 5, 6, 7) THEN 'fail' WHEN bal < 0 THEN 'warn' ELSE 'pass' END", "keyword_map", {"entries": f"array(named_struct('url', '{AT}/a', 'keyword', 'tea'), named_struct('url', '{AT}/a#x', 'keyword', 'cup'))"},
    pages=lambda rows: _page_a(rows).unionByName(built_pages(several(rows.where("bal < 0"), 2), url=f"concat('{AT}/more', i)", ordinal="i + 1")),
)
case(
    "content-helpfulness",
    "CASE WHEN k % 5 = 0 OR n % 8 IN (4, 5, 6) THEN 'fail' WHEN k % 5 = 1 OR bal < 0 THEN 'warn' ELSE 'pass' END", "content_review",
    {"entries": f"array(named_struct('url', '{AT}/a', 'verdict', case k % 5 when 0 then 'fails' when 1 then 'needs-work' else 'helpful' end))"},
    inputs={"url_matrix": {"entries": "array(named_struct('pattern', '/key/*', 'priority', true, 'status', 200, 'indexable', true, 'canonical', null, 'in_sitemap', null, 'access', if(k % 2 = 0, 'public', null), 'environment', null))"}},
    pages=lambda rows: _page_a(rows).unionByName(built_pages(rows.where("bal < 0"), url=f"'{AT}/key/1'", ordinal="1")),
)
case(
    "experiment-cloaking-divergence",
    f"CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN bal < 0 OR k % 6 = 1 THEN 'fail' WHEN n % 8 = 7 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "experiments",
    {"entries": f"if(k % 6 = 0, array(), array(named_struct('name', 'e', 'variants', array('{AT}/v', '{AT}/a'), 'retire_by', if(bal < 0, timestamp '1999-12-31', timestamp '2000-02-01'))))", **OWNED},
    pages=lambda rows: _page_a(rows).unionByName(built_pages(rows, url=f"'{AT}/v'", ordinal="1", html=f"concat('<html><head><link rel=\"canonical\" href=\"{AT}/', if(k % 6 = 1, 'v', ''), '\"></head><body>x</body></html>')")),
)
case(
    "staging-protection",
    f"CASE WHEN k % 7 = 0 THEN 'not-applicable' WHEN n % 6 = 0 THEN 'fail' WHEN n % 6 IN (1, 2) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "environments",
    {"entries": "if(k % 7 = 0, array(named_struct('name', 'live', 'url', 'https://example.com', 'kind', 'production')), array(named_struct('name', 'test', 'url', 'https://test.example.com/', 'kind', 'staging')))", **OWNED},
    tables={"auxiliary": lambda rows: fetches(
        rows.where("n % 6 <> 1"), "environment", "'https://test.example.com/'", status="case when n % 6 in (0, 2) then 200 when n % 6 = 3 then 401 when n % 6 = 4 then 200 else 403 end",
        kind="if(n % 6 = 4, 'application/json', 'text/html')", hops="if(n % 6 = 2, 1, 0)", final="if(n % 6 = 2, 'https://test.example.com/sign-in?next=/', null)",
    )},
)
case(
    "url-inspection",
    f"CASE WHEN k % 9 = 0 THEN 'not-applicable' WHEN k % 9 = 1 THEN 'not-applicable' WHEN n % 8 IN (4, 5, 6) OR n % 8 = 7 THEN CASE WHEN n % 8 = 7 OR {HOLDS} THEN 'warn' ELSE 'pass' END WHEN k % 9 IN (2, 3, 4) THEN 'fail' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END",
    "search_console",
    {
        "inspections": "if(k % 9 = 0, null, array(named_struct('url', '{0}/a', 'verdict', if(k % 9 = 1, 'URL is not on Google', 'PASS'), 'robots', if(k % 9 = 2, 'Blocked', 'Allowed'), 'indexing', if(k % 9 = 3, 'Noindex', 'ok'), "
        "'google_canonical', if(k % 9 = 4, '{0}/other', if(k % 2 = 0, '{0}/a', null)), 'coverage', null)))".replace("{0}", AT), **OWNED,
    }, pages=_page_a,
)
case(
    "indexation-review",
    f"CASE WHEN k % 5 = 0 THEN 'not-applicable' WHEN n % 8 < 4 AND k % 5 = 1 THEN 'fail' WHEN n % 8 < 4 AND k % 5 = 2 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "search_console",
    {"indexation": f"if(k % 5 = 0, null, array(named_struct('url', '{AT}/a', 'reason', case k % 5 when 1 then 'Excluded by noindex tag' when 2 then 'Crawled - currently not indexed' else 'Indexed' end)))", **OWNED}, pages=_page_a,
)



def _sitemaps(rows: DataFrame, **given: str) -> DataFrame:
    names = [f.strip().split(" ", 1) for f in _columns(schemas.SITEMAPS)][1:]
    told = {"url": f"'{AT}/s.xml'", "status": "200", "url_count": "1", "video_count": "0", "news_count": "0", "truncated": "false", "declared": "true", "fetched_at": "timestamp '2000-01-01 00:00:00'"} | given
    return rows.selectExpr("crawl_id", *[f"cast({told.get(n, 'null')} as {t}) as {n}" for n, t in names])


case(
    "sitemap-submit",
    f"CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 = 1 THEN 'warn' WHEN n % 9 IN (2, 3) THEN 'fail' WHEN n % 9 IN (4, 5) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "search_console",
    {
        "sitemaps": "if(n % 9 = 1, null, array(named_struct('url', concat('{0}/', if(n % 9 = 4, 'other', 's'), '.xml'), 'status', case n % 9 when 3 then '2 errors' when 5 then 'Could not fetch: fail' else 'Success' end, 'errors', if(n % 9 = 2, 1, 0))))".replace("{0}", AT),
        **OWNED,
    }, tables={"sitemaps": lambda rows: _sitemaps(rows, status="if(n % 9 = 0, 404, 200)")},
)
case(
    "bing-onboarding",
    f"CASE WHEN n % 6 = 0 THEN 'fail' WHEN n % 6 = 1 THEN 'fail' WHEN n % 6 IN (2, 3) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "bing",
    {"verified": "case n % 6 when 0 then false when 2 then null else true end", "sitemaps": f"array(named_struct('url', concat('{AT}/', if(n % 6 = 3, 'other', 's'), '.xml'), 'status', if(n % 6 = 1, 'Error', 'Success')))", **OWNED},
    tables={"sitemaps": lambda rows: _sitemaps(rows)},
)
case(
    "merchant-feed-parity",
    f"CASE WHEN k % 9 = 0 THEN 'not-applicable' WHEN {HOLDS} THEN CASE WHEN k % 9 IN (1, 2, 3, 4) AND n % 8 < 4 THEN 'warn' ELSE 'warn' END WHEN n % 8 < 6 AND n % 8 <> 4 AND k % 9 IN (1, 2, 3, 4) THEN 'fail' WHEN n % 8 IN (4, 6, 7) OR k % 9 = 5 THEN 'warn' ELSE 'pass' END",
    "merchant_feed",
    {
        "items": "if(k % 9 = 0, array(), array(named_struct('id', '1', 'link', '{0}/a', 'price', if(k % 9 = 1, 10.01D, 10D), 'currency', if(k % 9 = 2, 'sek', 'eur'), 'availability', if(k % 9 = 3, 'out of stock', 'in_stock'), 'gtin', if(k % 9 = 4, '0555', '00123'), 'brand', 'b')))".replace("{0}", AT),
        **OWNED,
    },
    pages=lambda rows: built_pages(rows.where("n % 8 <> 7"), **{**_A, "html": (
        "concat('<html><body>', '<script type=\"application/ld+json\">{\"@context\": \"https://schema.org\", \"@type\": \"Product\", \"name\": \"Cup\", \"gtin13\": \"123\", \"offers\": {\"@type\": \"Offer\"', "
        "if(k % 9 = 5, '', ', \"price\": \"10.00\"'), ', \"priceCurrency\": \"EUR\", \"availability\": \"https://schema.org/InStock\"}}</script></body></html>')"
    )}),
)
case(
    "gbp-setup",
    f"CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN k % 4 = 1 AND n % 8 <> 7 THEN 'fail' WHEN n % 9 = 1 OR n % 8 = 7 OR k % 4 = 2 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "gbp",
    {"eligible": "n % 9 <> 0", "status": "if(n % 9 = 1, 'pending', 'verified')", "locations": f"array(named_struct('url', '{AT}/a', 'name', 'Tea & Co', 'address', 'Road 1', 'phone', if(k % 4 = 1, '999', '+1 23')))", **OWNED},
    pages=lambda rows: built_pages(rows.where("n % 8 <> 7"), url=f"'{AT}/a'", html=(
        "concat('<html><body>x', if(k % 4 = 2, '', '<script type=\"application/ld+json\">{\"@type\": \"LocalBusiness\", \"name\": \"TEA Co.\", \"telephone\": \"123\", \"address\": \"Road-1\"}</script>'), '</body></html>')"
    )),
)
case(
    "brand-entity-consistency",
    f"CASE WHEN k % 5 = 0 THEN 'not-applicable' WHEN k % 5 IN (1, 2) THEN 'fail' WHEN bal < 0 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "brand",
    {"names": "array(' Tea Co')", "profiles": "if(bal < 0, array('https://www.social.com/tea/', 'https://other.com/tea'), array('https://www.social.com/tea/'))", **OWNED},
    pages=lambda rows: built_pages(rows, html=(
        "concat('<html><body>x', if(k % 5 = 0, '', concat('<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"name\": \"', if(k % 5 = 1, 'Coffee', 'tea co '), '\", \"sameAs\": [\"http://social.com/', if(k % 5 = 2, 'coffee', 'TEA'), '\"]}</script>')), '</body></html>')"
    )),
)
case(
    "manual-a11y-evaluation",
    f"CASE WHEN n % 5 = 1 OR (k % 3 = 0 AND n % 4 = 2) THEN 'fail' WHEN {HOLDS} THEN 'warn' WHEN k % 3 = 0 AND n % 4 IN (0, 1) THEN 'warn' ELSE 'pass' END", "a11y_evaluation",
    {"blockers": "array(named_struct('criterion', '1.1.1', 'url', '/', 'resolved', n % 5 <> 1))", "conformance_claim": "if(k % 3 = 0, 'AA', ' ')", **OWNED},
    pages=lambda rows: built_pages(
        rows, rendered="n % 4 <> 0", axe="named_struct('error', if(n % 4 = 1, 'timeout', null), 'violations', if(n % 4 = 1, null, array(named_struct('id', 'alt', 'impact', if(n % 4 = 2, 'critical', 'minor'), 'nodes', 1))))"
    ),
)
case(
    "a11y-regression-sampling",
    "CASE WHEN n % 6 = 0 THEN 'not-applicable' WHEN n % 6 = 1 THEN 'not-applicable' WHEN n % 6 = 2 THEN 'fail' WHEN n % 6 = 3 THEN 'warn' ELSE 'pass' END",
    pages=lambda rows: built_pages(
        rows, rendered="true", axe="named_struct('error', string(null), 'violations', case n % 6 when 2 then array(named_struct('id', 'alt', 'impact', 'critical', 'nodes', 1)) when 3 then array(named_struct('id', 'a', 'impact', 'serious', 'nodes', 1), named_struct('id', 'b', 'impact', 'serious', 'nodes', 1)) "
        "when 4 then array(named_struct('id', 'old', 'impact', 'critical', 'nodes', 1)) else array() end)"
    ),
    tables={"previous_pages": lambda rows: previous(
        rows.where("n % 6 <> 0"), url=f"concat('{AT}/', if(n % 6 = 1, 'gone', ''))", axe="case when n % 6 = 3 then array(named_struct('id', 'a', 'impact', 'serious', 'nodes', 1)) else array(named_struct('id', 'old', 'impact', 'critical', 'nodes', 2)) end"
    )},
)


# ---- performance reports

_POLICY = "if(n % 9 = 0, null, named_struct('test_profile', 'phone', 'revision', timestamp '1999-06-01', 'owner', if(n % 9 = 8, ' ', 'o'), 'thresholds', map('lcp', 2500D, 'cls', 0.1D)))"
#: n % 9: 1 another profile, 2 too slow, 3 unread, 4 a metric missing, 5 too old
_REPORT = (
    "named_struct('url', '{0}/a', 'read', n % 9 <> 3, 'test_profile', if(n % 9 = 1, 'desktop', 'phone'), 'fetched_at', if(n % 9 = 5, timestamp '1999-05-01', timestamp '1999-12-01'), "
    "'metrics', if(n % 9 = 4, map('lcp', 2000D), map('lcp', if(n % 9 = 2, 2600D, 2400D), 'cls', 0.05D)), 'lcp_element', null)"
).replace("{0}", AT)
case(
    "lab-perf-budget",
    f"CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN k % 6 <> 0 AND n % 9 IN (1, 2) THEN 'fail' WHEN k % 6 = 0 OR n % 9 IN (3, 4, 5) THEN 'warn' WHEN n % 9 = 8 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "lighthouse",
    {"policy": _POLICY, "reports": f"if(k % 6 = 0, array(), array({_REPORT}))", **OWNED},
)
_ROW = "named_struct('pattern', '{0}', 'priority', {1}, 'status', {2}, 'indexable', {3}, 'canonical', {4}, 'in_sitemap', null, 'access', {5}, 'environment', {6})"


def _rows(*rows: tuple) -> str:
    return f"array({', '.join(_ROW.format(*r) for r in rows)})"


case(
    "template-lab-perf",
    f"CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN k % 6 = 0 THEN 'not-applicable' WHEN n % 9 IN (1, 2, 5) THEN 'fail' WHEN n % 9 IN (3, 4) THEN 'warn' WHEN n % 9 = 8 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END",
    "lighthouse", {"policy": _POLICY, "reports": f"array({_REPORT})", **OWNED}, inputs={"url_matrix": {"entries": _rows(("/a", "k % 6 <> 0", "200", "true", "null", "null", "null"), ("/p/*", "true", "200", "true", "null", "'private'", "null"))}},
)
case(
    "lcp-element-strategy",
    f"SELECT crawl_id, '{AT}/a' AS page_url, CASE n % 10 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'warn' WHEN 3 THEN 'fail' WHEN 4 THEN 'error' WHEN 5 THEN 'fail' WHEN 6 THEN 'pass' WHEN 7 THEN 'warn' WHEN 8 THEN 'not-applicable' ELSE 'pass' END AS outcome FROM {C}",
    "lighthouse",
    {
        "given": "n % 10 <> 0",
        "reports": (
            "array(named_struct('url', concat('{0}/', if(n % 10 = 1, 'b', 'a')), 'read', true, 'test_profile', 'phone', 'fetched_at', null, 'metrics', null, 'lcp_element', if(n % 10 = 2, null, "
            "named_struct('tag', if(n % 10 >= 7, 'p', 'img'), 'src', if(n % 10 >= 7, null, if(n % 10 = 5, '/gone.png', '/i.png')), 'loading', if(n % 10 = 3, 'LAZY', null), 'fetch_priority', null))))"
        ).replace("{0}", AT),
    },
    pages=lambda rows: built_pages(rows, url=f"'{AT}/a'", truncated="n % 10 = 4", html=(
        "concat('<html><head><style>', case n % 10 when 7 then '@font-face { src: url(x) }' when 9 then '@font-face { src: url(x); font-display: swap }' else 'p {}' end, '</style></head><body><img src=\"/i.png\"></body></html>')"
    )), by_page=True,
)

# ---- the URL matrix

#: /a by row: n % 9: 1 another status wanted, 2 not to be indexed, 3 a canonical wanted, 4 no row for it, 5 a priority row not reached, 6 an idle row
_MATRIX = (
    "case n % 9 when 0 then array({env}) when 1 then array({gone}) when 2 then array({hidden}) when 3 then array({self}) when 4 then array({other}) when 5 then array({plain}, {key}) when 6 then array({plain}, {idle}) else array({plain}) end"
).format(
    env=_ROW.format("/a", "true", "200", "true", "'none'", "null", "'staging'"), gone=_ROW.format("/a", "true", "410", "true", "'none'", "null", "null"), hidden=_ROW.format("/a", "false", "200", "false", "'none'", "null", "null"),
    self=_ROW.format("/a", "false", "200", "true", "'self'", "null", "null"), other=_ROW.format("/b", "false", "200", "true", "'none'", "null", "null"), plain=_ROW.format("/a", "true", "200", "true", "'none'", "null", "null"),
    key=_ROW.format("/key", "true", "200", "true", "'none'", "null", "null"), idle=_ROW.format("/idle/*", "false", "200", "true", "'none'", "null", "null"),
)
_ONE_A = lambda rows: built_pages(rows, url=f"'{AT}/a'")
case(
    "url-inventory-builder", f"CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 IN (1, 2, 3, 5) THEN 'fail' WHEN n % 9 IN (4, 6) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END",
    "url_matrix", {"entries": _MATRIX, **OWNED}, pages=_ONE_A,
)
case(
    "indexability-canary",
    f"CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN k % 4 <> 0 AND n % 9 IN (1, 2, 3) THEN 'fail' WHEN k % 4 = 0 AND bal < 0 AND n % 9 NOT IN (2, 4) THEN 'fail' WHEN n % 9 = 4 OR (k % 4 = 0 AND bal >= 0) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END",
    "canary", {"urls": f"array('{AT}/a')", **OWNED}, inputs={"url_matrix": {"entries": _MATRIX}}, pages=lambda rows: built_pages(rows.where("k % 4 <> 0"), url=f"'{AT}/a'"),
    tables={"blocked": lambda rows: rows.where("k % 4 = 0 and bal < 0").selectExpr("crawl_id", f"'{AT}/a' as url")},
)
_LIVE = _rows(("/a", "true", "200", "true", "null", "null", "if(k % 7 = 0, null, 'production')"), ("/hidden", "false", "200", "false", "null", "'private'", "null"), ("/key", "n % 9 = 5", "200", "true", "null", "null", "null"))
_ELSEWHERE = {"entries": f"array(named_struct('name', 'here', 'url', '{AT}', 'kind', if(k % 7 = 1, 'staging', 'production')))"}
case(
    "production-smoke-test",
    "CASE WHEN k % 7 IN (0, 1) THEN 'not-applicable' WHEN n % 9 IN (1, 2, 3) THEN 'fail' WHEN n % 9 = 5 THEN 'warn' ELSE 'pass' END", "url_matrix", {"entries": _LIVE}, inputs={"environments": _ELSEWHERE},
    pages=lambda rows: built_pages(rows, url=f"'{AT}/a'", status="if(n % 9 = 1, 503, 200)", html=f"if(n % 9 = 3, '<html><head>{NOINDEX}</head></html>', '<html></html>')").unionByName(
        built_pages(rows, url=f"'{AT}/hidden'", status="if(n % 9 = 2, 200, 401)", ordinal="1")
    ),
)
case(
    "live-analytics-smoke",
    f"CASE WHEN k % 7 IN (0, 1) THEN 'not-applicable' WHEN n % 9 = 0 THEN 'warn' WHEN n % 9 IN (1, 2, 3) THEN 'fail' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "analytics",
    {"measurement_ids": "array('G-1')", "events": "array(named_struct('name', if(n % 9 = 1, 'buy', 'view'), 'status', 'planned', 'trigger', 'load', 'owner', 'o', 'trigger_url', ''), named_struct('name', if(n % 9 = 2, 'view', 'leak'), 'status', if(n % 9 = 2, 'suppressed', 'suppressed'), 'trigger', 'load', 'owner', 'o', 'trigger_url', ''))", **OWNED},
    inputs={"url_matrix": {"entries": _LIVE}, "environments": _ELSEWHERE},
    pages=lambda rows: built_pages(rows, rendered="true", requests="if(n % 9 = 0, array('https://x.net/a.js'), array(concat('https://www.google-analytics.com/g/collect?v=2&tid=', if(n % 9 = 3, 'G-9', 'G-1'), '&en=view')))"),
)
case(
    "analytics-consent-matrix",
    f"SELECT crawl_id, '{AT}/' AS page_url, CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 = 1 THEN 'not-applicable' WHEN n % 9 = 2 THEN 'error' WHEN n % 9 IN (3, 4, 5) THEN 'fail' WHEN n % 9 = 6 THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END AS outcome FROM {C}",
    "analytics",
    {"given": "n % 9 <> 0", "consent_default": "if(n % 9 = 3, 'denied', 'granted')", "events": "array(named_struct('name', if(n % 9 = 4, 'buy', 'e0'), 'status', 'planned', 'trigger', 'load', 'owner', 'o', 'trigger_url', ''), named_struct('name', 'later', 'status', 'planned', 'trigger', 'click', 'owner', 'o', 'trigger_url', ''))", **OWNED},
    pages=lambda rows: built_pages(
        rows, rendered="n % 9 <> 1", render_error="if(n % 9 = 2, 'crash', null)", requests="transform(sequence(0, case n % 9 when 6 then 50 when 5 then 1 else 0 end), i -> concat('https://a.net/collect?en=e', if(n % 9 = 5, 0, i)))"
    ), by_page=True,
)

# ---- redirect maps and the previous audit

_OLD = "https://old.example.com"
_MAP = {
    "kind": "if(k % 5 = 0, 'cleanup', 'move')", "old_origin": f"'{_OLD}'",
    "entries": f"if(n % 9 = 0, array(), array(named_struct('from', '{_OLD}/a', 'expect', if(n % 9 = 3, 308, 301), 'to', '/new')))",
}
#: what the old URL answers, n % 9: 1 not asked, 2 no answer, 3 another status, 4 lands elsewhere, 5 many hops
_ASKED = lambda rows: fetches(
    rows.where("n % 9 <> 1"), "redirect-map", f"'{_OLD}/a'", status="if(n % 9 = 2, null, 200)", error="if(n % 9 = 2, 'timeout', null)", hops="if(n % 9 = 5, 2, 1)", final=f"concat('{AT}/', if(n % 9 = 4, 'other', 'new'))",
)
case(
    "migration-redirect-test", "CASE WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 IN (3, 4, 5) THEN 'fail' WHEN n % 9 IN (1, 2) THEN 'warn' ELSE 'pass' END", "redirect_map", _MAP, tables={"auxiliary": _ASKED},
)
case(
    "migration-redirects-live",
    f"CASE WHEN k % 7 IN (0, 1) THEN 'not-applicable' WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 IN (3, 4, 5) OR (bal < 0 AND k % 5 <> 0) THEN 'fail' WHEN n % 9 IN (1, 2) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "redirect_map",
    {**_MAP, **OWNED}, inputs={"url_matrix": {"entries": _LIVE}, "environments": _ELSEWHERE},
    tables={"auxiliary": lambda rows: _ASKED(rows).unionByName(fetches(rows, "old-root", f"'{_OLD}/'", hops="if(bal < 0, 0, 1)"))},
)
_BEFORE = lambda rows: previous(rows.where("k % 6 <> 0"), url=f"'{_OLD}/a'", title="'Old tea'", h1="'Green tea leaves'", words="100")
case(
    "post-migration-monitor",
    f"CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN n % 9 IN (3, 4, 5) OR (n % 9 <> 0 AND k % 4 IN (1, 2)) THEN 'fail' WHEN n % 9 IN (1, 2) OR (n % 9 <> 0 AND k % 4 = 3) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "redirect_map",
    {**_MAP, **OWNED}, tables={"auxiliary": _ASKED, "previous_pages": _BEFORE, "blocked": lambda rows: rows.where("k % 4 = 2").selectExpr("crawl_id", f"'{AT}/new' as url")},
    pages=lambda rows: built_pages(rows.where("k % 4 < 2"), url=f"'{AT}/new'", html=f"if(k % 4 = 1, '<html><head>{NOINDEX}</head></html>', '<html></html>')"),
)
case(
    "content-parity-diff",
    f"CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN n % 9 <> 0 AND k % 7 IN (1, 2, 3) THEN 'fail' WHEN n % 9 = 0 THEN 'not-applicable' WHEN k % 7 IN (4, 5) THEN 'warn' WHEN {HOLDS} THEN 'warn' ELSE 'pass' END", "redirect_map", {**_MAP, **OWNED},
    tables={"previous_pages": _BEFORE},
    pages=lambda rows: built_pages(rows.where("k % 7 <> 5"), url=f"'{AT}/new'", html=(
        f"concat('<html><head><title>', if(k % 7 = 4, 'New', 'old TEA'), '</title>', if(k % 7 = 3, '<link rel=\"canonical\" href=\"{AT}/else\">', ''), '</head><body><h1>', if(k % 7 = 1, 'Coffee', 'Tea'), '</h1><p>', repeat('word ', if(k % 7 = 2, 49, 50)), '</p></body></html>')"
    )),
)
case(
    "production-crawl-verify",
    "CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN n % 9 IN (1, 2, 3, 4) OR bal < 0 THEN 'fail' WHEN n % 9 = 5 THEN 'warn' ELSE 'pass' END", site={"production_origin": "if(k % 2 = 0, 'https://live.example.com', null)"},
    tables={
        "previous_pages": lambda rows: previous(rows.where("k % 6 <> 0"), url=f"concat(if(k % 2 = 0, 'https://live.example.com', '{AT}'), '/a')"), "blocked": lambda rows: rows.where("n % 9 = 4").selectExpr("crawl_id", f"'{AT}/a' as url"),
    },
    inputs={"url_matrix": {"entries": _rows(("/key", "bal < 0", "200", "true", "null", "null", "null"))}},
    pages=lambda rows: built_pages(rows.where("n % 9 not in (4, 5)"), url=f"'{AT}/a'", status="if(n % 9 = 1, 404, 200)", html=f"concat('<html><head>', if(n % 9 = 2, '{NOINDEX}', ''), if(n % 9 = 3, '<link rel=\"canonical\" href=\"{AT}/x\">', ''), '</head></html>')"),
)
case(
    "schema-hreflang-maintenance",
    "CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN n % 9 IN (1, 2) THEN 'fail' WHEN n % 9 = 3 THEN 'warn' ELSE 'pass' END",
    tables={"previous_pages": lambda rows: previous(
        several(rows.where("k % 6 <> 0"), 2), url=f"concat('{AT}/', i)", json_ld_types="array('Article')", hreflang=f"array(named_struct('hreflang', if(i = 0, 'de', 'en'), 'url', concat('{AT}/', 1 - i)))"
    )},
    pages=lambda rows: built_pages(several(rows, 2), url=f"concat('{AT}/', i)", ordinal="i", html=(
        "concat('<html><head>', if(n % 9 = 2 and i = 1, '', concat('<link rel=\"alternate\" hreflang=\"', if(i = 0, 'de', 'en'), '\" href=\"{0}/', 1 - i, '\">')), '</head><body>x<script type=\"application/ld+json\">', "
        "case when n % 9 = 1 then '{broken' when n % 9 = 3 then '{\"@type\": \"Product\"}' else '{\"@type\": [\"Article\", \"Thing\"]}' end, '</script></body></html>')"
    ).replace("{0}", AT)),
)

# ---- structured data, commerce and articles


def _ld(*parts: str) -> str:
    """SQL: a page with one block of JSON-LD, whose text the parts are concatenated to."""
    return "concat('<html><head><title>T</title></head><body><h1>H</h1>x<script type=\"application/ld+json\">', " + ", ".join(parts) + ", '</script></body></html>')"


_SHOP = {"flags": "if(k % 8 = 0, array(), array('ecommerce'))"}
case(
    "product-schema",
    "CASE WHEN k % 8 = 0 THEN 'not-applicable' WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 IN (1, 2, 3) THEN 'fail' WHEN n % 9 IN (4, 5, 6) THEN 'warn' ELSE 'pass' END", site=_SHOP,
    pages=lambda rows: built_pages(rows, html=_ld(
        "'{\"@type\": \"', if(n % 9 = 0, 'Thing', 'Product'), '\"', if(n % 9 = 1, '', ', \"name\": \"Cup\"'), if(n % 9 = 4, '', ', \"image\": \"/i.png\"'), if(n % 9 = 5, '', ', \"gtin\": \"1\"')",
        "if(n % 9 = 2, '', concat(', \"offers\": {\"@type\": \"Offer\", \"price\": 1', if(n % 9 = 3, '', ', \"priceCurrency\": \"EUR\"'), if(n % 9 = 6, '', ', \"availability\": \"InStock\"'), '}')), '}'",
    )),
)
case(
    "product-lifecycle-state",
    "CASE WHEN k % 8 = 0 THEN 'not-applicable' WHEN n % 9 IN (0, 1, 2) THEN 'not-applicable' WHEN n % 9 IN (3, 4, 5) THEN 'fail' ELSE 'pass' END", site=_SHOP,
    tables={"sitemap_urls": lambda rows: rows.where("n % 9 = 4").selectExpr("crawl_id", f"'{AT}/0' as url", f"'{AT}/0' as normalized_url")},
    #: n % 9: 0 no product, 1 silent, 2 for sale, 3 sold out and hidden, 4 retired, hidden and listed, 5 retired in two ways, 6 sold out and kept, else retired alike
    pages=lambda rows: built_pages(several(rows, 2), url=f"concat('{AT}/', i)", ordinal="i", html=(
        f"concat('<html><head>', if(n % 9 in (3, 4) or (n % 9 = 5 and i = 0), '{NOINDEX}', ''), '</head><body>x<script type=\"application/ld+json\">', "
        "'{\"@type\": \"', if(n % 9 = 0, 'Thing', 'Product'), '\", \"offers\": {\"availability\": \"http://schema.org/', case when n % 9 = 1 then '' when n % 9 = 2 then 'PreOrder' when n % 9 in (3, 6) then 'SoldOut' else 'Discontinued' end, '\"}}</script></body></html>')"
    )),
)
case(
    "product-variant-canonical",
    "CASE WHEN k % 8 = 0 THEN 'not-applicable' WHEN n % 9 IN (0, 1) THEN 'not-applicable' WHEN n % 9 IN (2, 3, 4) THEN 'fail' ELSE 'pass' END", site=_SHOP,
    #: n % 9: 0 no product, 1 one address, 2 no canonical, 3 alike and each its own, 4 a canonical that is gone, 5 one canonical, 6 hidden variants, else each its own and unlike
    pages=lambda rows: built_pages(several(rows, 3).where("i < 2 or n % 9 = 4").where("n % 9 <> 1 or i = 0"), ordinal="i", url=f"concat('{AT}/', if(i = 2, 'gone', concat('cup?c=', i)))", status="if(i = 2, 410, 200)", html=(
        "concat('<html><head><title>', if(n % 9 = 3, 'Cup', concat('Cup ', i)), '</title>', if(n % 9 = 6 and i = 1, '{1}', ''), if(n % 9 = 2, '', concat('<link rel=\"canonical\" href=\"{0}/', case when n % 9 = 4 then 'gone' when n % 9 = 5 then 'cup?c=0' else concat('cup?c=', i) end, '\">')), "
        "'</head><body>x<script type=\"application/ld+json\">{\"@type\": \"', if(n % 9 = 0 or i = 2, 'Thing', 'Product'), '\"}</script></body></html>')"
    ).replace("{0}", AT).replace("{1}", NOINDEX)),
)
case(
    "review-integrity", "CASE WHEN n % 8 = 0 THEN 'not-applicable' WHEN n % 8 IN (1, 2, 3) THEN 'fail' WHEN n % 8 = 4 THEN 'warn' ELSE 'pass' END",
    pages=lambda rows: built_pages(rows, html=_ld(
        "if(n % 8 = 0, '{}', concat('[{\"@type\": \"Organization\", \"name\": \"Tea Co\"}, {\"@type\": \"Review\"', if(n % 8 = 1, '', ', \"author\": \"A\"'), if(n % 8 = 4, '', ', \"datePublished\": \"2026-01-01\"'), ', \"itemReviewed\": {\"name\": \"', if(n % 8 = 2, 'tea co', 'Cup'), '\"}}, '"
        ", '{\"@type\": \"AggregateRating\", \"ratingValue\": 5, \"reviewCount\": ', if(n % 8 = 3, 0, 1 + abs(k)), '}]'))"
    )),
)
case(
    "paywall-access-model", "CASE WHEN k % 8 = 0 THEN 'not-applicable' WHEN n % 8 = 0 THEN 'not-applicable' WHEN n % 8 IN (1, 2, 3, 4) THEN 'fail' ELSE 'pass' END", site={"flags": "if(k % 8 = 0, array(), array('paywall'))"},
    pages=lambda rows: built_pages(rows, html=_ld(
        "if(n % 8 = 0, '{}', concat('{\"@type\": \"Article\"', if(n % 8 = 1, '', concat(', \"isAccessibleForFree\": ', if(n % 8 = 2, '\"perhaps\"', 'false'))), ', \"hasPart\": {\"isAccessibleForFree\": ', if(n % 8 = 3, '1', '\"False\"'), if(n % 8 = 4, '', ', \"cssSelector\": \".paid\"'), '}}'))"
    )),
)
case(
    "schema-eligibility-matrix",
    "CASE WHEN k % 8 = 0 THEN 'not-applicable' WHEN n % 9 = 0 THEN 'not-applicable' WHEN n % 9 IN (1, 2, 3, 4, 5) THEN 'fail' WHEN n % 9 = 6 THEN 'warn' ELSE 'pass' END", site={"flags": "if(k % 8 = 0, array(), array('structured-data'))"},
    #: n % 9: 0 no page, 1 does not parse, 2 no context, 3 a property is missing, 4 a name that is not shown, 5 no structured data, 6 a type without results
    pages=lambda rows: built_pages(rows.where("n % 9 <> 0"), html=(
        "concat('<html><head><title>Tea</title></head><body>Green   tea for all', if(n % 9 = 5, '', concat('<script type=\"application/ld+json\">', if(n % 9 = 1, '{{', '{'), if(n % 9 = 2, '', '\"@context\": \"https://schema.org\", '), "
        "'\"@type\": \"', if(n % 9 = 6, 'HowTo', 'Event'), '\", \"step\": \"s\", \"startDate\": \"2026-01-01\"', if(n % 9 = 3, '', ', \"location\": \"Here\"'), ', \"name\": \"', if(n % 9 = 4, 'Black Tea', 'Green Tea'), '\"}</script>')), '</body></html>')"
    )),
)
_ARTICLE = "'{{\"@type\": \"NewsArticle\"', if({0}, '', ', \"author\": {{\"name\": \"Ann\"}}'), if({1}, '', concat(', \"datePublished\": \"', {2}, '\"')), if({3}, ', \"dateModified\": \"2026-01-01\"', ''), '}}'"
case(
    "author-date-signals",
    "CASE WHEN n % 9 = 0 THEN 'error' WHEN n % 9 = 1 THEN 'not-applicable' WHEN n % 9 IN (2, 3, 4) THEN 'fail' WHEN n % 9 IN (5, 6, 7) THEN 'warn' ELSE 'pass' END",
    #: n % 9: 0 cut, 1 no article, 2 unreadable, 3 backwards, 4 future, 5 no author, 6 no date, 7 one time of day for all
    pages=lambda rows: built_pages(several(rows, 5), url=f"concat('{AT}/', i)", ordinal="i", truncated="n % 9 = 0", headers="map('date', 'Mon, 01 Jun 2026 10:00:00 GMT')", html="if(n % 9 = 1, '<html>x</html>', {0})".format(
        _ld(_ARTICLE.format("n % 9 = 5", "n % 9 = 6", "case when n % 9 = 2 then 'soon' when n % 9 = 3 then '2026-02-01' when n % 9 = 4 then '2026-07-01' when n % 9 = 7 then '2025-05-05T10:00' else concat('2025-05-0', i + 1, 'T10:0', i) end", "n % 9 = 3"))
    )), once=True,
)
case(
    "publisher-discover-readiness", "CASE WHEN n % 8 = 0 THEN 'not-applicable' WHEN n % 8 IN (1, 2) THEN 'fail' WHEN n % 8 = 3 THEN 'warn' ELSE 'pass' END",
    pages=lambda rows: built_pages(rows, headers="if(n % 8 = 2, map('x-robots-tag', 'max-image-preview:standard'), map('a', 'b'))", html=(
        "concat('<html><head><meta name=\"robots\" content=\"', if(k % 2 = 0, 'max-image-preview: Large', 'all'), '\">', if(n % 8 = 3, '', '<meta property=\"og:image\" content=\"/i.png\">'), '<meta property=\"og:image:width\" content=\"', if(n % 8 = 1, '1199', '1200'), '\"></head>"
        "<body>x<script type=\"application/ld+json\">{\"@type\": \"', if(n % 8 = 0, 'Thing', 'https://schema.org/BlogPosting'), '\"}</script></body></html>')"
    ).replace("if(k % 2 = 0, 'max-image-preview: Large', 'all')", "if(k % 2 = 0 and n % 8 <> 2, 'max-image-preview: Large', 'all')")),
)
case(
    "news-article-policy",
    "CASE WHEN n % 9 = 0 THEN 'error' WHEN n % 9 = 1 THEN 'not-applicable' WHEN n % 9 IN (2, 3) THEN 'fail' WHEN n % 9 IN (4, 5, 6) THEN 'warn' ELSE 'pass' END",
    #: n % 9: 0 listed and not read, 1 no news, 2 dated otherwise than listed, 3 sponsored in secret, 4 no author, 5 no date, 6 no contact
    tables={"sitemap_news": lambda rows: rows.where("n % 9 in (0, 2)").selectExpr("crawl_id", f"'{AT}/s.xml' as sitemap", f"'{AT}/a' as loc", "'P' as publication_name", "'en' as language", "'2025-05-05' as publication_date", "'T' as title")},
    pages=lambda rows: built_pages(rows.where("n % 9 <> 0"), url=f"concat('{AT}/', if(n % 9 = 3, 'sponsored/a', 'a'))", html=(
        "concat('<html><body><a href=\"/about\">About us</a>', if(n % 9 = 6, '', '<a href=\"mailto:a@b.c\">Write</a>'), '<p>News</p><script type=\"application/ld+json\">', "
        + ("if(n % 9 = 1, '{}', concat(" + _ARTICLE.format("n % 9 = 4", "n % 9 = 5", "if(n % 9 = 2, '2025-05-09', '2025-05-05')", "false") + "))") + ", '</script></body></html>')"
    )),
)

# ---- links, languages and sitemaps

_LINK = "concat('<a href=\"', {0}, '\"', {1}, '>', {2}, '</a>')"
case(
    "outbound-link-qualification", "CASE WHEN n % 8 = 0 THEN 'not-applicable' WHEN n % 8 = 1 THEN 'not-applicable' WHEN n % 8 IN (2, 3) THEN 'fail' ELSE 'pass' END",
    pages=lambda rows: built_pages(rows.where("n % 8 <> 0"), url=f"concat('{AT}/', if(n % 8 = 1, 'tea', if(n % 8 = 3, 'tea', 'Paid-Posts/tea')))", html=(
        "concat('<html><body>', " + _LINK.format("'https://shop.net/'", "case when n % 8 in (1, 2, 3) then '' when n % 8 = 4 then ' rel=\"nofollow noopener\"' else ' rel=\"sponsored\"' end", "'Buy'") + ", "
        + _LINK.format("'/own'", "''", "'Own'") + ", if(n % 8 = 3, '<script type=\"application/ld+json\">{\"@type\": \"AdvertiserContentArticle\"}</script>', ''), '</body></html>')"
    )),
)
case(
    "ugc-governance", "CASE WHEN n % 6 = 0 THEN 'not-applicable' WHEN n % 6 IN (1, 2) THEN 'fail' ELSE 'pass' END",
    pages=lambda rows: built_pages(rows, html=(
        "concat('<html><body>', if(n % 6 = 0, '', concat('<div id=\"comments\">', if(n % 6 = 2, '', '<form><textarea name=\"comment\"></textarea></form>'), " + _LINK.format("if(n % 6 = 3, '/own', 'https://x.net/')", "case when n % 6 in (1, 2, 3) then '' when n % 6 = 4 then ' rel=\"ugc\"' else ' rel=\"nofollow\"' end", "'Me'")
        + ", '</div>')), if(n % 6 = 2, '<script type=\"application/ld+json\">{\"@type\": \"Comment\"}</script>', ''), '</body></html>')"
    )),
)
case(
    "pagination-crawl-path",
    "CASE WHEN n % 9 IN (0, 1) THEN 'not-applicable' WHEN n % 9 IN (2, 3) THEN 'fail' WHEN n % 9 = 4 THEN 'warn' WHEN n % 9 IN (5, 6) THEN 'fail' ELSE 'pass' END",
    #: n % 9: 0 no page, 1 no series, 2 fragments, 3 an error, 4 not reached, 5 hidden, 6 canonical to the first
    pages=lambda rows: built_pages(several(rows.where("n % 9 <> 0"), 2).where("i = 0 or n % 9 <> 4"), ordinal="i", url=f"concat('{AT}/tea', if(i = 1, '?page=2', ''))", status="if(i = 1 and n % 9 = 3, 500, 200)", html=(
        "concat('<html><head>', if(i = 1 and n % 9 = 5, '{1}', ''), if(i = 1 and n % 9 = 6, '<link rel=\"canonical\" href=\"{0}/tea\">', ''), '</head><body>', case when i = 1 then '' when n % 9 = 1 then '<a href=\"/x\">x</a>' when n % 9 = 2 then '<a href=\"#page-2\">2</a>' else '<a href=\"/tea?page=2\">2</a>' end, '</body></html>')"
    ).replace("{0}", AT).replace("{1}", NOINDEX)),
)
case(
    "internal-search-indexability", "CASE WHEN n % 6 = 0 THEN 'not-applicable' WHEN n % 6 IN (1, 2) THEN 'fail' ELSE 'pass' END",
    tables={"blocked": lambda rows: rows.where("n % 6 in (1, 3)").selectExpr("crawl_id", f"'{AT}/search/tea' as url")},
    pages=lambda rows: built_pages(rows, url=f"concat('{AT}/', case when n % 6 in (0, 3) then 'research?x=1' when n % 6 in (1, 4) then 'suche' else 'find?a=1&q=tea' end)", html=f"if(n % 6 >= 4, '<html><head>{NOINDEX}</head></html>', '<html></html>')"),
)
_ALT = "concat('<link rel=\"alternate\" hreflang=\"', {0}, '\" href=\"', {1}, '\">')"
case(
    "hreflang-cluster-qa",
    "CASE WHEN n % 9 IN (0, 1) THEN 'not-applicable' WHEN n % 9 IN (2, 3, 4, 5) THEN 'fail' WHEN n % 9 IN (6, 7) THEN 'warn' ELSE 'pass' END",
    #: n % 9: 0 none, 1 canonical elsewhere, 2 one-sided, 3 without itself, 4 hidden, 5 no tag, 6 a target not fetched, 7 no x-default
    pages=lambda rows: built_pages(several(rows, 2), url=f"concat('{AT}/', i)", ordinal="i", html=(
        "concat('<html><head>', if(n % 9 = 4 and i = 0, '{1}', ''), if(n % 9 = 1, '<link rel=\"canonical\" href=\"{0}/x\">', ''), if(n % 9 = 0 or (n % 9 = 2 and i = 1), '', concat(".replace("{0}", AT).replace("{1}", NOINDEX)
        + f"if(n % 9 = 3, '', {_ALT.format('if(n % 9 = 5, ' + repr('english') + ', if(i = 0, ' + repr('en') + ', ' + repr('de-AT') + '))', f'concat({AT!r}, {chr(39)}/{chr(39)}, i)')}), "
        + _ALT.format("if(i = 0, 'de-AT', 'en')", f"concat('{AT}/', 1 - i)") + ", " + f"if(n % 9 = 6, {_ALT.format(repr('fr'), repr(AT + '/gone'))}, ''), " + f"if(n % 9 = 7, '', {_ALT.format(repr('x-default'), repr(AT + '/0'))})" + ")), '</head><body>x</body></html>')"
    )),
)
case(
    "hreflang-implementation",
    "CASE WHEN n % 12 = 0 THEN CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'not-applicable' END WHEN n % 12 IN (1, 2, 3, 4, 5) THEN 'fail' WHEN n % 12 IN (6, 7, 8) THEN 'warn' ELSE 'pass' END", site={"flags": "if(k % 2 = 0, array('multilingual'), array())"},
    #: n % 12: 0 none, 1 no locale, 2 relative, 3 one tag twice, 4 two languages of one URL, 5 x-default twice, 6 a region not documented, 7 two regions of one URL, 8 x-default beside one locale
    pages=lambda rows: built_pages(rows, html=(
        "concat('<html><head>', if(n % 12 = 0, '', concat(" + _ALT.format("if(n % 12 = 1, 'english-x', if(n % 12 = 7, 'en-GB', 'en'))", f"if(n % 12 = 2, '/', '{AT}/')") + ", "
        + "if(n % 12 = 8, '', " + _ALT.format("case n % 12 when 3 then 'EN' when 6 then 'de-150' when 7 then 'en-US' else 'de' end", f"if(n % 12 in (4, 7), '{AT}/', '{AT}/de')") + "), "
        + _ALT.format("'x-default'", f"'{AT}/any'") + ", " + f"if(n % 12 = 5, {_ALT.format(repr('x-default'), repr(AT + '/any'))}, '')" + ")), '</head><body>x</body></html>')"
    )),
)
case(
    "locale-content-parity",
    "CASE WHEN n % 6 = 0 THEN CASE WHEN k % 2 = 0 THEN 'warn' ELSE 'not-applicable' END WHEN n % 6 IN (1, 2) THEN 'fail' WHEN n % 6 = 3 THEN 'warn' ELSE 'pass' END", site={"flags": "if(k % 2 = 0, array('multilingual'), array())"},
    pages=lambda rows: built_pages(several(rows, 2), url=f"concat('{AT}/', i)", ordinal="i", html=(
        "concat('<html lang=\"', if(i = 0, 'en', 'de'), '\"><head>', if(n % 6 = 0, '', " + _ALT.format("if(i = 0, 'de', 'en')", f"concat('{AT}/', 1 - i)") + "), '</head><body><h1>', if(n % 6 > 3 and i = 1, 'Tee', 'Tea'), '</h1>', if(n % 6 = 3, '', '<h2> Cups</h2>'), 'x</body></html>')"
    )),
)
case(
    "locale-canonical",
    f"""SELECT crawl_id, '{AT}/' || i AS page_url, CASE n % 9 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'not-applicable' WHEN 3 THEN 'warn' WHEN 4 THEN 'fail' WHEN 5 THEN 'pass'
 WHEN 6 THEN CASE i WHEN 0 THEN 'pass' ELSE 'warn' END WHEN 7 THEN CASE i WHEN 0 THEN 'pass' ELSE 'fail' END ELSE 'fail' END AS outcome FROM {C}, range(2) AS r(i)""",
    #: n % 9: 0 an error, 1 none, 2 itself alone, 3 no canonical, 4 no usable one, 5 its own, 6 a region's canonical to another, 7 to another language, 8 to a URL that nothing names
    pages=lambda rows: built_pages(several(rows, 2), url=f"concat('{AT}/', i)", ordinal="i", status="if(n % 9 = 0, 404, 200)", html=(
        "concat('<html><head>', if(n % 9 in (3), '', concat('<link rel=\"canonical\" href=\"', case n % 9 when 4 then 'mailto:x' when 8 then '{0}/x' when 5 then concat('{0}/', i) else '{0}/0' end, '\">')), if(n % 9 = 1, '', concat("
        + _ALT.format("case when i = 0 then 'en-GB' when n % 9 = 6 then 'en-US' else 'de' end", "concat('{0}/', i)") + ", if(n % 9 = 2, '', " + _ALT.format("case when i = 1 then 'en-GB' when n % 9 = 6 then 'en-US' else 'de' end", "concat('{0}/', 1 - i)") + "))), '</head><body>x</body></html>')"
    ).replace("{0}", AT)), by_page=True,
)


def _listed(rows: DataFrame, url: str) -> DataFrame:
    return rows.selectExpr("crawl_id", f"{url} as url", f"{url} as normalized_url")


case(
    "sitemap-validity",
    "CASE WHEN n % 8 = 0 THEN 'fail' WHEN n % 8 = 1 THEN 'warn' WHEN n % 8 IN (2, 3, 4) THEN 'fail' ELSE 'pass' END",
    tables={
        "sitemaps": lambda rows: _sitemaps(rows, status="if(n % 8 = 0, 404, 200)", url_count="if(n % 8 = 2, 50001, 50000)"),
        "sitemap_urls": lambda rows: _listed(several(rows.where("n % 8 > 1"), 3), f"concat(if(n % 8 = 3 and i = 2, 'https://www.example.com/', '{AT}/'), i)"),
    },
    pages=lambda rows: built_pages(several(rows, 2), url=f"concat('{AT}/', i)", ordinal="i", status="if(n % 8 = 4 and i = 1, 410, 200)"),
)
case(
    "sitemap-canonical-agreement", "CASE WHEN n % 5 = 0 THEN 'not-applicable' WHEN n % 5 = 1 THEN 'fail' ELSE 'pass' END",
    tables={"sitemap_urls": lambda rows: _listed(several(rows.where("n % 5 <> 0"), 2), f"concat('{AT}/', i)")},
    pages=lambda rows: built_pages(several(rows, 3), url=f"concat('{AT}/', i)", ordinal="i", html=f"concat('<html><head>', if(n % 5 = 4, '', concat('<link rel=\"canonical\" href=\"{AT}/', case when i = 2 or (n % 5 = 1 and i = 1) then 'x' else string(i) end, '\">')), '</head></html>')"),
)
case(
    "index-bloat",
    "CASE WHEN n % 8 IN (0, 1) THEN 'not-applicable' WHEN n % 8 = 2 THEN 'error' WHEN n % 8 = 3 THEN 'warn' WHEN n % 8 = 4 THEN 'fail' WHEN n % 8 = 5 THEN 'warn' ELSE 'pass' END",
    #: of five pages; n % 8: 0 all hidden, 1 none listed at all, 2 a sitemap cut, 3 feeds only, 4 two unlisted, 5 one unlisted
    tables={
        "sitemaps": lambda rows: _sitemaps(rows, truncated="n % 8 = 2", news_count="if(n % 8 = 3, 1, 0)"),
        "sitemap_urls": lambda rows: _listed(several(rows.where("n % 8 <> 1"), 5).where("i < case n % 8 when 3 then 3 when 4 then 3 when 5 then 4 else 5 end"), f"concat('{AT}/', i)"),
    },
    pages=lambda rows: built_pages(several(rows, 5), url=f"concat('{AT}/', i)", ordinal="i", html=f"if(n % 8 = 0, '<html><head>{NOINDEX}</head></html>', '<html></html>')"),
)


def _news(rows: DataFrame, **given: str) -> DataFrame:
    names = [f.strip().split(" ", 1) for f in _columns(schemas.SITEMAP_NEWS)][1:]
    told = {"sitemap": f"'{AT}/news.xml'", "loc": f"'{AT}/a'", "publication_name": "'P'", "language": "'en'", "publication_date": "'1999-12-31T10:00:00Z'", "title": "'T'"} | given
    return rows.selectExpr("crawl_id", *[f"cast({told[n]} as {t}) as {n}" for n, t in names])


case(
    "news-sitemap",
    "CASE n % 14 WHEN 0 THEN 'fail' WHEN 1 THEN 'fail' WHEN 2 THEN 'error' WHEN 3 THEN 'not-applicable' WHEN 4 THEN 'error' WHEN 5 THEN 'fail' WHEN 6 THEN 'fail' WHEN 7 THEN 'fail' WHEN 8 THEN 'fail' WHEN 9 THEN 'fail' WHEN 10 THEN 'warn' WHEN 11 THEN 'warn' WHEN 12 THEN 'warn' ELSE 'pass' END",
    #: n % 14: 0 not fetched, 1 crowded, 2 cut, 3 empty, 4 no fetch time, 5 incomplete, 6 no language, 7 no date, 8 future, 9 old, 10 elsewhere, 11 a region, 12 nearly old
    tables={
        "sitemaps": lambda rows: _sitemaps(rows, url=f"'{AT}/news.xml'", status="if(n % 14 = 0, 500, 200)", news_count="if(n % 14 = 1, 1001, 1)", truncated="n % 14 = 2", fetched_at="if(n % 14 = 4, null, timestamp '2000-01-01 00:00:00')"),
        "sitemap_news": lambda rows: _news(
            rows.where("n % 14 <> 3"), loc=f"if(n % 14 = 10, 'https://else.net/a', '{AT}/a')", title="if(n % 14 = 5, null, 'T')", language="case n % 14 when 6 then 'e' when 11 then 'en-GB' else if(k % 2 = 0, 'en', 'zh-CN') end",
            publication_date="case n % 14 when 7 then 'today' when 8 then '2000-01-01T01:00:01Z' when 9 then '1999-12-28T23:59:59Z' when 12 then '1999-12-29T12:00:00Z' else '1999-12-31T10:00:00+02:00' end",
        ),
    },
)


def _video(rows: DataFrame, **given: str) -> DataFrame:
    names = [f.strip().split(" ", 1) for f in _columns(schemas.SITEMAP_VIDEO)][1:]
    told = {"sitemap": f"'{AT}/video.xml'", "loc": f"'{AT}/v'", "title": "'T'", "description": "'D'", "thumbnail_url": f"'{AT}/t.png'", "content_url": f"'{AT}/c.mp4'", "player_url": "null"} | given
    return rows.selectExpr("crawl_id", *[f"cast({told[n]} as {t}) as {n}" for n, t in names])


case(
    "video-sitemap",
    "CASE n % 9 WHEN 0 THEN 'fail' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' WHEN 4 THEN 'error' WHEN 5 THEN 'warn' WHEN 6 THEN 'warn' ELSE 'pass' END",
    #: n % 9: 0 not fetched, 1 empty, 2 no address of the video, 3 barred, 4 cut, 5 the page shows none, 6 elsewhere
    site={"robots_txt": "if(n % 9 = 3, 'User-agent: *\\nDisallow: /t', 'User-agent: *\\nDisallow: /x')"},
    tables={
        "sitemaps": lambda rows: _sitemaps(rows, url=f"'{AT}/video.xml'", status="if(n % 9 = 0, null, 200)", video_count="1", truncated="n % 9 = 4"),
        "sitemap_video": lambda rows: _video(rows.where("n % 9 <> 1"), content_url=f"if(n % 9 = 2, null, '{AT}/c.mp4')", loc=f"if(n % 9 = 6, 'https://else.net/v', '{AT}/v')"),
    },
    pages=lambda rows: built_pages(rows, url=f"'{AT}/v'", html="if(n % 9 = 5, '<html>x</html>', '<html><body><video src=\"/c.mp4\" controls></video></body></html>')"),
)
_CLIP = "'<video src=\"/c.mp4\" poster=\"/t.png\" controls></video>'"
case(
    "video-watch-page",
    f"SELECT crawl_id, '{AT}/v' AS page_url, CASE n % 9 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'not-applicable' WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' WHEN 5 THEN 'warn' WHEN 6 THEN 'warn' ELSE 'pass' END AS outcome FROM {C}",
    #: n % 9: 0 no player, 1 beside a product, 2 an error, 3 hidden, 4 the thumbnail barred, 5 under 50 words, 6 canonical elsewhere
    site={"robots_txt": "if(n % 9 = 4, 'User-agent: Googlebot\\nDisallow: /t.png', '')"},
    pages=lambda rows: built_pages(rows, url=f"'{AT}/v'", status="if(n % 9 = 2, 410, 200)", html=(
        "concat('<html><head>', if(n % 9 = 3, '{1}', ''), if(n % 9 = 6, '<link rel=\"canonical\" href=\"{0}/x\">', ''), '</head><body><h1>H</h1>', repeat('word ', if(n % 9 = 5, 48, 50)), if(n % 9 = 0, '', {2}), if(n % 9 = 1, '<script type=\"application/ld+json\">{\"@type\": \"Product\"}</script>', ''), '</body></html>')"
    ).replace("{0}", AT).replace("{1}", NOINDEX).replace("{2}", _CLIP)), by_page=True,
)
case(
    "videoobject-schema",
    f"SELECT crawl_id, '{AT}/v' AS page_url, CASE n % 9 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' WHEN 5 THEN 'warn' WHEN 6 THEN 'warn' ELSE 'pass' END AS outcome FROM {C}",
    #: n % 9: 0 none, 1 does not parse, 2 no markup, 3 no thumbnail, 4 no date, 5 two players, 6 another video
    pages=lambda rows: built_pages(rows, url=f"'{AT}/v'", html=(
        "concat('<html><body>x', if(n % 9 = 0, '', {2}), if(n % 9 = 5, '<iframe src=\"https://www.youtube.com/embed/abc\"></iframe>', ''), if(n % 9 in (0, 2), '', concat('<script type=\"application/ld+json\">', if(n % 9 = 1, '[', ''), '{\"@type\": \"VideoObject\", \"name\": \"N\"', "
        "if(n % 9 = 3, '', ', \"thumbnailUrl\": \"/t.png\"'), ', \"uploadDate\": \"', if(n % 9 = 4, 'long ago', '2026-01-01'), '\", \"contentUrl\": \"https://cdn.net/', if(n % 9 = 6, 'other', 'c'), '.mp4\"}</script>')), '</body></html>')"
    ).replace("{2}", _CLIP)), by_page=True,
)

# ---- hosts, protocol and crawlers

case(
    "host-redirect",
    "CASE n % 10 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' WHEN 4 THEN 'warn' WHEN 5 THEN 'fail' WHEN 6 THEN 'warn' WHEN 7 THEN 'warn' ELSE 'pass' END",
    #: of two variants; n % 10: 0 not asked, 1 no answers, 2 an error, 3 insecure, 4 two places of one canonical, 5 two places, 6 several hops, 7 one does not answer
    tables={"auxiliary": lambda rows: fetches(
        several(rows.where("n % 10 <> 0"), 2), "host-variant", "concat('http://', if(i = 0, '', 'www.'), 'example.com/')", status="case when n % 10 = 1 or (n % 10 = 7 and i = 1) then null when n % 10 = 2 then 403 else 200 end",
        error="if(n % 10 = 1 or (n % 10 = 7 and i = 1), 'no address', null)", final=f"concat(if(n % 10 = 3, 'http', 'https'), '://', if(n % 10 in (4, 5) and i = 1, 'www.', ''), 'example.com/')", hops="if(n % 10 = 6, 2, 1)",
        body=f"if(n % 10 = 4, '<html><head><link rel=\"canonical\" href=\"{AT}/\"></head></html>', '<html></html>')",
    )},
)
case(
    "favicon-site-name",
    "CASE n % 9 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' WHEN 4 THEN 'warn' WHEN 5 THEN 'fail' WHEN 6 THEN 'fail' WHEN 7 THEN 'fail' ELSE CASE WHEN k % 2 = 0 THEN 'warn' ELSE 'pass' END END",
    #: n % 9: 0 no page, 1 no icon, 2 no name, 3 two names, 4 not fetched, 5 gone, 6 no image, 7 oblong, 8 square where k is odd, else not measured
    tables={"auxiliary": lambda rows: fetches(
        rows.where("n % 9 not in (0, 4)"), "icon", f"'{AT}/i.svg'", status="if(n % 9 = 5, 404, 200)", kind="if(n % 9 = 6, 'text/html', 'image/svg+xml')",
        body="case when n % 9 = 7 then '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"32\" height=\"16\"></svg>' when n % 9 = 8 and k % 2 = 0 then '<svg xmlns=\"http://www.w3.org/2000/svg\"></svg>' else '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"32\" height=\"32\"></svg>' end",
    )},
    pages=lambda rows: built_pages(several(rows.where("n % 9 <> 0"), 2), url=f"concat('{AT}/', i)", ordinal="i", html=(
        "concat('<html><head>', if(n % 9 = 1, '', '<link rel=\"icon\" href=\"/i.svg\">'), if(n % 9 = 2, '', concat('<meta property=\"og:site_name\" content=\"Tea', if(n % 9 = 3, string(i), ''), '\">')), '</head><body>x</body></html>')"
    )),
)
case(
    "ai-crawler-directive-verify",
    "CASE n % 8 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' WHEN 4 THEN 'warn' WHEN 5 THEN 'warn' ELSE 'pass' END",
    #: n % 8: 0 no policy, 1 an empty one, 2 robots.txt says otherwise, 3 turned away, 4 served in spite of it, 5 not asked
    site={"ai_policy": "case n % 8 when 0 then null when 1 then cast(map() as map<string,string>) else map('GPTBot', 'allow', 'ChatGPT-User', 'disallow', 'Google-Extended', 'disallow') end", "robots_txt": "concat('User-agent: ChatGPT-User\\nUser-agent: Google-Extended\\nDisallow: /\\n', if(n % 8 = 2, 'User-agent: GPTBot\\nDisallow: /\\n', ''))"},
    tables={"auxiliary": lambda rows: fetches(
        several(rows.where("n % 8 <> 5"), 2), "user-agent-test", f"'{AT}/'", agent="if(i = 0, 'GPTBot', 'ChatGPT-User')", status="case when i = 0 and n % 8 = 3 then 429 when i = 0 then 200 when n % 8 = 4 then 200 else 403 end"
    )},
)
case(
    "http-version",
    "CASE n % 9 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warn' WHEN 3 THEN 'pass' WHEN 4 THEN 'pass' WHEN 5 THEN 'error' WHEN 6 THEN 'error' ELSE 'warn' END",
    #: n % 9: 0 no page, 1 an error, 2 plain HTTP, 3 HTTP/2, 4 HTTP/3, 5 no handshake, 6 a failed one
    site={"protocol": "case n % 9 when 5 then null else named_struct('alpn', case n % 9 when 3 then 'h2' else 'http/1.1' end, 'tls_version', 'TLSv1.3', 'error', if(n % 9 = 6, 'reset', null)) end"},
    pages=lambda rows: built_pages(
        several(rows.where("n % 9 <> 0"), 2), url=f"concat('{AT}/', i)", ordinal="i", depth="i", error="if(n % 9 = 1 and i = 0, 'timeout', null)", final="if(n % 9 = 2 and i = 0, 'http://example.com/', null)",
        headers="if(n % 9 = 4 and i = 0, map('alt-svc', 'h2=\":443\", h3-29=\":443\"'), map('alt-svc', 'clear'))",
    ),
)
case(
    "domain-expiry-rdap",
    "CASE n % 10 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'not-applicable' ELSE 'error' END WHEN 1 THEN 'error' WHEN 2 THEN 'fail' WHEN 3 THEN 'error' WHEN 4 THEN 'error' WHEN 5 THEN 'fail' WHEN 6 THEN 'warn' ELSE 'pass' END",
    #: n % 10: 0 no lookup (of no domain where k is even), 1 a failed one, 2 being deleted, 3 no date, 4 none to read, 5 past, 6 within 30 days
    site={"rdap": (
        "if(n % 10 = 0, null, named_struct('domain', 'example.com', 'registrar', 'r', 'expires_at', case n % 10 when 3 then null when 4 then 'later' when 5 then '1999-12-31T00:00:00Z' when 6 then '2000-01-31T00:00:00Z' else '2000-02-01T00:00:00Z' end, 'fetched_at', timestamp '2000-01-01 00:00:00', "
        "'statuses', if(n % 10 = 2, array('active', 'Pending Delete'), array('active')), 'error', if(n % 10 = 1, 'refused', null)))"
    )},
    pages=lambda rows: built_pages(rows, final="if(n % 10 = 0 and k % 2 = 0, 'https://127.0.0.1:8443/', null)"),
)
case(
    "analytics-implementation", "CASE n % 7 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' ELSE 'pass' END",
    #: n % 7: 0 no page, 1 no tag, 2 one tag twice, 3 another id on one page, 4 no id on one page
    pages=lambda rows: built_pages(several(rows.where("n % 7 <> 0"), 2), url=f"concat('{AT}/', i)", ordinal="i", html=(
        "concat('<html><head>', if(n % 7 = 1 or (n % 7 = 4 and i = 1), '', concat('<script src=\"https://www.googletagmanager.com/gtag/js?id=G-ABCDEF', if(n % 7 = 3, string(i), ''), '\"></script>')), if(n % 7 = 2, '<script src=\"https://www.googletagmanager.com/gtag/js?id=G-ABCDEF\"></script>', ''), '</head><body>x</body></html>')"
    )),
)
case(
    "raw-rendered-crawl-diff", "CASE n % 7 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'error' WHEN 2 THEN 'fail' WHEN 3 THEN 'warn' ELSE 'pass' END",
    pages=lambda rows: built_pages(
        rows, html="'<html><body><a href=\"/a\">a</a></body></html>'", shown="concat('<html><body><a href=\"/a\">a</a>', if(n % 7 = 3, '<a href=\"/b\">b</a>', ''), '<a href=\"https://x.net/\">x</a></body></html>')", rendered="n % 7 <> 0",
        render_error="if(n % 7 = 1, 'crash', null)", render_final=f"if(n % 7 = 2, '{AT}/moved', null)",
    ),
)
_MB = 1_000_000
case(
    "crawler-fetch-limit",
    f"SELECT crawl_id, '{AT}/' AS page_url, CASE n % 9 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'fail' WHEN 3 THEN 'error' WHEN 4 THEN 'fail' WHEN 5 THEN 'warn' WHEN 6 THEN 'fail' ELSE 'pass' END AS outcome FROM {C}",
    #: n % 9: 0 an error, 1 an image, 2 too large, 3 cut at an unknown size, 4 cut at a known one, 5 near the limit, 6 a linked file too large, 7 a large PDF
    tables={"auxiliary": lambda rows: fetches(rows, "asset", f"'{AT}/s.css'", body="if(n % 9 = 6, repeat('x', 2097153), 'x')")},
    pages=lambda rows: built_pages(
        rows, status="if(n % 9 = 0, 503, 200)", kind="case n % 9 when 1 then 'image/png' when 7 then 'Application/PDF; x' else 'text/html' end", truncated="n % 9 in (3, 4)",
        size=f"bigint(case n % 9 when 2 then 2097153 when 3 then {_MB} when 4 then {_MB} when 5 then 1500000 when 7 then {40 * _MB} else 1499999 end)", headers="if(n % 9 = 4, map('content-length', '3000000'), map('content-length', 'x'))",
        html="'<html><head><link rel=\"stylesheet\" href=\"/s.css\"></head></html>'",
    ), by_page=True,
)

# ---- detectors that look at one page: all in one scan


def page_cases(name: str, expected: dict[str, str], pages: Callable[[DataFrame], DataFrame], url: str, site: dict[str, str]) -> None:
    """Registers a query of page detectors over one page per customer; ``expected``: the
    outcome of each detector, null where it says nothing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = customers(spark, sf_dir)
        audit = crawls(spark, rows, **{n: F.expr(e) for n, e in site.items()})
        audit.pages = written(pages(rows), "pages")
        return page_observations(audit, list(expected)).select("crawl_id", "probe_id", "page_url", "outcome")

    each = " UNION ALL ".join(f"SELECT crawl_id, '{probe}' AS probe_id, {sql} AS outcome FROM {C}" for probe, sql in expected.items())
    registered(name, f"SELECT crawl_id, probe_id, '{url}' AS page_url, outcome FROM ({each}) WHERE outcome IS NOT NULL", run)


_PDF = "k % 17 = 0"
_TAGGED = "n % 9 IN (1, 2, 3, 4)"
_MARKUP = {
    "heading-outline": "CASE WHEN n % 5 = 0 THEN 'fail' WHEN n % 5 = 1 THEN 'warn' ELSE 'pass' END",
    "soft-404": "CASE WHEN k % 13 = 0 THEN 'not-applicable' WHEN k % 7 = 0 AND k % 3 <> 0 THEN 'fail' ELSE 'pass' END",
    "answer-first-structure": "CASE WHEN k % 13 = 0 THEN 'not-applicable' WHEN k % 3 <> 0 THEN 'not-applicable' WHEN n % 5 IN (3, 4) THEN 'warn' ELSE 'pass' END",
    "launch-content-completeness": "CASE WHEN k % 13 = 0 THEN 'not-applicable' WHEN k % 11 = 0 THEN 'fail' WHEN k % 3 = 2 THEN 'warn' ELSE 'pass' END",
    "content-accessibility": "CASE WHEN k % 13 = 0 THEN 'not-applicable' WHEN n % 4 = 1 THEN 'fail' WHEN n % 4 = 2 OR k % 4 IN (1, 2) THEN 'warn' ELSE 'pass' END",
    "crawlable-links": "CASE WHEN n % 4 = 3 THEN 'fail' WHEN n % 4 = 0 AND k % 2 = 0 THEN 'not-applicable' ELSE 'pass' END",
    "image-dimensions": "CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN k % 5 = 0 THEN 'fail' ELSE 'pass' END",
    "lcp-not-lazy": "CASE WHEN k % 6 = 0 THEN 'not-applicable' WHEN k % 5 = 1 THEN 'warn' ELSE 'pass' END",
    "media-alternatives": "CASE k % 4 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END",
    "security-headers": "CASE WHEN n % 3 = 0 THEN 'pass' ELSE 'warn' END",
    "compression-cache": f"CASE WHEN {_PDF} THEN 'not-applicable' WHEN n % 2 = 0 AND k % 2 = 0 THEN 'pass' ELSE 'warn' END",
    "private-response-caching": "CASE WHEN k % 4 <> 0 THEN 'not-applicable' WHEN n % 5 IN (0, 1) THEN 'fail' ELSE 'pass' END",
    "x-robots-tag-non-html": f"CASE WHEN k % 13 = 0 THEN 'not-applicable' WHEN NOT {_PDF} OR bal < 0 THEN 'not-applicable' WHEN n % 2 = 0 THEN 'pass' ELSE 'warn' END",
    "indexability-matrix-reconciliation": f"CASE n % 6 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' WHEN 2 THEN 'pass' WHEN 3 THEN CASE WHEN {_TAGGED} THEN 'pass' ELSE 'not-applicable' END ELSE 'pass' END",
    "image-discoverability": "CASE n % 7 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' WHEN 3 THEN 'not-applicable' ELSE 'pass' END",
    "breadcrumblist-schema": "CASE WHEN k % 2 <> 0 THEN 'not-applicable' WHEN k % 10 = 0 THEN 'not-applicable' WHEN n % 8 = 0 THEN 'fail' WHEN n % 8 = 1 THEN 'pass' ELSE 'fail' END",
    "consent-mode-config": "CASE n % 9 WHEN 1 THEN 'warn' WHEN 2 THEN 'pass' WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' ELSE 'not-applicable' END",
}
_NOT_HTML = {"security-headers", "compression-cache", "private-response-caching", "x-robots-tag-non-html"}
_GTAG = "'<script src=\"https://www.googletagmanager.com/gtag/js?id=G-ABCDEF\"></script>'"
_CONSENT = "'<script>gtag(\"consent\", \"default\", {})</script>'"
_MARKED_PAGE = (
    "concat('<html lang=\"en\"><head><title>', if(k % 7 = 0, 'Page not found', 'Tea'), '</title>', "
    f"case n % 9 when 1 then {_GTAG} when 2 then concat({_CONSENT}, {_GTAG}) when 3 then concat({_GTAG}, {_CONSENT}) when 4 then concat({_GTAG}, '<script src=\"https://consent.cookiebot.com/uc.js\"></script>') else '' end, "
    "case n % 6 when 0 then '<link rel=\"stylesheet\" href=\"/private/a.css\">' when 1 then '<script src=\"/private/a.js\"></script>' when 2 then '<script src=\"https://cdn.other.net/x.js\"></script>' when 3 then '' else '<link rel=\"stylesheet\" href=\"/s.css\">' end, "
    "case n % 7 when 0 then '' when 1 then '<meta property=\"og:image\" content=\"https://img.other.net/i.png\">' when 2 then '<meta property=\"og:image\" content=\"/private/i.png\">' when 3 then '<meta property=\"og:image\" content=\"http://[bad\">' else '<meta name=\"twitter:image\" content=\"/i.png\">' end, "
    "case n % 8 when 0 then '<script type=\"application/ld+json\">{</script>' when 1 then '<script type=\"application/ld+json\">{\"@type\": \"BreadcrumbList\"}</script>' else '' end, '</head><body>', "
    "case n % 5 when 0 then '<h2>B</h2>' when 1 then '<h1>A</h1><h3>C</h3>' when 2 then '<h1>A</h1><h2>B</h2>' when 3 then '<h1>A</h1><h2>Why?</h2><h2>Next</h2>' else '<h1>A</h1>' end, '<p>', repeat('word ', case k % 3 when 0 then 700 when 1 then 60 else 5 end), if(k % 11 = 0, 'Lorem Ipsum', ''), '</p>', "
    "case n % 4 when 0 then if(k % 2 = 0, '', '<a href=\"/x\">Prices of tea</a>') when 1 then '<a href=\"/x\"></a>' when 2 then '<a href=\"/x\">Click here!</a>' else '<a href=\"javascript:void(0)\">Open</a>' end, "
    "if(k % 6 = 0, '', concat('<img src=\"/i.png\" alt=\"Tea\" height=\"1\"', if(k % 5 = 0, '', ' width=\"1\"'), if(k % 5 = 1, ' loading=\"Lazy\"', ''), '>')), "
    "case k % 4 when 0 then '' when 1 then '<video src=\"/v.mp4\" controls></video>' when 2 then '<video src=\"/v.mp4\" controls>Said here</video>' else '<video src=\"/v.mp4\" controls><track kind=\"captions\" src=\"/c.vtt\"></video>' end, '</body></html>')"
)
page_cases(
    "page_markup", {p: e if p in _NOT_HTML else f"CASE WHEN NOT {_PDF} THEN {e} END" for p, e in _MARKUP.items()},
    lambda rows: built_pages(
        rows, url=f"'{AT}/p'", html=f"if({_PDF}, null, {_MARKED_PAGE})", kind=f"if({_PDF}, 'application/pdf', 'text/html; charset=utf-8')", status="if(k % 13 = 0, 404, 200)", depth="if(k % 10 = 0, 0, 1)",
        headers=(
            "map_filter(map('strict-transport-security', if(n % 3 = 0, 'max-age=1', null), 'x-content-type-options', if(n % 3 = 0, 'NoSniff', 'x'), 'content-security-policy', if(n % 3 = 0 and k % 2 = 0, 'x', null), 'x-frame-options', if(n % 3 = 0 and k % 2 = 1, 'DENY', null), "
            "'referrer-policy', if(n % 3 <> 1, 'origin', null), 'content-encoding', if(n % 2 = 0, 'gzip', null), 'cache-control', case k % 4 when 0 then 'Public, max-age=60' when 2 then 'max-age=60' end, 'set-cookie', if(n % 5 = 0, 'a=b', null), 'vary', if(n % 5 = 1, 'accept, Cookie', 'accept'), "
            "'x-robots-tag', if(n % 2 = 0, 'all', null)), (name, value) -> value is not null)"
        ),
    ),
    f"{AT}/p", {"flags": "concat(if(k % 2 = 0, array('hierarchical'), array()), if(bal < 0, array(), array('non-html-files')))", "robots_txt": "'User-agent: *\\nDisallow: /private/'"},
)

_SHOWN = (
    "concat('<html lang=\"en\"><head><title>', if(n % 6 = 5, 'Other', 'Tea'), '</title><link rel=\"canonical\" href=\"{0}/p\">', if(n % 6 = 3, '{1}', ''), '</head><body><h1>H</h1>', if(n % 6 = 5, '', '<a href=\"/a\">A</a>'), if(n % 6 = 4, '<a href=\"/b\">B</a>', ''), '<p>', repeat('word ', 40), '</p>', "
    "if(k % 7 = 0, '<script type=\"application/ld+json\">{</script>', ''), if(n % 6 = 4, '<script type=\"application/ld+json\">{\"@type\": \"Product\"}</script>', ''), '</body></html>')"
).replace("{0}", AT).replace("{1}", NOINDEX)
_RAW = _SHOWN.replace("n % 6", "-1 * n % 6")  # none of the changes
_SKIPPED = "CASE n % 6 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'error' ELSE {} END"
page_cases(
    "page_renders",
    {
        "rendering-strategy-classifier": _SKIPPED.format("CASE n % 6 WHEN 3 THEN 'fail' WHEN 4 THEN 'warn' ELSE 'pass' END"),
        "raw-rendered-parity": _SKIPPED.format("CASE n % 6 WHEN 5 THEN 'fail' WHEN 4 THEN 'warn' ELSE 'pass' END"),
        "schema-validation-parity": _SKIPPED.format("CASE WHEN k % 7 = 0 THEN 'fail' WHEN n % 6 = 4 THEN 'warn' ELSE 'pass' END"),
        "axe-accessibility": "CASE WHEN n % 6 = 0 THEN 'not-applicable' ELSE CASE k % 5 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'error' WHEN 2 THEN 'fail' WHEN 3 THEN 'warn' ELSE 'pass' END END",
        "mobile-journey-qa": "CASE k % 6 WHEN 0 THEN 'not-applicable' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'fail' WHEN 4 THEN 'warn' ELSE 'pass' END",
        "lcp-not-lazy": "CASE WHEN n % 6 = 0 AND k % 6 = 0 THEN 'not-applicable' WHEN bal < 0 THEN 'fail' ELSE 'pass' END",
    },
    lambda rows: built_pages(
        rows, url=f"'{AT}/p'", html=_RAW, shown=f"if(n % 6 in (0, 1), null, {_SHOWN})", rendered="n % 6 <> 0", render_error="if(n % 6 = 1, 'crash', null)",
        paint="named_struct('element', 'img', 'src', '/i.png', 'loading', if(bal < 0, ' lazy', 'eager'))", mobile_rendered="k % 6 <> 0", mobile_error="if(k % 6 = 1, 'crash', null)",
        axe="case k % 5 when 0 then null else named_struct('error', if(k % 5 = 1, 'timeout', null), 'violations', case k % 5 when 2 then array(named_struct('id', 'a', 'impact', 'serious', 'nodes', 1)) when 3 then array(named_struct('id', 'a', 'impact', 'moderate', 'nodes', 1)) else array() end) end",
        mobile="if(k % 6 in (0, 1, 2), null, concat('<html lang=\"en\"><head>', if(k % 6 = 3, '', '<title>Tea</title>'), if(k % 6 = 4, '', '<meta name=\"viewport\" content=\"width=device-width\">'), '<link rel=\"canonical\" href=\"/p\"></head><body><h1>H</h1><a href=\"/a\">A</a><p>', repeat('word ', 40), '</p></body></html>'))",
    ),
    f"{AT}/p", {},
)
