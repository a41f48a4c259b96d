"""Queries over the driver's tables that exercise the engine's operators, and the
SQL (for DuckDB) that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import language as L
from lodestar.functions import robots as R
from lodestar.functions import scalars as S
from lodestar.functions import url as U
from lodestar.functions.extract import raw_pages
from lodestar.operators.audit import Audit
from lodestar.operators.page_detectors import page_observations
from lodestar.operators.record_detectors import best_rows, chained
from lodestar.operators.site_detectors import SITE
from lodestar.plans import compare, grading, readiness
from lodestar.sources import logs, store
from lodestar.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- pages: HTML by SQL functions, where no tree is needed

TITLE = "(?s)<title>(.*?)</title>"


@query("""
SELECT page_id, CASE WHEN title = '' THEN 'fail' WHEN count(*) OVER (PARTITION BY title) > 1 THEN 'fail' WHEN length(title) > 60 THEN 'warn' ELSE 'pass' END AS outcome
FROM (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages)
""")
def title_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", TITLE, 1)).alias("title"))
    # counts are combined before the shuffle and joined back: a title that a third of all pages share is no one task's
    shared = titles.groupBy("title").agg(F.count("*").alias("pages")).where("pages > 1")
    rows = titles.join(shared, "title", "left")
    outcome = F.expr("case when title = '' then 'fail' when pages > 1 then 'fail' when length(title) > 60 then 'warn' else 'pass' end")
    return rows.select("page_id", outcome.alias("outcome"))


@query("""
SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 30 THEN 'short' WHEN n <= 60 THEN 'fits' ELSE 'long' END AS band, count(*) AS pages, max(n)::BIGINT AS longest
FROM (SELECT length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS n FROM pages) GROUP BY 1
""")
def title_length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "pages").select(F.length(F.regexp_extract("html", TITLE, 1)).alias("n"))
    band = F.when(F.col("n") == 0, "none").when(F.col("n") <= 30, "short").when(F.col("n") <= 60, "fits").otherwise("long")
    return n.groupBy(band.alias("band")).agg(F.count("*").alias("pages"), F.max("n").cast("long").alias("longest"))


@query("""
SELECT count(*) FILTER (WHERE NOT regexp_matches(html, '<meta name="description"')) AS no_description, count(*) FILTER (WHERE NOT regexp_matches(html, '<meta name="viewport"')) AS no_viewport,
       count(*) FILTER (WHERE NOT regexp_matches(html, '<meta property="og:')) AS no_social, count(*) FILTER (WHERE NOT regexp_matches(html, '<link rel="canonical"')) AS no_canonical, count(*) AS pages FROM pages
""")
def meta_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lacks(pattern: str, name: str) -> F.Column:
        return F.count_if(~F.col("html").rlike(pattern)).alias(name)

    return read(spark, sf_dir, "pages").agg(
        lacks('<meta name="description"', "no_description"), lacks('<meta name="viewport"', "no_viewport"), lacks('<meta property="og:', "no_social"), lacks('<link rel="canonical"', "no_canonical"), F.count("*").alias("pages")
    )


@query("""SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS pages FROM pages GROUP BY 1""")
def lang_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang")).agg(F.count("*").alias("pages"))


_LEVELS = """list_transform(regexp_extract_all(html, '<h([1-6])[ >]', 1), lambda x: x::INT)"""


@query(f"""
SELECT CASE WHEN NOT list_contains(l, 1) THEN 'fail' WHEN len(list_filter(range(2, len(l) + 1), lambda i: l[i] > l[i - 1] + 1)) > 0 THEN 'warn' ELSE 'pass' END AS outcome, count(*) AS pages
FROM (SELECT {_LEVELS} AS l FROM pages) GROUP BY 1
""")
def heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = read(spark, sf_dir, "pages").select(F.expr("transform(regexp_extract_all(html, '<h([1-6])[ >]', 1), x -> int(x))").alias("l"))
    skips = F.expr("exists(zip_with(slice(l, 2, size(l)), slice(l, 1, greatest(size(l) - 1, 0)), (b, a) -> b > a + 1), s -> s)")
    outcome = F.when(~F.array_contains("l", 1), "fail").when(skips, "warn").otherwise("pass")
    return levels.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("pages"))


# ---- URLs

@query(r"""
WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(u, '([?&])utm_source=[^&]*&?', '\1'), '[?&]$', '') AS u FROM a)
SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/]+$') THEN u || '/' ELSE u END AS normalized FROM b
""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.normalized(F.col("url")).alias("normalized"))


@query(r"""
SELECT k AS "key", count(*) AS urls, bool_or(regexp_matches(k, '^(utm_.*|gclid|gbraid|wbraid|dclid|fbclid|msclkid|ttclid|mc_cid|mc_eid|igshid|ref_src)$')) AS tracking
FROM (SELECT unnest(regexp_extract_all(regexp_replace(url, '#.*$', ''), '[?&]([^=&]+)=', 1)) AS k FROM pages) GROUP BY 1
""")
def tracking_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "pages").select(F.explode(U.query_pairs(F.col("url"))).alias("p"))
    tracking = F.col("p.key").isin(*U.TRACKING_KEYS) | F.col("p.key").rlike("^utm_")
    return pairs.groupBy(F.col("p.key").alias("key")).agg(F.count("*").alias("urls"), F.bool_or(tracking).alias("tracking"))


_PATH = r"regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query(f"""
SELECT count(*) FILTER (WHERE regexp_matches({_PATH}, '[A-Z]')) AS upper, count(*) FILTER (WHERE contains({_PATH}, '_')) AS underscored,
       count(*) FILTER (WHERE len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) > 1) AS deep, count(*) AS pages FROM pages
""")
def url_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = U.path(F.col("url"))
    return read(spark, sf_dir, "pages").agg(
        F.count_if(path.rlike("[A-Z]")).alias("upper"), F.count_if(path.contains("_")).alias("underscored"), F.count_if(F.size(U.segments(F.col("url"))) > 1).alias("deep"), F.count("*").alias("pages")
    )


@query(f"""
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) FILTER (WHERE d AND p LIKE '%/') AS with_slash, count(*) FILTER (WHERE d AND p NOT LIKE '%/') AS without_slash
FROM (SELECT url, {_PATH} AS p, {_PATH} NOT IN ('', '/') AND NOT regexp_matches({_PATH}, '\\.[a-z0-9]{{2,5}}$') AS d FROM pages) GROUP BY 1
""")
def host_slash_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("p"))
    directory = ~F.col("p").isin("", "/") & ~F.col("p").rlike(r"\.[a-z0-9]{2,5}$")
    return rows.groupBy("host").agg(F.count_if(directory & F.col("p").endswith("/")).alias("with_slash"), F.count_if(directory & ~F.col("p").endswith("/")).alias("without_slash"))


@query(f"""
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) || array_to_string(list_transform(string_split({_PATH}, '/'),
         lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|[0-9a-fA-F]{{8,}})$') THEN ':id' WHEN regexp_matches(s, '[-_]') THEN ':slug' WHEN regexp_matches(s, '[0-9]') THEN ':id' ELSE s END), '/') AS template,
       count(*) AS pages FROM pages GROUP BY 1
""")
def url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.regexp_replace(U.path_template(F.col("url")), "^https?://", "")
    return read(spark, sf_dir, "pages").groupBy(whole.alias("template")).agg(F.count("*").alias("pages"))


@query(f"SELECT len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) AS depth, count(*) AS pages FROM pages GROUP BY 1")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(F.size(U.segments(F.col("url"))).cast("long").alias("depth")).agg(F.count("*").alias("pages"))


@query(r"""
SELECT host, pages, dense_rank() OVER (ORDER BY pages DESC) AS rank FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1)
""")
def host_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))
    ranks = counts.select("pages").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("pages"))))
    return counts.join(ranks, "pages").select("host", "pages", F.col("rank").cast("long").alias("rank"))


@query(r"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '^(https?)://', 1) AS s, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS apex, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
v AS (SELECT host, s, x.s2 AS s2, x.h2 AS h2 FROM h, LATERAL (SELECT unnest([{'s2': 'http', 'h2': apex}, {'s2': 'http', 'h2': 'www.' || apex}, {'s2': 'https', 'h2': apex}, {'s2': 'https', 'h2': 'www.' || apex}]) AS x))
SELECT s || '://' || host AS crawl_id, s2 || '://' || h2 || '/' AS url FROM v WHERE s2 <> s OR h2 <> host
""")
def host_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("origin")).distinct().withColumn("crawl_id", F.col("origin"))
    return store.host_variants(origins)


# ---- links

_HREFS = """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", U.host(F.col("url")).alias("host"), F.explode(F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)")).alias("href"))


@query(f"SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM ({_HREFS}) GROUP BY 1")
def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query(f"SELECT host, href, count(*) AS links, count(DISTINCT page_id) AS sources FROM ({_HREFS}) GROUP BY 1, 2")
def inbound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("host", "href").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("sources"))


@query(f"""
SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, {_PATH} AS href FROM pages) p
WHERE NOT EXISTS (SELECT 1 FROM ({_HREFS}) l WHERE l.host = p.host AND l.href = p.href)
""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("href"))
    return pages.join(_links(spark, sf_dir).select("host", "href").distinct(), ["host", "href"], "left_anti").select("page_id")


@query(f"SELECT page_id, count(DISTINCT href) AS targets FROM ({_HREFS}) GROUP BY 1 ORDER BY targets DESC, page_id LIMIT 25")
def out_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("page_id").agg(F.countDistinct("href").alias("targets")).orderBy(F.desc("targets"), "page_id").limit(25)


@query(f"""
SELECT l.host, l.href, count(*) AS links, p.page_id AS to_page_id FROM ({_HREFS}) l
LEFT JOIN (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, {_PATH} AS href, min(page_id) AS page_id FROM pages GROUP BY 1, 2) p ON l.host = p.host AND l.href = p.href GROUP BY 1, 2, 4
""")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("crawl_id"), U.path(F.col("url")).alias("normalized_url")).agg(F.min("page_id").alias("page_id"))
    links = _links(spark, sf_dir).select(F.col("host").alias("crawl_id"), F.col("href").alias("target"))
    return compare.resolved_links(links, pages).groupBy(F.col("crawl_id").alias("host"), F.col("target").alias("href"), "to_page_id").agg(F.count("*").alias("links"))


@query(f"""
SELECT crawl_id, host, target, rn AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY r, host) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_id, host ORDER BY target) AS r FROM (
      SELECT DISTINCT regexp_extract(url, '^https?://([a-z]+)', 1) AS crawl_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, {_PATH} AS target FROM pages)) WHERE r <= 3) WHERE rn <= 30
""")
def external_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([a-z]+)", 1).alias("crawl_id"), U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("target"))
    return store.sampled_external(links).withColumn("turn", F.col("turn").cast("long"))


# ---- detectors over extracted pages


def _audit(spark: SparkSession, sf_dir: str) -> Audit:
    rows = read(spark, sf_dir, "pages")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # parsing costs far more than dealing pages out
        rows = rows.repartition(cores)
    pages = written(raw_pages(rows), "pages")
    sites = spark.createDataFrame(
        [("crawl", "https://tionsh.example.net", ["hierarchical", "bulk-publishing"], "User-agent: *\nDisallow: /en/\nAllow: /en/1\n")], "crawl_id string, origin string, flags array<string>, robots_txt string"
    )
    none = {"crawled_at": "timestamp", "robots_status": "int", "robots_error": "string", "production_origin": "string", "settings": "string", "release_id": "string"}
    structs = {
        "protocol": "struct<alpn:string,tls_version:string,error:string>", "rdap": "struct<domain:string,registrar:string,expires_at:string,fetched_at:timestamp,statuses:array<string>,error:string>",
        "ai_policy": "map<string,string>",
    }
    return Audit(spark, sites.select("*", *[F.lit(None).cast(t).alias(n) for n, t in {**none, **structs}.items()]), pages)


@query("""
WITH p AS (SELECT url, html FROM pages), n AS (SELECT count(*) AS n FROM p)
SELECT 'http-status' AS probe_id, 'pass' AS outcome, n FROM n
UNION ALL SELECT 'redirect-chain', 'pass', n FROM n
UNION ALL SELECT 'https-enforcement', CASE WHEN url LIKE 'https:%' THEN 'pass' ELSE 'fail' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'mixed-content', CASE WHEN url LIKE 'https:%' THEN 'pass' ELSE 'not-applicable' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'canonicalization', CASE WHEN contains(html, 'rel="canonical"') THEN 'pass' ELSE 'warn' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'meta-description', CASE WHEN contains(html, 'name="description"') THEN 'pass' ELSE 'fail' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'social-metadata', CASE WHEN contains(html, 'property="og:') THEN 'warn' ELSE 'fail' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'responsive-media', CASE WHEN contains(html, 'name="viewport"') THEN 'pass' ELSE 'fail' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'image-alt-quality', CASE WHEN contains(html, '<img') THEN 'fail' ELSE 'not-applicable' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'lang-attribute', CASE WHEN regexp_matches(html, '<html lang="[a-z]{2}"') THEN 'pass' ELSE 'fail' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'primary-heading', CASE WHEN len(regexp_extract_all(html, '<h1[ >]')) = 0 THEN 'fail' WHEN len(regexp_extract_all(html, '<h1[ >]')) > 1 THEN 'warn' ELSE 'pass' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'semantic-html', CASE WHEN contains(html, '<main') THEN 'pass' ELSE 'warn' END, count(*) FROM p GROUP BY 2
""")
def page_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        "http-status redirect-chain https-enforcement mixed-content canonicalization meta-description social-metadata responsive-media image-alt-quality lang-attribute primary-heading semantic-html"
    ).split()
    return page_observations(_audit(spark, sf_dir), names).groupBy("probe_id", "outcome").agg(F.count("*").alias("n"))


@query()
def page_detectors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_observations(_audit(spark, sf_dir)).groupBy("probe_id", "outcome").agg(F.count("*").alias("n"))


def _site_query(name: str, probe: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return SITE[probe](_audit(spark, sf_dir)).groupBy("probe_id", "outcome").agg(F.count("*").alias("n"))

    run.__name__ = name
    query(sql)(run)


_T = "trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"
_ONE = "SELECT '{}' AS probe_id, {} AS outcome, 1 AS n"
_site_query("detect_title_uniqueness", "title-uniqueness", f"""
SELECT 'title-uniqueness' AS probe_id, CASE WHEN t = '' THEN 'fail' WHEN count(*) OVER (PARTITION BY t) > 1 THEN 'fail' WHEN length(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) > 60 THEN 'warn' ELSE 'pass' END AS outcome
FROM (SELECT {_T} AS t FROM pages)""".join(["SELECT probe_id, outcome, count(*) AS n FROM (", ") GROUP BY 1, 2"]))  # fmt: skip
_site_query("detect_host_slash_policy", "host-slash-policy", _ONE.format("host-slash-policy", "CASE WHEN count(DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1)) > 1 THEN 'fail' ELSE 'pass' END") + " FROM pages")
_site_query("detect_url_convention", "url-convention", _ONE.format("url-convention", f"CASE WHEN count(*) FILTER (WHERE regexp_matches({_PATH}, '[A-Z_]')) > 0 THEN 'warn' ELSE 'pass' END") + " FROM pages")
_site_query("detect_click_depth", "click-depth", _ONE.format("click-depth", "CASE WHEN count(*) = 0 THEN 'not-applicable' ELSE 'pass' END") + " FROM pages")
_site_query("detect_cannibalization", "cannibalization", f"""
SELECT 'cannibalization' AS probe_id, CASE WHEN max(n) > 1 THEN 'fail' ELSE 'pass' END AS outcome, 1 AS n FROM (SELECT count(*) AS n FROM (SELECT lower({_T}) AS t FROM pages) GROUP BY t)""")
_site_query("detect_third_party_budget", "third-party-budget", _ONE.format("third-party-budget", "CASE WHEN count(*) FILTER (WHERE regexp_matches(html, '<script[^>]* src=')) = 0 THEN 'pass' ELSE 'warn' END") + " FROM pages")
_site_query("detect_metadata_completeness", "metadata-completeness", _ONE.format("metadata-completeness", f"CASE WHEN count(*) FILTER (WHERE {_T} = '') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE NOT contains(html, 'rel=\"canonical\"')) > 0 THEN 'warn' ELSE 'pass' END") + " FROM pages")
_OWN = f"""WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS u FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
 WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) = 'tionsh.example.net'), p AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=[^&]*$', '') AS u FROM pages)"""
_site_query("detect_orphan_pages", "orphan-pages", _OWN + " SELECT 'orphan-pages' AS probe_id, CASE WHEN count(*) FILTER (WHERE u NOT IN (SELECT u FROM l)) = 0 THEN 'pass' ELSE 'fail' END AS outcome, 1 AS n FROM p")
_site_query("detect_internal_linking", "internal-linking", _OWN + """
 SELECT 'internal-linking' AS probe_id, CASE WHEN count(*) < 2 THEN 'not-applicable' WHEN min(n) < 2 THEN 'warn' ELSE 'pass' END AS outcome, 1 AS n FROM (SELECT p.page_id, count(l.u) AS n FROM p LEFT JOIN l ON l.u = p.u AND l.page_id <> p.page_id GROUP BY 1)""")
_site_query("detect_broken_links", "broken-links", """
WITH l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS u FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages))
SELECT 'broken-links' AS probe_id, CASE WHEN count(*) = 0 THEN 'not-applicable' WHEN count(*) FILTER (WHERE u NOT IN (SELECT url FROM pages)) > 0 THEN 'warn' ELSE 'pass' END AS outcome, 1 AS n FROM l""")
_site_query("detect_parameter_crawl_space", "parameter-crawl-space", """
WITH q AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=[^&]*$', '') AS u FROM pages), s AS (SELECT regexp_extract(u, '^([^?]*)', 1) AS r, list_sort(string_split(regexp_extract(u, '[?](.*)$', 1), '&')) AS k, count(*) AS n FROM q WHERE contains(u, '?') GROUP BY 1, 2)
SELECT 'parameter-crawl-space' AS probe_id, CASE WHEN count(*) = 0 THEN 'not-applicable' WHEN max(n) > 1 THEN 'fail' ELSE 'pass' END AS outcome, 1 AS n FROM s""")
_site_query("detect_faceted_nav_control", "faceted-nav-control", _ONE.format("faceted-nav-control", "CASE WHEN count(*) FILTER (WHERE regexp_matches(url, '[?&]ref=') AND NOT contains(html, 'rel=\"canonical\"')) > 0 THEN 'fail' ELSE 'not-applicable' END") + " FROM pages")
_site_query("detect_batch_page_quality", "batch-page-quality", _ONE.format("batch-page-quality", "CASE WHEN count(*) FILTER (WHERE len(regexp_extract_all(html, '<h[1-6][ >]')) >= 2) >= 3 THEN 'fail' ELSE 'pass' END") + " FROM pages")
_site_query("detect_breadcrumb_navigation", "breadcrumb-navigation", "SELECT 'breadcrumb-navigation' AS probe_id, CASE WHEN regexp_matches(html, '(?i)class=\"[^\"]*breadcrumb') THEN 'warn' ELSE 'fail' END AS outcome, count(*) AS n FROM pages GROUP BY 2")
_site_query("detect_trust_pages_presence", "trust-pages-presence", _ONE.format("trust-pages-presence", "CASE WHEN count(*) = 0 THEN 'not-applicable' ELSE 'warn' END") + " FROM pages")
_site_query("detect_robots_txt", "robots-txt", "SELECT 'robots-txt' AS probe_id, 'pass' AS outcome, 1 AS n")


# ---- texts


@query("""
SELECT count(*) FILTER (WHERE regexp_matches(text, '(?i)lorem ipsum|coming soon|\\[insert')) AS filler, count(*) FILTER (WHERE regexp_matches(text, '\\b(TODO|TBD|XXX)\\b')) AS markers,
       count(*) FILTER (WHERE regexp_matches(text, '(?i)sponsored|advertisement|advertorial|promoted by')) AS disclosed, count(*) FILTER (WHERE n_chars < 300) AS thin, count(*) AS documents FROM documents
""")
def placeholder_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").agg(
        F.count_if(text.rlike(r"(?i)lorem ipsum|coming soon|\[insert")).alias("filler"), F.count_if(text.rlike(r"\b(TODO|TBD|XXX)\b")).alias("markers"),
        F.count_if(text.rlike("(?i)sponsored|advertisement|advertorial|promoted by")).alias("disclosed"), F.count_if(F.col("n_chars") < 300).alias("thin"), F.count("*").alias("documents"),
    )


@query("SELECT md5(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def doc_exact_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # grouped by a digest, so that texts are not shuffled
    rows = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, sum(n) AS total, max(n) AS top FROM c GROUP BY 1)
SELECT t.source, min(c.lang) AS lang, max(t.top)::BIGINT AS n, max(t.top) / max(t.total)::DOUBLE AS share, max(t.top) / max(t.total)::DOUBLE >= 0.8 AS stamped FROM t JOIN c ON c.source = t.source AND c.n = t.top GROUP BY 1
""")
def doc_stamp_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = counts.groupBy("source").agg(F.sum("n").alias("total"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"), F.max("n").alias("n"))
    share = F.col("n") / F.col("total").cast("double")
    return best.select("source", "lang", "n", share.alias("share"), (share >= 0.8).alias("stamped"))


@query("SELECT lang, quantile_cont(n_chars, 0.5) AS median, floor(quantile_cont(n_chars, 0.5) + 0.5)::BIGINT AS rounded FROM documents GROUP BY 1")
def median_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = F.percentile("n_chars", 0.5)
    return read(spark, sf_dir, "documents").groupBy("lang").agg(median.alias("median"), F.floor(median + 0.5).alias("rounded"))


#: tags, and how each should read
_TAGS = {"en": "", "en-GB": "", "en_us": "invalid", "de-AT": "", "xx": "invalid", "iw": "invalid", "fr-FR-x": "invalid", "es-419": "unsupported", "zh-Hant-TW": "", "pt-ZZ": "invalid", "EN": ""}


@query(f"""
SELECT d.doc_id % 11 AS slot, v.told, count(*) AS n FROM documents d JOIN (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_TAGS.values()))}) v(i, told) ON v.i = d.doc_id % 11 GROUP BY 1, 2
""")
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*[F.lit(t) for t in _TAGS])
    slot = F.col("doc_id") % 11
    rows = read(spark, sf_dir, "documents").select(slot.alias("slot"), F.element_at(tags, (slot + 1).cast("int")).alias("tag"))
    told = F.split(L.tag_problem(F.col("tag"), L.codes(spark)), ":")[0]
    return rows.groupBy("slot", told.alias("told")).agg(F.count("*").alias("n"))


# ---- robots and patterns

_ROBOTS = "User-agent: googlebot\nDisallow: /en/\nAllow: /en/1*\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /de/\n"


@query(rf"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1), '\?utm_source=[^&]*$', '') AS path, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS full_path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(full_path, '\.html$') THEN CASE WHEN regexp_matches(full_path, '^/en/1') THEN FALSE ELSE FALSE END
                     WHEN starts_with(full_path, '/en/1') THEN TRUE WHEN starts_with(full_path, '/en/') THEN FALSE ELSE TRUE END AS google,
       NOT starts_with(full_path, '/de/') AS others FROM p
""")
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.array("url").alias("urls"), F.lit(_ROBOTS).alias("robots"))
    return rows.select("page_id", F.element_at(R.allowed_each(F.col("robots"), "Googlebot", F.col("urls")), 1).alias("google"), F.element_at(R.allowed_each(F.col("robots"), "OtherBot", F.col("urls")), 1).alias("others"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/]+/en/1[^/?#]*/?$') THEN '/en/1*' WHEN regexp_matches(u, '^https?://[^/]+/en/.*$') THEN '/en/**' WHEN regexp_matches(u, '^https?://[^/]+/[^/?#]*/[^/?#]*/?$') THEN '/*/*' ELSE NULL END AS pattern
FROM (SELECT page_id, url AS u FROM pages)
""")
def best_match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("crawl_id"))
    return _best_patterns(spark, pages, "/en/1*", "/en/**", "/*/*")


def _best_patterns(spark: SparkSession, pages: DataFrame, *patterns: str) -> DataFrame:
    listed = spark.createDataFrame(list(enumerate(patterns)), "at int, pattern string")
    rows = pages.select("crawl_id").distinct().join(listed, F.lit(True)).withColumn("m", U.matchers(F.col("pattern"), F.col("crawl_id"))).select("crawl_id", "at", F.struct("pattern").alias("row"), "m")
    return best_rows(pages, rows).select("page_id", F.col("row.pattern").alias("pattern"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/]+/en/[^/?#]*1/?$') THEN '/en/*1' WHEN regexp_matches(u, '^https?://[^/]+/en/1[^/?#]*/?$') THEN '/en/1*' WHEN regexp_matches(u, '^https?://[^/]+/en/.*$') THEN '/en/**' ELSE NULL END AS pattern
FROM (SELECT page_id, url AS u FROM pages)
""")
def best_match_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two patterns are equally specific: the first of them counts."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("crawl_id"))
    return _best_patterns(spark, pages, "/en/*1", "/en/1*", "/en/**")


# ---- events as logs and reports


@query("""
SELECT strftime(date_trunc('month', ts), '%Y-%m') AS period, count(*) AS hits, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE > 0.01 AS over_limit FROM events GROUP BY 1
""")
def log_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.count_if(F.col("event_type") == "error")
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("hits"), errors.alias("errors"), (errors / F.count("*") > 0.01).alias("over_limit"))


@query("SELECT event_type, count(*) AS hits, count(*) FILTER (WHERE (props->>'k')::INT >= 50) AS with_params, count(*) FILTER (WHERE (props->>'k')::INT >= 50) / count(*)::DOUBLE AS share FROM events GROUP BY 1")
def log_param_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.count_if(F.get_json_object("props", "$.k").cast("int") >= 50)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("hits"), high.alias("with_params"), (high / F.count("*")).alias("share"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS sent FROM events GROUP BY 1, 2 HAVING count(*) > 5")
def daily_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count("*").alias("sent")).where("sent > 5")


@query("""
WITH c AS (SELECT user_id, sum(value) FILTER (WHERE ts < m) AS before, sum(value) FILTER (WHERE ts >= m) AS after FROM events, (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS m FROM events) GROUP BY 1)
SELECT user_id FROM c WHERE before >= 100 AND coalesce(after, 0) < before * 0.7 AND user_id % 10 <> 0
""")
def period_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long")).alias("m"))
    sums = events.join(F.broadcast(middle), F.lit(True)).groupBy("user_id").agg(F.sum(F.expr("if(ts < m, value, 0)")).alias("before"), F.sum(F.expr("if(ts >= m, value, 0)")).alias("after"))
    decided = events.where("user_id % 10 = 0").select("user_id").distinct()
    return sums.where("before >= 100 and after < before * 0.7").join(decided, "user_id", "left_anti").select("user_id")


@query("""
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, event_type, n, (n - p) / p::DOUBLE AS moved FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS p FROM d) WHERE abs((n - p) / p::DOUBLE) >= 0.5
""")
def threshold_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    moved = (F.col("n") - F.col("p")) / F.col("p").cast("double")
    return days.withColumn("p", F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).withColumn("moved", moved).where("abs(moved) >= 0.5").select("day", "event_type", "n", "moved")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.streaming.audits import daily_counts, run_to_end

    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    counted = run_to_end(daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))), f"daily_{abs(hash(sf_dir)) % 10**9}_{id(stream)}")
    return counted.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS hits, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_id % 3 = 0) AS parameterised FROM events GROUP BY 1
""")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made of events, parsed again."""
    line = F.concat(
        F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /p/'), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "?x=1").otherwise(""), F.lit(' HTTP/1.1" '),
        F.when(F.col("event_type") == "error", "503").otherwise("200"), F.lit(' 17 "-" "Mozilla/5.0 (compatible; Googlebot/2.1)"'),
    )
    parsed = logs.read_lines(read(spark, sf_dir, "events").select(line.alias("value")))
    return logs.crawler_rates(logs.hits(parsed)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ---- orders and line items as figures, feeds and verdicts


@query("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN gap > 0.1 THEN 'unexplained' WHEN gap > 0.05 THEN 'drifting' ELSE 'agrees' END AS verdict, count(*) AS orders
FROM (SELECT coalesce(abs(o_totalprice - b) / nullif(greatest(o_totalprice, b), 0), 0) AS gap FROM orders JOIN l ON l_orderkey = o_orderkey) GROUP BY 1
""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 + l_tax) * (1 - l_discount)")).alias("b"))
    met = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    gap = S.figure_gap(F.col("o_totalprice"), F.col("b"))
    return met.groupBy(F.when(gap > 0.1, "unexplained").when(gap > 0.05, "drifting").otherwise("agrees").alias("verdict")).agg(F.count("*").alias("orders"))


@query("""
SELECT p_partkey, bool_or(abs(l_extendedprice / l_quantity - p_retailprice) < 0.005) AS agrees, count(l_partkey) AS offers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1
""")
def feed_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    met = read(spark, sf_dir, "part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left")
    return met.groupBy("p_partkey").agg(F.bool_or(F.abs(F.col("price") - F.col("p_retailprice")) < 0.005).alias("agrees"), F.count("l_partkey").alias("offers"))


@query("""
SELECT o_custkey, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'current' END AS state, min(o_orderkey) AS latest
FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1
""")
def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    ties = orders.join(newest, ["o_custkey", "o_orderdate"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("latest"))
    return ties.select("o_custkey", F.when(F.col("n") > 1, "ambiguous").otherwise("current").alias("state"), "latest")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: an order is a crawl, a line number a detector."""
    outcome = F.expr("case when l_discount >= 0.095 then 'error' when l_returnflag = 'R' and l_linestatus = 'F' then 'fail' when l_returnflag = 'A' and l_tax >= 0.06 then 'warn' when l_quantity > 48 then 'not-applicable' else 'pass' end")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("crawl_id"), F.concat(F.lit("d"), "l_linenumber").alias("probe_id"), outcome.alias("outcome"))


_OBS = """SELECT l_orderkey::VARCHAR AS crawl_id, 'd' || l_linenumber AS probe_id, CASE WHEN l_discount >= 0.095 THEN 'error' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'fail'
 WHEN l_returnflag = 'A' AND l_tax >= 0.06 THEN 'warn' WHEN l_quantity > 48 THEN 'not-applicable' ELSE 'pass' END AS outcome FROM lineitem"""
_CHECKS = (
    ("1.1", 1, True, "automated", True, "", "d1,d2"), ("1.2", 1, True, "assisted", True, "", "d1"), ("2.1", 2, False, "attested", True, "", "d2"), ("2.2", 2, True, "automated", False, "shop", "d1"),
    ("3.1", 3, True, "automated", True, "", "d1,none"), ("3.2", 3, False, "automated", True, "", "d2"),
)


def _catalogue(spark: SparkSession) -> DataFrame:
    rows = [("v", i, i, p, g, a, u, f.split(",") if f else [], d.split(","), "P0") for i, p, g, a, u, f, d in _CHECKS]
    from lodestar.schemas import CHECKS

    return spark.createDataFrame(rows, CHECKS)


_MODES = ["d1", "d2", "d3"]
_SITES = "SELECT DISTINCT l_orderkey::VARCHAR AS crawl_id, CASE l_orderkey % 3 WHEN 0 THEN ['shop'] WHEN 1 THEN ['blog'] ELSE []::VARCHAR[] END AS flags FROM lineitem"
_GRADED = f"""
WITH obs AS ({_OBS}), sites AS ({_SITES}),
checks(id, phase, gate, automation, universal, flag, detectors) AS (VALUES {', '.join(f"('{i}', {p}, {g}, '{a}', {u}, '{f}', string_split('{d}', ','))" for i, p, g, a, u, f, d in _CHECKS)}),
scoped AS (SELECT crawl_id, checks.*, CASE WHEN universal OR list_contains(flags, flag) THEN 'yes' WHEN len(flags) = 0 THEN 'review' ELSE 'no' END AS scope FROM sites, checks),
t AS (SELECT crawl_id, probe_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'pass') AS p, count(*) FILTER (WHERE outcome = 'warn') AS w, count(*) FILTER (WHERE outcome = 'fail') AS f, count(*) FILTER (WHERE outcome = 'error') AS e FROM obs GROUP BY 1, 2),
m AS (SELECT s.crawl_id, s.id, any_value(phase) AS phase, any_value(gate) AS gate, any_value(automation) AS automation, any_value(scope) AS scope,
        count(*) FILTER (WHERE d NOT IN ({', '.join(repr(x) for x in _MODES)})) AS missing, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS silent,
        coalesce(sum(p), 0) AS p, coalesce(sum(w), 0) AS w, coalesce(sum(f), 0) AS f, coalesce(sum(e), 0) AS e
      FROM (SELECT *, unnest(detectors) AS d FROM scoped) s LEFT JOIN t ON t.crawl_id = s.crawl_id AND t.probe_id = s.d GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN scope = 'no' THEN 'out-of-scope' WHEN scope = 'review' THEN 'scope-undecided' WHEN automation = 'attested' THEN 'attested-only' WHEN missing > 0 THEN 'detectors-missing' WHEN silent > 0 THEN 'no-observation'
        WHEN e > 0 THEN 'probe-error' WHEN f > 0 THEN 'verified-fail' WHEN w > 0 THEN 'held-by-warning' WHEN automation = 'assisted' THEN 'awaiting-confirmation' WHEN p = 0 THEN 'nothing-to-verify' ELSE 'verified-pass' END AS basis FROM m),
st AS (SELECT *, CASE WHEN basis = 'verified-fail' THEN 'failed' WHEN basis IN ('held-by-warning', 'awaiting-confirmation') THEN 'in-progress' WHEN basis IN ('nothing-to-verify', 'verified-pass') THEN 'passed' ELSE 'not-started' END AS status FROM g)
"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("shop"))).when(F.col("l_orderkey") % 3 == 1, F.array(F.lit("blog"))).otherwise(F.array().cast("array<string>"))
    sites = read(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(F.col("l_orderkey").cast("string").alias("crawl_id"), flags.alias("flags"))
    return grading.grade(_catalogue(spark), sites, _outcomes(spark, sf_dir), _MODES)


@query(_GRADED + "SELECT crawl_id, id AS check_id, scope AS applicability, status, basis, p::BIGINT AS passes, w::BIGINT AS warns, f::BIGINT AS fails, e::BIGINT AS errors FROM st")
def grade_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("crawl_id", "check_id", "applicability", "status", "basis", "passes", "warns", "fails", "errors")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("crawl_id", "check_id", "applicability", "applicability_rationale", "status", "coverage", F.lit(None).cast("timestamp").alias("attestation_expires_at"))


def _at(rows: DataFrame) -> DataFrame:
    return rows.select("crawl_id").distinct().withColumn("assessed_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query(_GRADED + """
SELECT crawl_id, count(*) FILTER (WHERE gate AND scope = 'yes' AND status <> 'passed') AS gates_outstanding, count(*) FILTER (WHERE gate AND scope = 'yes' AND status = 'failed') AS gates_failed,
       count(*) FILTER (WHERE gate AND scope = 'review') AS decisions_outstanding,
       CASE WHEN count(*) FILTER (WHERE gate AND (scope = 'review' OR scope = 'yes' AND status <> 'passed')) = 0 THEN 'GO' ELSE 'HOLD' END AS decision FROM st GROUP BY 1
""")
def launch_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = written(_states(spark, sf_dir), "states")
    return readiness.launch_readiness(_catalogue(spark), states, _at(states)).select("crawl_id", "gates_outstanding", "gates_failed", "decisions_outstanding", "decision")


_PROGRESS = """SELECT crawl_id, phase, count(*) FILTER (WHERE scope = 'yes') AS active, count(*) FILTER (WHERE scope = 'yes' AND status = 'passed') AS passed, count(*) FILTER (WHERE scope = 'yes' AND status = 'failed') AS failed,
 count(*) FILTER (WHERE scope = 'review') AS scope_review, CASE WHEN count(*) FILTER (WHERE scope = 'yes') = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE scope = 'yes' AND status = 'passed') / count(*) FILTER (WHERE scope = 'yes')::DOUBLE * 100 + 0.5) END::INT AS percent FROM st GROUP BY 1, 2"""


@query(_GRADED + _PROGRESS)
def phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = written(_states(spark, sf_dir), "states")
    return readiness.progress(_catalogue(spark), states, _at(states)).select("crawl_id", "phase", "active", "passed", "failed", "scope_review", "percent")


@query(_GRADED + f"SELECT crawl_id, CASE WHEN sum(active) = 0 THEN 0 ELSE floor(sum(percent * active) / sum(active)::DOUBLE + 0.5) END::INT AS percent FROM ({_PROGRESS}) GROUP BY 1")
def overall_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = written(_states(spark, sf_dir), "states")
    return readiness.overall_percent(readiness.progress(_catalogue(spark), states, _at(states)))


@query(f"SELECT probe_id, count(*) AS fails, count(DISTINCT crawl_id) AS crawls FROM ({_OBS}) WHERE outcome = 'fail' GROUP BY 1 ORDER BY fails DESC, probe_id LIMIT 8")
def failure_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.failure_tally(_outcomes(spark, sf_dir))


@query(f"""
SELECT crawl_id, count(*) AS observations, count(DISTINCT probe_id) AS detectors, count(*) FILTER (WHERE outcome = 'pass') AS pass, count(*) FILTER (WHERE outcome = 'warn') AS warn, count(*) FILTER (WHERE outcome = 'fail') AS fail,
 count(*) FILTER (WHERE outcome = 'error') AS error, count(*) FILTER (WHERE outcome = 'not-applicable') AS not_applicable FROM ({_OBS}) GROUP BY 1
""")
def observation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.observation_summary(_outcomes(spark, sf_dir))


@query(_GRADED + "SELECT crawl_id, basis, count(*) AS checks FROM st GROUP BY 1, 2")
def basis_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.basis_histogram(_graded(spark, sf_dir))


_HALVES = """
WITH h AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey, o_orderdate < DATE '1998-06-01' AS old FROM orders),
b AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS s FROM h WHERE old GROUP BY 1, 2), n AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS s FROM h WHERE NOT old GROUP BY 1, 2)
"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp")

    def half(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
        return last.select(F.col("o_custkey").cast("string").alias("site"), F.col("o_orderpriority").alias("check_id"), F.col("s").alias("status"), F.lit("-").alias("basis"))

    return half(orders.where(~old)), half(orders.where(old))


@query(_HALVES + """
SELECT coalesce(n.o_custkey, b.o_custkey)::VARCHAR AS site, coalesce(n.o_orderpriority, b.o_orderpriority) AS check_id, CASE WHEN b.s IS NULL THEN 'new' WHEN n.s IS NULL THEN 'dropped' ELSE 'moved' END AS kind
FROM n FULL JOIN b ON n.o_custkey = b.o_custkey AND n.o_orderpriority = b.o_orderpriority WHERE n.s IS DISTINCT FROM b.s
""")
def verdict_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.verdict_moves(*_halves(spark, sf_dir)).select("site", "check_id", "kind")


@query(_HALVES + "SELECT n.o_custkey::VARCHAR AS site, n.o_orderpriority AS check_id FROM n JOIN b ON n.o_custkey = b.o_custkey AND n.o_orderpriority = b.o_orderpriority WHERE b.s = 'F' AND n.s <> 'F'")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _halves(spark, sf_dir)
    return now.join(before.select("site", "check_id", F.col("status").alias("was")), ["site", "check_id"]).where("was = 'F' and status <> 'F'").select("site", "check_id")


@query(_HALVES + """
SELECT n.o_custkey % 25 AS template, n.o_orderpriority AS check_id, count(*) AS compared, count(*) FILTER (WHERE n.s <> 'F') AS worse FROM n JOIN b ON n.o_custkey = b.o_custkey AND n.o_orderpriority = b.o_orderpriority
WHERE b.s = 'F' GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (WHERE n.s <> 'F') * 2 >= count(*)
""")
def template_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _halves(spark, sf_dir)
    met = now.join(before.select("site", "check_id", F.col("status").alias("was")), ["site", "check_id"]).where("was = 'F'")
    groups = met.groupBy((F.col("site").cast("long") % 25).alias("template"), "check_id").agg(F.count("*").alias("compared"), F.count_if(F.col("status") != "F").alias("worse"))
    return groups.where("compared >= 2 and worse * 2 >= compared")


@query("""
WITH RECURSIVE m AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_custkey - 4 ELSE c_custkey + 1 END AS t FROM customer),
st AS (SELECT s, t FROM m WHERE t IN (SELECT s FROM m WHERE t IS NOT NULL)),
w(s, here, n) AS (SELECT s, t, 1 FROM st UNION ALL SELECT w.s, m.t, n + 1 FROM w JOIN m ON m.s = w.here WHERE m.t IS NOT NULL AND n < 40)
SELECT s::VARCHAR AS source, max(n) >= 40 AS loops FROM w GROUP BY 1
""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    goal = F.when(key % 7 == 0, None).when(key % 5 == 0, key - 4).otherwise(key + 1)
    rows = read(spark, sf_dir, "customer").select(F.lit("c").alias("crawl_id"), key.cast("string").alias("source"), goal.cast("string").alias("goal"))
    return chained(rows.where("goal is not null")).select("source", "loops")


@query("""
WITH m AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 120 <> 0 THEN c_custkey + 1 WHEN c_custkey // 120 % 2 = 0 THEN c_custkey - 119 END AS t, (c_custkey + 119) // 120 AS block FROM customer)
SELECT s::VARCHAR AS source, block % 2 = 0 AND block * 120 <= (SELECT max(s) FROM m) AS loops FROM m WHERE t IN (SELECT s FROM m)
""")
def redirect_long_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 120 entries: every other one comes back to its beginning, the others end
    at an entry that is gone."""
    key = F.col("c_custkey")
    goal = F.when(key % 120 != 0, key + 1).when(F.floor(key / 120) % 2 == 0, key - 119)
    rows = read(spark, sf_dir, "customer").select(F.lit("c").alias("crawl_id"), key.cast("string").alias("source"), goal.cast("string").alias("goal"))
    return chained(rows).select("source", "loops")


@query("""
WITH e AS (SELECT DISTINCT c_custkey AS a, s_suppkey AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT a, b FROM e WHERE a <> b AND NOT EXISTS (SELECT 1 FROM e r WHERE r.a = e.b AND r.b = e.a)
""")
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = edges.select(F.col("c_custkey").alias("a"), F.col("s_suppkey").alias("b")).distinct()
    return edges.where("a <> b").join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


@query("""
SELECT l_orderkey AS observation_id, l_linenumber AS line, o_custkey AS page_id, c_name AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
""")
def evidence_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("observation_id"), F.col("l_linenumber").alias("line"))
    observations = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("page_id"))
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("page"))
    return compare.evidence_drilldown(links, observations, pages).select("observation_id", "line", "page_id", "page")


@query("SELECT o_orderkey AS audit_id, c_name AS site, o_orderdate AS created_at FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("site_id"), F.col("o_orderdate").alias("created_at"))
    sites = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("site"))
    return compare.recent(audits, sites).select("audit_id", "site", "created_at")


@query("SELECT o_custkey AS site_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS audit_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("audit_id"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"), F.lit(False).alias("current")
    )
    return compare.latest_complete(audits)


@query("""
SELECT p_brand, count(*) FILTER (WHERE v <= 1000) AS good, count(*) FILTER (WHERE v > 1000 AND v <= 1050) AS needs_improvement, count(*) FILTER (WHERE v > 1050) AS poor FROM (SELECT p_brand, p_retailprice AS v FROM part) GROUP BY 1
""")
def field_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_retailprice")
    grade = F.when(v <= 1000, "good").when(v <= 1050, "needs_improvement").otherwise("poor")
    return read(spark, sf_dir, "part").select("p_brand", grade.alias("g")).groupBy("p_brand").pivot("g", ["good", "needs_improvement", "poor"]).count().fillna(0)


@query("SELECT sha256(text) AS hash, 'sha256/' || sha256(text)[1:2] || '/' || sha256(text)[3:] AS path FROM (SELECT DISTINCT text FROM conversations)")
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.blobs(read(spark, sf_dir, "conversations"), "text").select("hash", "path")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem UNION SELECT 's' || l_suppkey, 'p' || (l_partkey + 1) FROM lineitem),
w(u, d) AS (SELECT 'p1', 0 UNION SELECT t, d + 1 FROM w JOIN e ON e.s = w.u WHERE d < 3)
SELECT u AS url, min(d)::BIGINT AS depth FROM w GROUP BY 1
""")
def crawl_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first part to its suppliers, on to the parts after theirs, and their suppliers."""
    lines = read(spark, sf_dir, "lineitem")
    part, following, supplier = (F.concat(F.lit(name), key) for name, key in (("p", F.col("l_partkey")), ("p", F.col("l_partkey") + 1), ("s", F.col("l_suppkey"))))
    edges = lines.select(part.alias("source"), supplier.alias("target")).union(lines.select(supplier, following)).distinct()
    seeds = spark.createDataFrame([("p1",)], "url string")
    return store.frontier(edges, seeds, 3).select("url", F.col("depth").cast("long").alias("depth"))
