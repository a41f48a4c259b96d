"""Detectors that look at a whole crawl: one observation per crawl.

Each is a grouped tally joined to the site's row, judged by a ladder.  Joins are
on (crawl, URL); nothing is gathered per crawl but counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import fixed as X
from lodestar.functions import robots as R
from lodestar.functions.url import TRACKING_KEYS
from lodestar.operators.audit import NETLOC, NOINDEX, Audit, same_site
from lodestar.operators.ladder import ERROR, FAIL, NA, PASS, WARN, Rung, observed
from lodestar.operators.page_detectors import IS_ARTICLE

SITE: dict[str, Callable[[Audit], DataFrame]] = {}
#: a date as written in markup or headers
WHEN = (
    "coalesce(try_cast({0} as timestamp), try_to_timestamp(regexp_replace({0}, '^[A-Za-z]+, *', ''), 'd MMM yyyy HH:mm:ss z'), "
    "try_to_timestamp({0}, 'd MMMM yyyy'), try_to_timestamp({0}, 'MMMM d, yyyy'))"
)


def site(name: str) -> Callable[[Callable[[Audit], DataFrame]], Callable[[Audit], DataFrame]]:
    def register(run: Callable[[Audit], DataFrame]) -> Callable[[Audit], DataFrame]:
        SITE[name] = run
        return run

    return register


def tally(audit: Audit, *parts: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Sites with aggregates over tables that have crawl_id; missing numbers are 0."""
    out = audit.site_facts
    for rows, wanted in parts:
        sums = rows.groupBy("crawl_id").agg(*[F.expr(e).alias(n) for n, e in wanted.items()])
        out = out.join(audit.met(sums), "crawl_id", "left").fillna(0, list(wanted))
    return out


def judged(name: str, audit: Audit, parts: list[tuple[DataFrame, dict[str, str]]], *rungs: Rung) -> DataFrame:
    return observed(tally(audit, *parts), name, rungs)


def by_url(audit: Audit, *columns: str) -> DataFrame:
    """Pages by (crawl_id, target): narrow, for joins."""
    return audit.facts.selectExpr("crawl_id", "normalized_url as target", *columns)


_NO_PAGES: Rung = (NA, "html_pages = 0", "No HTML pages were crawled.")


# ---- title and breadcrumbs: page scope, but they need other pages


@site("title-uniqueness")
def title_uniqueness(audit: Audit) -> DataFrame:
    """A crawl holds every URL once; where a table holds one twice, each row is a page."""
    titles = audit.facts.where("is_html").selectExpr("crawl_id", "normalized_url", "x.title as title")
    shared = titles.where("coalesce(title, '') <> ''").groupBy("crawl_id", "title").agg(F.count("*").alias("pages")).where("pages > 1")
    rows = titles.join(shared, ["crawl_id", "title"], "left")
    length = "length(encode(title, 'UTF-16BE')) / 2"
    return observed(
        rows, "title-uniqueness",
        [
            (FAIL, "coalesce(title, '') = ''", "No title."),
            (FAIL, "pages > 1", "Title is shared with {pages - 1} other page(s)."),
            (WARN, f"{length} > 60", f"Title is {{bigint({length})}} characters."),
            (PASS, "true", "Title is unique."),
        ],
        "page", "normalized_url",
    )


@site("breadcrumb-navigation")
def breadcrumb_navigation(audit: Audit) -> DataFrame:
    pages = audit.facts.where("is_html")
    crumbs = pages.selectExpr("crawl_id", "normalized_url", "explode(flatten(transform(x.breadcrumbs, b -> b.targets))) as target")
    reached = crumbs.join(by_url(audit, "f.status as found"), ["crawl_id", "target"]).groupBy("crawl_id", "normalized_url").agg(
        F.expr("count_if(found >= 400)").alias("broken"), F.expr("count_if(found is null or found < 400)").alias("verified")
    )
    rows = pages.selectExpr(
        "crawl_id", "normalized_url", "flags", "depth", "size(x.breadcrumbs) as trails", "size(flatten(transform(x.breadcrumbs, b -> b.links))) as linked"
    ).join(reached, ["crawl_id", "normalized_url"], "left")
    return observed(
        rows, "breadcrumb-navigation",
        [
            (NA, "not array_contains(flags, 'hierarchical')", "The site does not claim hierarchical content."),
            (NA, "depth = 0", "The home page is above any trail."),
            (FAIL, "trails = 0", "No breadcrumb trail below the root."),
            (FAIL, "linked = 0", "A trail without links."),
            (FAIL, "broken > 0", "{broken} ancestor(s) do not resolve."),
            (WARN, "coalesce(verified, 0) = 0", "{linked} ancestor(s) linked, none reached."),
            (PASS, "true", "{verified} ancestor(s) resolve."),
        ],
        "page", "normalized_url",
    )


@site("locale-canonical")
def locale_canonical(audit: Audit) -> DataFrame:
    """A page's locales are those it names and those named by pages that name it."""
    named = audit.facts.where("is_html").selectExpr("crawl_id", "normalized_url as source", "explode(x.hreflang) as alt").selectExpr("crawl_id", "source", "alt.target as target", "alt.hreflang as tag").where("target is not null")
    own = named.selectExpr("crawl_id", "source as page", "target", "tag", "0 as far")
    via = named.selectExpr("crawl_id", "target as page", "source").where("page <> source").join(named, ["crawl_id", "source"]).selectExpr("crawl_id", "page", "target", "tag", "1 as far")
    cluster = own.union(via).groupBy("crawl_id", "page", "target").agg(F.expr("min_by(tag, far)").alias("tag"))
    facts = audit.facts.where("is_html").selectExpr("crawl_id", "normalized_url as page", "f.status as status", "x.canonical as canonical", "x.canonical_target as declared", "nullif(trim(x.lang), '') as lang")
    sums = cluster.groupBy("crawl_id", "page").agg(F.count("*").alias("named"), F.expr("count_if(target <> page)").alias("others"), F.expr("max(if(target = page, tag, null))").alias("own"))
    at = cluster.selectExpr("crawl_id", "page", "target as declared", "tag as locale")
    rows = facts.join(sums, ["crawl_id", "page"], "left").join(at, ["crawl_id", "page", "declared"], "left")
    language = "nullif(nullif(split(lower(trim({})), '[-_]')[0], ''), 'x')"
    mine = "coalesce(own, lang)"
    return observed(
        rows, "locale-canonical",
        [
            (NA, "status is null or status <> 200", "Response was not a 200."),
            (NA, "named is null", "No hreflang names this page."),
            (NA, "others = 0", "Its only locale is itself."),
            (WARN, "canonical is null", "A locale variant without rel=canonical."),
            (FAIL, "declared is null", "rel=canonical is not a usable URL."),
            (PASS, "declared = page", "Self-canonical beside {others} other locale(s)."),
            (NA, "locale is not null and own is null and lower(lang) = lower(trim(locale))", "It is no locale variant of its own."),
            (WARN, f"{language.format(mine)} = {language.format('locale')} and lower(trim({mine})) <> lower(trim(locale))", "Canonical to a region of the same language."),
            (FAIL, "locale is not null", "Canonical to another locale, {locale}."),
            (FAIL, "true", "Canonical to a URL that no hreflang names."),
        ],
        "page", "page",
    )


@site("crawler-fetch-limit")
def crawler_fetch_limit(audit: Audit) -> DataFrame:
    from lodestar.operators.page_detectors import LIMIT, PDF_LIMIT, measured, severity

    kind = "lower(trim(split(f.content_type, ';')[0]))"
    pages = audit.facts.selectExpr("crawl_id", "normalized_url", "f", f"{kind} as kind", "array_distinct(concat(coalesce(x.stylesheets, array()), coalesce(x.scripts, array()))) as assets").selectExpr(
        "*", f"{measured('f')} as size"
    ).selectExpr("crawl_id", "normalized_url", "f.status as status", "f.error as error", "kind", "size", "assets", f"if(kind = 'application/pdf', {severity('size', PDF_LIMIT)}, {severity('size', LIMIT)}) as own")
    fetched = audit.auxiliary.where("reason = 'asset'").selectExpr("crawl_id", "url as asset", f"{measured('fetch')} as size").selectExpr("crawl_id", "asset", f"{severity('size', LIMIT)} as level").dropDuplicates(["crawl_id", "asset"])
    worst = pages.selectExpr("crawl_id", "normalized_url", "explode(assets) as asset").join(fetched, ["crawl_id", "asset"]).groupBy("crawl_id", "normalized_url").agg(F.max("level").alias("asset_level"))
    rows = pages.join(worst, ["crawl_id", "normalized_url"], "left").selectExpr("*", "greatest(own, coalesce(asset_level, 0)) as level")
    return observed(
        rows, "crawler-fetch-limit",
        [
            (NA, "error is not null or status is null or status < 200 or status >= 300", "No successful response to measure."),
            (NA, "rlike(kind, '" + X.NO_DOCUMENT + "')", "{kind} is no document."),
            (FAIL, "level = 3", "{size.bytes} bytes, or a linked file, are past the limit."),
            (ERROR, "level = 2", "The size is not known."),
            (WARN, "level = 1", "{size.bytes} bytes, or a linked file, are near the limit."),
            (PASS, "true", "{size.bytes} bytes."),
        ],
        "page", "normalized_url",
    )


# ---- robots and sitemaps


@site("robots-txt")
def robots_txt(audit: Audit) -> DataFrame:
    groups = audit.site_facts.withColumn("groups", R.groups(F.col("robots_txt"))).withColumn("named", R.sitemaps(F.col("robots_txt")))
    rungs = [
        (FAIL, "robots_status is null and robots_error is not null", "robots.txt did not answer."),
        (FAIL, "robots_status >= 500 or robots_status = 429", "robots.txt answers {robots_status}."),
        (WARN, "robots_txt is null", "No robots.txt is served."),
        (FAIL, "exists(groups, g -> array_contains(g.agents, '*') and exists(g.rules, r -> not r.allow and r.path = '/'))", "robots.txt disallows everything."),
        (WARN, "octet_length(robots_txt) > 512000", "robots.txt is over 500 KiB."),
        (PASS, "true", "robots.txt is readable and names {size(named)} sitemap(s)."),
    ]
    return observed(groups, "robots-txt", rungs)


@site("sitemap-validity")
def sitemap_validity(audit: Audit) -> DataFrame:
    listed = audit.sitemap_urls.join(audit.site_facts.select("crawl_id", "site_netloc"), "crawl_id")
    joined = listed.join(by_url(audit, "f.status as status", "true as crawled").withColumnRenamed("target", "normalized_url"), ["crawl_id", "normalized_url"], "left")
    return judged(
        "sitemap-validity", audit,
        [
            (joined, {"urls": "count(*)", "off_site": f"count_if(not ({same_site('url')}))", "broken": "count_if(crawled and (status is null or status >= 400))"}),
            (audit.sitemaps, {"over": "count_if(url_count > 50000)", "dead": "count_if(declared and (status is null or status >= 400))"}),
        ],
        (FAIL, "urls = 0 and dead > 0", "{dead} declared sitemap(s) do not answer."),
        (WARN, "urls = 0", "No sitemap is published."),
        (FAIL, "over > 0", "{over} sitemap(s) list over 50,000 URLs."),
        (FAIL, "off_site > 0 or broken > 0", "Sitemaps list {off_site} off-site and {broken} broken URL(s)."),
        (PASS, "true", "Sitemaps list {urls} URL(s)."),
    )


@site("sitemap-canonical-agreement")
def sitemap_canonical_agreement(audit: Audit) -> DataFrame:
    listed = audit.sitemap_urls.select("crawl_id", "normalized_url").distinct()
    pages = audit.facts.where("html_200").selectExpr("crawl_id", "normalized_url", "x.canonical_target as canonical").join(listed, ["crawl_id", "normalized_url"])
    return judged(
        "sitemap-canonical-agreement", audit,
        [(listed, {"urls": "count(*)"}), (pages, {"differ": "count_if(canonical <> normalized_url)"})],
        (NA, "urls = 0", "No sitemap was found."),
        (FAIL, "differ > 0", "{differ} listed page(s) canonicalize elsewhere."),
        (PASS, "true", "All listed pages canonicalize to themselves."),
    )


@site("index-bloat")
def index_bloat(audit: Audit) -> DataFrame:
    listed = audit.sitemap_urls.select("crawl_id", "normalized_url").distinct()
    pages = audit.facts.where("html_200 and not meta_noindex").select("crawl_id", "normalized_url")
    joined = pages.join(listed.withColumn("listed", F.lit(True)), ["crawl_id", "normalized_url"], "left")
    return judged(
        "index-bloat", audit,
        [
            (joined, {"indexable": "count(*)", "unlisted": "count_if(listed is null)"}),
            (listed, {"urls": "count(*)"}),
            (audit.sitemaps, {"cut": "count_if(truncated)", "read": "count_if(url_count > 0)", "feeds": "count_if(url_count > 0 and (news_count >= url_count or video_count >= url_count))"}),
        ],
        (NA, "indexable = 0", "No indexable pages were crawled."),
        (NA, "urls = 0", "No sitemap to compare with."),
        (ERROR, "cut > 0", "{cut} sitemap(s) were not read in full."),
        (WARN, "read > 0 and feeds = read and unlisted > 0", "{unlisted} page(s) are unlisted, but all sitemaps are feeds."),
        (FAIL, "unlisted / indexable > 0.25", "{unlisted} of {indexable} indexable pages are unlisted."),
        (WARN, "unlisted > 0", "{unlisted} indexable page(s) are unlisted."),
        (PASS, "true", "All indexable pages are listed."),
    )


# ---- links


@site("orphan-pages")
def orphan_pages(audit: Audit) -> DataFrame:
    linked = audit.edges.where("internal and target is not null").select("crawl_id", F.col("target").alias("normalized_url")).distinct()
    seeds = audit.seeds.selectExpr("crawl_id", "url as normalized_url")
    orphans = audit.facts.where("html_200").select("crawl_id", "normalized_url").join(linked.union(seeds).distinct(), ["crawl_id", "normalized_url"], "left_anti")
    unread = audit.not_reached.selectExpr("crawl_id", "url as normalized_url").join(linked, ["crawl_id", "normalized_url"], "left_semi")
    return judged(
        "orphan-pages", audit, [(orphans, {"orphans": "count(*)"}), (unread, {"unread": "count(*)"})],
        (PASS, "orphans = 0", "Every page is linked."),
        (WARN, "unread > 0", "{orphans} page(s) are not linked, but {unread} linked page(s) were never read."),
        (FAIL, "true", "{orphans} page(s) are reachable only from the sitemap."),
    )


@site("click-depth")
def click_depth(audit: Audit) -> DataFrame:
    pages = audit.facts.where("html_200")
    return judged(
        "click-depth", audit, [(pages, {"html_pages": "count(*)", "deep": "count_if(depth > 3)", "deepest": "max(depth)"})],
        _NO_PAGES, (WARN, "deep > 0", "{deep} page(s) are over 3 clicks deep."), (PASS, "true", "The deepest page is {deepest} click(s) deep."),
    )


@site("internal-linking")
def internal_linking(audit: Audit) -> DataFrame:
    pages = audit.facts.where("html_200").select("crawl_id", F.col("normalized_url").alias("target"))
    inbound = audit.edges.where("from_200 and internal and target is not null and target <> from_url").groupBy("crawl_id", "target").agg(F.count("*").alias("links"))
    joined = pages.join(inbound, ["crawl_id", "target"], "left")
    return judged(
        "internal-linking", audit, [(joined, {"html_pages": "count(*)", "thin": "count_if(coalesce(links, 0) < 2)"})],
        (NA, "html_pages < 2", "Too few pages."), (WARN, "thin > 0", "{thin} of {html_pages} page(s) have fewer than two inbound links."), (PASS, "true", "All pages have two inbound links."),
    )


@site("broken-links")
def broken_links(audit: Audit) -> DataFrame:
    """Distinct (page, target) links; a host is the crawl's own if a page landed there."""
    links = audit.edges.where("target is not null and target <> from_url").select("crawl_id", "from_url", "target").distinct()
    hosts = audit.facts.selectExpr("crawl_id", f"{NETLOC.format('f.final_url')} as netloc").union(audit.seeds.selectExpr("crawl_id", f"{NETLOC.format('url')}")).distinct().withColumn("own", F.lit(True))
    outside = audit.auxiliary.where("reason = 'external-link'").selectExpr("crawl_id", "url as target", "fetch.status as far_status", "fetch.error as far_error", "true as checked").dropDuplicates(["crawl_id", "target"])
    blocked = audit.blocked.selectExpr("crawl_id", "url as target", "true as barred").distinct()
    found = (
        links.withColumn("netloc", F.expr(NETLOC.format("target")))
        .join(by_url(audit, "f.status as status", "f.error as error", "true as reached"), ["crawl_id", "target"], "left")
        .join(hosts, ["crawl_id", "netloc"], "left")
        .join(outside, ["crawl_id", "target"], "left")
        .join(blocked, ["crawl_id", "target"], "left")
        .withColumn("external", F.expr("reached is null and own is null"))
    )
    state = (
        "case when external and checked is null then 'unverified' when external then "
        "case when far_error is not null or far_status is null or far_status in (429, 401, 403, 999) then 'unverified' when far_status >= 400 then 'broken' else 'ok' end "
        "when reached is null then if(barred, 'barred', 'unverified') "
        "when error is not null or status is null or status = 429 then 'unverified' when status >= 400 then 'broken' else 'ok' end"
    )
    targets = found.withColumn("state", F.expr(state)).groupBy("crawl_id", "target").agg(F.first("state").alias("state"), F.first("external").alias("external"), F.count("*").alias("sources"))
    read = audit.facts.where("is_html")
    return judged(
        "broken-links", audit,
        [
            (read, {"html_pages": "count(*)"}),
            (targets, {"links": "sum(sources)", "broken": "count_if(state = 'broken')", "broken_links": "sum(if(state = 'broken', sources, 0))", "unverified": "count_if(state = 'unverified')"}),
        ],
        _NO_PAGES,
        (NA, "links = 0", "No links were found."),
        (FAIL, "broken > 0", "{broken_links} link(s) lead to {broken} URL(s) that answer with an error."),
        (WARN, "unverified > 0", "{unverified} link target(s) were not verified."),
        (PASS, "true", "All {links} links lead to pages that answer."),
    )


@site("trust-pages-presence")
def trust_pages_presence(audit: Audit) -> DataFrame:
    #: fixed values: link texts and path segments of each kind of page
    kinds = {
        "About": (r"about|about us|about the [\p{L} ]+|who we are|our story|om oss|über uns|qui sommes-nous|chi siamo|quiénes somos", r"(about|about-us|about_us|aboutus|who-we-are|om-oss|ueber-uns|uber-uns|qui-sommes-nous|chi-siamo|quienes-somos)(\.\w+)?"),
        "Contact": (r"contact|contact us|contact the [\p{L} ]+|kontakt|contacto|contato|contatti|nous contacter", r"(contact|contact-us|contactus|kontakt|contacto|contato|contatti|nous-contacter)(\.\w+)?"),
        "Privacy policy": (r"privacy( policy| notice)?|datenschutz(erklärung)?|politique de confidentialité|informativa sulla privacy|política de privacidad", r"(privacy(-policy|-notice)?|datenschutz(erklaerung)?|politique-de-confidentialite|informativa-sulla-privacy|politica-de-privacidad)(\.\w+)?"),
        "Terms": (r"terms( (of|and) (service|use|conditions))?|tos|conditions générales|allgemeine geschäftsbedingungen|agb|términos y condiciones", r"(terms(-of-(service|use))?|terms-and-conditions|tos|conditions-generales|agb|terminos-y-condiciones|termini-e-condizioni)(\.\w+)?"),
    }
    segment = F.expr(r"filter(split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), s -> s <> '')")
    edges = audit.edges.where("from_200 and target is not null").withColumn("segments", segment)
    kind = [
        F.expr(f"if(rlike(trim(anchor_text), r'(?iu)^({text})$') or exists(segments, s -> rlike(s, r'(?i)^({path})$')), '{name}', null)") for name, (text, path) in kinds.items()
    ]
    linked = edges.select("crawl_id", "target", F.explode(F.array_compact(F.array(*kind))).alias("kind")).distinct()
    state = linked.join(by_url(audit, "f.status as status", "f.error as error", "true as reached"), ["crawl_id", "target"], "left")
    each = state.groupBy("crawl_id", "kind").agg(
        F.expr("count_if(reached and error is null and status < 400)").alias("ok"),
        F.expr("count_if(reached and not coalesce(error is null and status < 400, false))").alias("broken"),
        F.expr("count_if(reached is null)").alias("unchecked"),
    )
    return judged(
        "trust-pages-presence", audit,
        [(audit.facts.where("html_200"), {"html_pages": "count(*)"}), (each, {"kinds": "count(*)", "broken": "sum(if(ok = 0, broken, 0))", "unchecked": "sum(if(ok = 0, unchecked, 0))"})],
        _NO_PAGES,
        (FAIL, "broken > 0", "{broken} trust page link(s) answer with an error."),
        (WARN, "kinds < 4 or unchecked > 0", "{4 - kinds} kind(s) of trust page are not linked, {unchecked} not fetched."),
        (PASS, "true", "About, contact, privacy and terms are linked and answer."),
    )


@site("outbound-link-qualification")
def outbound_link_qualification(audit: Audit) -> DataFrame:
    sponsored = X.SPONSORED
    declared = (
        "exists(x.json_ld_nodes, n -> exists(n.types, t -> regexp_replace(t, '^(https?://schema[.]org/|schema:)', '') = 'AdvertiserContentArticle')) "
        f"or exists(split(regexp_extract(f.final_url, '^https?://[^/?#]*([^?#]*)', 1), '/'), s -> rlike(s, '{sponsored}'))"
    )
    loose = f"filter(x.links, l -> not rlike(l.url, '(?i)^(mailto|tel):') and not ({same_site('l.url')}) and not rlike(coalesce(l.rel, ''), '(?i)\\\\b(nofollow|sponsored|ugc)\\\\b'))"
    pages = audit.facts.where("html_200").selectExpr("crawl_id", f"({declared}) as sponsored", f"size({loose}) as loose")
    return judged(
        "outbound-link-qualification", audit, [(pages, {"html_pages": "count(*)", "sponsored": "count_if(sponsored)", "loose": "sum(if(sponsored, loose, 0))"})],
        _NO_PAGES,
        (NA, "sponsored = 0", "No page declares itself sponsored."),
        (FAIL, "loose > 0", "{loose} outbound link(s) on sponsored pages are not qualified."),
        (PASS, "true", "All outbound links on sponsored pages are qualified."),
    )


@site("ugc-governance")
def ugc_governance(audit: Audit) -> DataFrame:
    loose = f"filter(flatten(transform(x.comment_regions, c -> c.links)), l -> rlike(l.url, '^https?:') and not ({same_site('l.url')}) and not rlike(coalesce(l.rel, ''), '(?i)\\\\b(nofollow|ugc)\\\\b'))"
    pages = audit.facts.where("html_200").selectExpr("crawl_id", "(exists(x.comment_regions, c -> c.has_form) or x.derived.commented) as ugc", f"size({loose}) as loose")
    return judged(
        "ugc-governance", audit, [(pages, {"ugc": "count_if(ugc)", "loose": "sum(if(ugc, loose, 0))"})],
        (NA, "ugc = 0", "No page takes comments."), (FAIL, "loose > 0", "{loose} link(s) in comments are not qualified."), (PASS, "true", "All links in comments are qualified."),
    )


@site("pagination-crawl-path")
def pagination_crawl_path(audit: Audit) -> DataFrame:
    paged = "([?&](page|p)=\\\\d+|/(page|p)/\\\\d+)"
    html = audit.facts.where("html_200")
    links = audit.edges.where(f"from_200 and internal and target is not null and (rlike(coalesce(rel, ''), '(?i)\\\\b(next|prev)\\\\b') or rlike(url, '(?i){paged}'))")
    reached = links.where("target <> from_url").join(by_url(audit, "f.status as status", "meta_noindex", "x.canonical_target as canonical", "true as reached"), ["crawl_id", "target"], "left")
    return judged(
        "pagination-crawl-path", audit,
        [
            (html, {"html_pages": "count(*)", "fragments": "sum(size(x.fragment_page_links))"}),
            (links, {"own_fragments": "count_if(target = from_url and contains(url, '#'))", "found": "count_if(target <> from_url)"}),
            (reached, {"reached": "count_if(reached)", "broken": "count_if(status >= 400)", "hidden": "count_if(meta_noindex)", "collapsed": f"count_if(canonical <> target and not rlike(canonical, '(?i){paged}'))"}),
        ],
        _NO_PAGES,
        (NA, "found = 0 and fragments + own_fragments = 0", "No paginated series."),
        (FAIL, "fragments + own_fragments > 0", "{fragments + own_fragments} paginated link(s) are only fragments."),
        (FAIL, "broken > 0", "{broken} paginated URL(s) answered with an error."),
        (WARN, "reached = 0", "{found} paginated URL(s) were linked, none reached."),
        (FAIL, "hidden > 0", "{hidden} paginated page(s) are noindex."),
        (FAIL, "collapsed > 0", "{collapsed} paginated page(s) canonicalize onto an unpaginated URL."),
        (PASS, "true", "{reached} paginated URL(s) were reached."),
    )


@site("third-party-budget")
def third_party_budget(audit: Audit) -> DataFrame:
    html = audit.facts.where("html_200")
    scripts = html.selectExpr("crawl_id", "site_netloc", "explode(x.scripts) as script").where(f"not ({same_site('script')})").selectExpr("crawl_id", f"{NETLOC.format('script')} as host").where("host <> ''")
    return judged(
        "third-party-budget", audit, [(html, {"html_pages": "count(*)"}), (scripts, {"hosts": "count(distinct host)"})],
        _NO_PAGES, (PASS, "hosts = 0", "No third-party scripts."), (FAIL, "hosts > 10", "{hosts} third-party script hosts."), (WARN, "true", "{hosts} third-party script host(s)."),
    )


# ---- URLs


@site("url-convention")
def url_convention(audit: Audit) -> DataFrame:
    return judged(
        "url-convention", audit,
        [(audit.facts.where("html_200"), {
            "html_pages": "count(*)", "upper": "count_if(rlike(path, '[A-Z]'))", "underscored": "count_if(contains(path, '_'))", "deep": "count_if(size(filter(split(path, '/'), s -> s <> '')) > 4)",
        })],
        _NO_PAGES, (WARN, "upper + underscored + deep > 0", "Against the convention: {upper} capital(s), {underscored} underscore(s), {deep} deep path(s)."), (PASS, "true", "All paths follow the convention."),
    )


@site("host-slash-policy")
def host_slash_policy(audit: Audit) -> DataFrame:
    pages = audit.facts.where("html_200").selectExpr("crawl_id", f"{NETLOC.format('normalized_url')} as host", "path", "path <> '/' and not rlike(path, '(?i)[.][a-z0-9]{2,5}$') as directory")
    return judged(
        "host-slash-policy", audit,
        [(pages, {"html_pages": "count(*)", "hosts": "count(distinct host)", "with_slash": "count_if(directory and endswith(path, '/'))", "without": "count_if(directory and not endswith(path, '/'))"})],
        _NO_PAGES, (FAIL, "hosts > 1", "Pages come from {hosts} hosts."), (FAIL, "with_slash > 0 and without > 0", "{with_slash} with a trailing slash, {without} without."), (PASS, "true", "One host, one slash policy."),
    )


@site("internal-search-indexability")
def internal_search_indexability(audit: Audit) -> DataFrame:
    looks = f"rlike(regexp_extract({{0}}, '^https?://[^/?#]*([^?#]*)', 1), '{X.SEARCH_PATH}') or rlike({{0}}, '[?&]({'|'.join(X.SEARCH_NAMES)})(=|&|#|$)')"
    crawled = audit.facts.where(looks.format("normalized_url"))
    return judged(
        "internal-search-indexability", audit,
        [(crawled, {"crawled": "count(*)", "indexable": "count_if(not any_noindex)"}), (audit.blocked.where(looks.format("url")), {"barred": "count(*)"})],
        (NA, "crawled = 0 and barred = 0", "No internal search URLs."), (FAIL, "indexable > 0", "{indexable} internal search URL(s) are indexable."), (PASS, "true", "All internal search URLs are kept out."),
    )


#: SQL: a query's pairs, each with its role
_PAIRS = "filter(split(regexp_extract({0}, '[?]([^#]*)', 1), '&'), p -> p <> '')"
_TRACKING = "|".join(sorted(k for k in TRACKING_KEYS if not k.startswith("utm_")))
_NAMES = "'" + "', '".join(X.SEARCH_NAMES) + "'"
_PAGES = "'" + "', '".join(X.PAGE_NAMES) + "'"
_ROLE = (
    f"case when rlike(k, '{X.SESSION_NAMES}') then 'session' when rlike(k, '(?i)^(utm_.*|{_TRACKING})$') then 'tracking' "
    f"when lower(k) in ({_NAMES}) then 'search' when lower(k) in ({_PAGES}) and rlike(v, '^[0-9]+$') then 'pagination' else 'state' end"
)
ROUTE = "regexp_extract({0}, '^([^?#]*)', 1)"


def roles(url: str) -> str:
    """SQL: the roles of a URL's query pairs."""
    role = _ROLE.replace("(k,", "(substring_index(p, '=', 1),").replace("lower(k)", "lower(substring_index(p, '=', 1))").replace("(v,", "(regexp_extract(p, '=(.*)$', 1),")
    return f"transform({_PAIRS.format(url)}, p -> {role})"


@site("parameter-crawl-space")
def parameter_crawl_space(audit: Audit) -> DataFrame:
    fetched = audit.facts.selectExpr("crawl_id", "normalized_url as url")
    left = audit.not_reached.selectExpr("crawl_id", "url")
    marked = fetched.union(left).distinct().selectExpr("*", f"{roles('url')} as roles", f"{ROUTE.format('url')} as route", f"array_join(array_sort({_PAIRS.format('url')}), '&') as state")
    spelled = marked.where("size(roles) > 0").groupBy("crawl_id", "route", "state").agg(F.count("*").alias("ways")).where("ways > 1")
    routes = fetched.selectExpr("crawl_id", f"{ROUTE.format('url')} as route", "true as seen").distinct()
    over = left.selectExpr("crawl_id", "url", f"{roles('url')} as roles", f"{ROUTE.format('url')} as route").join(routes, ["crawl_id", "route"], "left")
    tracked = audit.edges.where(f"internal and not nofollow and array_contains({roles('url')}, 'tracking')")
    return judged(
        "parameter-crawl-space", audit,
        [
            (marked, {"urls": "count_if(size(roles) > 0)", "sessions": "count_if(array_contains(roles, 'session') or rlike(url, '" + X.SESSION_PATH + "'))"}),
            (spelled, {"permuted": "count(*)"}),
            (over, {"unfetched": "count(*)", "variants": "count_if(seen and size(roles) > 0)", "states": "count_if(array_contains(roles, 'state'))"}),
            (audit.blocked.where(f"size({_PAIRS.format('url')}) > 0"), {"barred": "count(*)"}),
            (tracked, {"tracked": "count(*)"}),
        ],
        (NA, "urls = 0 and barred = 0 and tracked = 0", "No parameter URLs."),
        (FAIL, "sessions > 0 or permuted > 0 or (variants >= 10 and variants * 2 >= unfetched)", "{sessions} session URL(s), {permuted} state(s) spelled twice, {variants} of {unfetched} unfetched are variants."),
        (WARN, "states > 0 or tracked > 0", "{states} filter URL(s) unfetched, {tracked} internal link(s) with campaign parameters."),
        (PASS, "true", "The parameter space is bounded ({urls} URLs)."),
    )


_PRODUCT = "(x.derived.product is not null or rlike(coalesce(x.open_graph['og:type'], ''), '(?i)^(og:)?product\\\\b'))"


@site("faceted-nav-control")
def faceted_nav_control(audit: Audit) -> DataFrame:
    html = audit.facts.where("html_200")
    products = html.where(_PRODUCT).selectExpr("crawl_id", f"{ROUTE.format('normalized_url')} as route").distinct()

    def facets(rows: DataFrame, url: str) -> DataFrame:
        return rows.withColumn("route", F.expr(ROUTE.format(url))).where(f"array_contains({roles(url)}, 'state')").join(products, ["crawl_id", "route"], "left_anti")

    listed = audit.sitemap_urls.select("crawl_id", "normalized_url").distinct().withColumn("listed", F.lit(True))
    treatment = (
        "case when any_noindex then 'excluded' when x.canonical_target is null then 'uncontrolled' when x.canonical_target = normalized_url then 'landing' else 'consolidated' end"
    )
    own = facets(html.where("hops = 0"), "normalized_url").selectExpr("crawl_id", "route", "normalized_url", "x.title as title", "x.canonical_target as target", f"{treatment} as treatment", f"array_contains({roles('normalized_url')}, 'pagination') as paged")
    joined = own.join(listed, ["crawl_id", "normalized_url"], "left").join(by_url(audit, "f.status as status", "any_noindex as hidden", "true as onto"), ["crawl_id", "target"], "left")
    pool = own.where("treatment = 'landing' and not paged").select("crawl_id", "route", "title", "normalized_url")
    listing = html.selectExpr("crawl_id", "normalized_url as route", "x.title as title", "normalized_url").join(pool.select("crawl_id", "route").distinct(), ["crawl_id", "route"], "left_semi")
    alike = pool.union(listing).where("coalesce(title, '') <> ''").groupBy("crawl_id", "route", "title").agg(F.count("*").alias("n"), F.expr("count_if(normalized_url <> route)").alias("extra")).where("n > 1")
    barred = facets(audit.blocked, "url").selectExpr("crawl_id", "url as normalized_url").join(listed, ["crawl_id", "normalized_url"], "left")
    return judged(
        "faceted-nav-control", audit,
        [
            (joined, {
                "facets": "count(*)", "uncontrolled": "count_if(treatment = 'uncontrolled')", "contradicted": "count_if(treatment in ('excluded', 'consolidated') and listed)",
                "dead_ends": "count_if(treatment = 'consolidated' and onto and (status is null or status <> 200 or hidden))",
            }),
            (alike, {"alike": "sum(extra)"}),
            (barred, {"barred": "count(*)", "barred_listed": "count_if(listed)"}),
            (facets(audit.not_reached, "url"), {"unfetched": "count(*)"}),
        ],
        (NA, "facets = 0 and barred = 0 and unfetched = 0", "No filtered URLs."),
        (FAIL, "uncontrolled + contradicted + dead_ends + alike + barred_listed > 0", "{uncontrolled} uncontrolled, {contradicted} kept out but listed, {dead_ends} dead-end, {alike} look-alike, {barred_listed} barred but listed."),
        (WARN, "facets = 0 and unfetched > 0", "{unfetched} filtered URL(s), none fetched."),
        (WARN, "barred > 0", "{barred} filtered URL(s) are only barred by robots.txt."),
        (PASS, "true", "All {facets} filtered URLs have a decision."),
    )


# ---- languages


@site("hreflang-cluster-qa")
def hreflang_cluster_qa(audit: Audit) -> DataFrame:
    rows = audit.alternates
    carrying = rows.groupBy("crawl_id", "page").agg(
        F.expr("first(canonical is null or canonical = page)").alias("judged"), F.first("meta_noindex").alias("hidden"),
        F.expr("bool_or(alt.target = page)").alias("names_self"), F.expr("count_if(not rlike(alt.hreflang, '(?i)^([a-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?|x-default)$'))").alias("bad"),
        F.expr("bool_or(lower(alt.hreflang) = 'x-default')").alias("fallback"),
    )
    claims = rows.where("(canonical is null or canonical = page) and alt.target is not null and " + same_site("alt.target")).selectExpr("crawl_id", "page", "alt.target as target").distinct()
    back = claims.selectExpr("crawl_id", "page as target", "target as page", "true as returned")
    known = audit.facts.where("html_200").selectExpr("crawl_id", "normalized_url as target", "true as known")
    pairs = claims.where("target <> page").join(known, ["crawl_id", "target"], "left").join(back, ["crawl_id", "target", "page"], "left")
    return judged(
        "hreflang-cluster-qa", audit,
        [
            (carrying, {
                "carrying": "count(*)", "annotated": "count_if(judged)", "selfless": "count_if(judged and not coalesce(names_self, false))", "hidden": "count_if(judged and hidden)",
                "bad": "sum(if(judged, bad, 0))", "fallback": "count_if(judged and fallback)",
            }),
            (pairs, {"one_way": "count_if(known and returned is null)", "unreached": "count_if(known is null)"}),
        ],
        (NA, "carrying = 0", "No page carries hreflang."),
        (NA, "annotated = 0", "All annotated pages canonicalize elsewhere."),
        (FAIL, "one_way > 0", "{one_way} annotation(s) are not reciprocated."),
        (FAIL, "selfless > 0", "{selfless} page(s) do not name themselves."),
        (FAIL, "hidden > 0", "{hidden} page(s) in a cluster are noindex."),
        (FAIL, "bad > 0", "{bad} value(s) are no language tag."),
        (WARN, "unreached > 0", "{unreached} target(s) were not fetched."),
        (WARN, "fallback = 0", "No page declares x-default."),
        (PASS, "true", "{annotated} page(s) form complete clusters."),
    )


@site("hreflang-implementation")
def hreflang_implementation(audit: Audit) -> DataFrame:
    from lodestar.functions.language import codes, tag_problem

    entries = audit.alternates.selectExpr("crawl_id", "page", "trim(alt.hreflang) as tag", "lower(trim(alt.hreflang)) as key", "coalesce(alt.target, alt.url) as target", "alt.href as href")
    told = entries.withColumn("told", F.when(F.col("key") == "x-default", F.lit("")).otherwise(tag_problem(F.col("tag"), codes(audit.spark))))
    by_tag = entries.where("key <> 'x-default'").groupBy("crawl_id", "page", "key").agg(F.countDistinct("target").alias("urls"))
    by_target = entries.where("key <> 'x-default'").groupBy("crawl_id", "page", "target").agg(
        F.expr("count(distinct split(key, '[-_]')[0])").alias("languages"), F.expr("count(distinct if(rlike(key, '[-_]'), key, null))").alias("regions")
    )
    by_page = entries.groupBy("crawl_id", "page").agg(F.expr("count_if(key = 'x-default')").alias("defaults"), F.countDistinct("key").alias("tags"))
    return judged(
        "hreflang-implementation", audit,
        [
            (audit.facts.where("html_200"), {"html_pages": "count(*)"}),
            (told, {"annotated": "count(distinct page)", "invalid": "count_if(startswith(told, 'invalid'))", "unsupported": "count_if(startswith(told, 'unsupported'))", "relative": "count_if(not rlike(trim(href), '(?i)^https?://'))"}),
            (by_tag, {"conflicting": "count_if(urls > 1)"}),
            (by_target, {"shared": "count_if(languages > 1)", "regional": "count_if(languages = 1 and regions > 1)"}),
            (by_page, {"repeated": "count_if(defaults > 1)", "lonely": "count_if(defaults = 1 and tags <= 2)"}),
        ],
        (FAIL, "annotated = 0 and array_contains(flags, 'multilingual')", "The site claims to be multilingual, but no page carries hreflang."),
        (NA, "annotated = 0", "No page carries hreflang."),
        (FAIL, "invalid > 0", "{invalid} value(s) name no locale."),
        (FAIL, "relative > 0", "{relative} annotation(s) use a relative href."),
        (FAIL, "conflicting > 0", "{conflicting} value(s) point at different URLs."),
        (FAIL, "shared > 0", "{shared} URL(s) are claimed by several languages."),
        (FAIL, "repeated > 0", "{repeated} page(s) repeat x-default."),
        (WARN, "unsupported > 0", "{unsupported} value(s) use an undocumented region."),
        (WARN, "regional > 0", "{regional} URL(s) serve several regions."),
        (WARN, "lonely > 0", "{lonely} page(s) declare x-default beside one locale."),
        (PASS, "true", "{annotated} page(s) name supported locales."),
    )


@site("locale-content-parity")
def locale_content_parity(audit: Audit) -> DataFrame:
    primary = "lower(split(trim({}), '[-_]')[0])"
    heads = "filter(transform(x.headings, h -> trim(h.text)), t -> t <> '')"
    html = audit.facts.where("html_200")
    own = f"try_element_at(filter(x.hreflang, a -> lower(a.hreflang) <> 'x-default' and a.target = normalized_url), 1).hreflang"
    rows = html.where("size(x.hreflang) > 0").selectExpr("crawl_id", "normalized_url as page", f"{primary.format(f'coalesce({own}, nullif(trim(x.lang), {chr(39)*2}))')} as locale", f"{heads} as ours", "explode(x.hreflang) as alt")
    pairs = rows.where(f"lower(alt.hreflang) <> 'x-default' and trim(alt.hreflang) <> '' and not ({primary.format('alt.hreflang')} <=> locale) and alt.target is not null and alt.target <> page").selectExpr("crawl_id", "page", "ours", "alt.target as target")
    met = pairs.join(html.selectExpr("crawl_id", "normalized_url as target", f"{heads} as theirs"), ["crawl_id", "target"]).withColumn("a", F.least("page", "target")).withColumn("b", F.greatest("page", "target")).dropDuplicates(["crawl_id", "a", "b"])
    return judged(
        "locale-content-parity", audit,
        [(rows, {"annotated": "count(distinct page)"}), (met.where("size(ours) >= 2 and size(theirs) >= 2"), {"comparable": "count(*)", "identical": "count_if(ours = theirs)"})],
        (WARN, "annotated = 0 and array_contains(flags, 'multilingual')", "The site claims to be multilingual, but no page carries hreflang."),
        (NA, "annotated = 0", "No page carries hreflang."),
        (FAIL, "identical > 0", "{identical} locale pair(s) have identical headings."),
        (WARN, "comparable = 0", "No locale pair could be compared."),
        (PASS, "true", "{comparable} locale pair(s) differ."),
    )


# ---- content


@site("author-date-signals")
def author_date_signals(audit: Audit) -> DataFrame:
    """Pages are read once: an article counts in its own row (kind 0), and its times of day
    in rows of theirs, of which those that fewer than 5 articles share end at once."""
    a, dates = "x.derived.article", ("p1", "m1", "p2", "m2")
    told = {"p1": f"{a}.published", "m1": f"{a}.modified", "p2": "nullif(trim(x.authorship.published_time), '')", "m2": "nullif(trim(x.authorship.modified_time), '')"}
    pages = audit.own_facts.where(f"html_200 and {IS_ARTICLE}").selectExpr(
        "crawl_id", "f.truncated as cut", f"{a} is not null as typed",
        f"coalesce({a}.author, x.authorship.byline, nullif(x.authorship.meta_author, ''), nullif(trim(x.authorship.article_author), '')) as author", "size(x.authorship.times) as times",
        "f.headers['date'] as sent", *[f"if(coalesce(f.truncated, true), null, {e}) as {c}" for c, e in told.items()],
    )
    read = pages.selectExpr("*", f"size(array_compact(array({', '.join(dates)}))) as declared", f"{WHEN.format('sent')} as served", *[f"{WHEN.format(c)} as {c}_at" for c in dates])
    bad = " + ".join(f"int({c} is not null and {c}_at is null)" for c in dates)
    late = " + ".join(f"int(coalesce({c}_at > served + interval 1 day, false))" for c in dates)
    backwards = " + ".join(f"int(coalesce(m{i}_at < p{i}_at - interval 1 day, false))" for i in (1, 2))
    counted = {
        "cut": "int(cut)", "articles": "int(not cut)", "unreadable": bad, "backwards": backwards, "future": late, "no_author": "int(not cut and typed and author is null)", "no_date": "int(not cut and declared = 0 and times = 0)",
        "published": "int(published is not null)", "modified": "int(modified is not null)",
    }
    timed = "if(rlike({0}, '[T ][0-9]{{2}}:[0-9]{{2}}'), {0}, null)".format
    rows = (
        read.selectExpr("*", "coalesce(if(p1_at is not null, p1, null), if(p2_at is not null, p2, null)) as published", "coalesce(if(m1_at is not null, m1, null), if(m2_at is not null, m2, null)) as modified")
        .selectExpr("crawl_id", *[f"{e} as `{n}_`" for n, e in counted.items()], f"stack(3, 0, null, 1, {timed('published')}, 2, {timed('modified')}) as (kind, stamp)")
        .where("kind = 0 or stamp is not null")
    )
    shared = rows.groupBy("crawl_id", "kind", "stamp").agg(F.count("*").alias("n"), *[F.expr(f"sum(if(kind = 0, {n}_, 0))").alias(f"{n}_") for n in counted]).where("kind = 0 or n >= 5")
    return judged(
        "author-date-signals", audit,
        [(shared, {
            **{n: f"sum({n}_)" for n in list(counted)[:7]},
            **{f"{n}_stamp": f"int(max(if(kind = {k}, n, 0)) * 5 >= greatest(sum({n}_) * 4, 1))" for k, n in ((1, "published"), (2, "modified"))},
        })],
        (ERROR, "articles = 0 and cut > 0", "All articles were cut."),
        (NA, "articles = 0", "No page declares itself an article."),
        (FAIL, "unreadable + backwards + future > 0", "{unreadable} unreadable, {backwards} backwards, {future} future date(s)."),
        (WARN, "no_author + no_date + published_stamp + modified_stamp > 0", "{no_author} without author, {no_date} without date, {published_stamp + modified_stamp} stamp(s)."),
        (PASS, "true", "{articles} article(s) carry credible dates."),
    )


@site("batch-page-quality")
def batch_page_quality(audit: Audit) -> DataFrame:
    pages = audit.facts.where("html_200 and not f.truncated").selectExpr("crawl_id", "filter(x.content.sections, s -> s.heading is not null) as sections").selectExpr(
        "crawl_id", "if(size(sections) >= 2, array_join(transform(sections, s -> concat(s.heading.level, ':', lower(trim(s.heading.text)), ':', s.words)), '~'), null) as signature"
    )
    groups = pages.where("signature is not null").groupBy("crawl_id", "signature").agg(F.count("*").alias("n")).where("n >= 3")
    return judged(
        "batch-page-quality", audit, [(pages, {"html_pages": "count(*)"}), (groups, {"batches": "count(*)", "affected": "sum(n)"})],
        (NA, "not array_contains(flags, 'bulk-publishing')", "The site does not claim bulk publishing."), _NO_PAGES,
        (FAIL, "batches > 0", "{batches} batch(es) of {affected} page(s) share one structure."), (PASS, "true", "No structure is shared by three pages."),
    )


@site("cannibalization")
def cannibalization(audit: Audit) -> DataFrame:
    h1 = "try_element_at(filter(x.headings, h -> h.level = 1), 1).text"
    pages = audit.facts.where("html_200 and not any_noindex and (x.canonical_target is null or x.canonical_target in (normalized_url, f.final_url))").selectExpr(
        "crawl_id", "coalesce(nullif(f.final_url, ''), normalized_url) as landed", "x.title as title", f"{h1} as h1"
    )
    signals = pages.selectExpr("crawl_id", "landed", "stack(2, 'title', title, 'h1', h1) as (signal, value)").where("trim(coalesce(value, '')) <> ''")
    groups = signals.groupBy("crawl_id", "signal", F.expr("lower(trim(value))").alias("value")).agg(F.countDistinct("landed").alias("urls")).where("urls > 1")
    return judged(
        "cannibalization", audit, [(pages, {"read": "count(distinct landed)"}), (groups, {"clusters": "count(*)"})],
        (NA, "read < 2", "Fewer than two candidates."), (FAIL, "clusters > 0", "{clusters} cluster(s) share a title or h1."), (PASS, "true", "{read} page(s) share no title or h1."),
    )


@site("metadata-completeness")
def metadata_completeness(audit: Audit) -> DataFrame:
    listed = audit.sitemap_urls.select("crawl_id", "normalized_url").distinct().withColumn("listed", F.lit(True))
    index = "rlike({}, '(?i)(^|[\\\\s,:])index\\\\b')"
    header, meta = "coalesce(f.headers['x-robots-tag'], '')", "coalesce(x.meta_robots, '')"
    no = "rlike({}, '(?i)\\\\bnoindex\\\\b|\\\\bnone\\\\b')"
    html = audit.facts.where("html_200")
    aliases = by_url(audit, "true as alias").withColumnRenamed("target", "landed")
    rows = html.selectExpr(
        "crawl_id", "normalized_url", "f.final_url as landed", "kept_out", f"({no.format(meta)} and {index.format(header)}) or ({no.format(header)} and {index.format(meta)}) as split", "x.canonical_target as target",
        "f.truncated as cut", "trim(coalesce(x.title, '')) = '' as titleless", "coalesce(x.meta_description, '') = '' or not exists(x.headings, h -> h.level = 1) or x.canonical is null as gap",
    )
    rows = rows.join(aliases, ["crawl_id", "landed"], "left").where("landed = normalized_url or alias is null")
    onto = by_url(audit, "f.status as t_status", "f.error as t_error", "hops as t_hops", "kept_out as t_out", "f.final_url as t_landed")
    landing = by_url(audit, "x.canonical_target as l_canonical").withColumnRenamed("target", "t_landed")
    joined = rows.join(listed, ["crawl_id", "normalized_url"], "left").join(onto, ["crawl_id", "target"], "left").join(landing, ["crawl_id", "t_landed"], "left")
    why = "t_error is null and t_status is not null and (t_hops > 0 or t_status >= 400 or t_out)"
    away = "target is not null and target <> landed"
    turns = "(t_landed = landed or (t_landed <> target and l_canonical = target))"
    barred = audit.blocked.selectExpr("crawl_id", "url as normalized_url").join(listed, ["crawl_id", "normalized_url"])
    return judged(
        "metadata-completeness", audit,
        [
            (html, {"html_pages": "count(*)"}),
            (joined, {
                "conflicts": f"count_if(split) + count_if(kept_out and listed) + count_if(kept_out and {away}) + count_if(not kept_out and {away} and {why} and not coalesce({turns}, false))",
                "varying": f"count_if(not kept_out and {away} and {why} and {turns})", "indexable": "count_if(not kept_out)", "cut": "count_if(not kept_out and cut)",
                "titleless": "count_if(not kept_out and not cut and titleless)", "gaps": "count_if(not kept_out and not cut and gap)",
            }),
            (barred, {"barred": "count(*)"}),
        ],
        (NA, "html_pages = 0", "No HTML pages answered 200."),
        (FAIL, "conflicts + barred > 0 or titleless > 0", "{conflicts + barred} indexation conflict(s), {titleless} page(s) without title."),
        (PASS, "indexable = 0", "No conflicts; all pages are noindex."),
        (ERROR, "cut = indexable", "All indexable pages were cut."),
        (WARN, "varying > 0", "{varying} canonical(s) redirect by visitor."),
        (WARN, "gaps > 0", "{gaps} of {indexable} page(s) lack a description, h1 or canonical."),
        (WARN, "cut > 0", "{cut} page(s) were cut."),
        (PASS, "true", "All {indexable} indexable page(s) carry their metadata."),
    )


@site("raw-rendered-crawl-diff")
def raw_rendered_crawl_diff(audit: Audit) -> DataFrame:
    shown = audit.facts.where("r is not null")
    good = shown.where("r.error is null and r.extracted is not null and x is not null")
    raw = audit.facts.where("x is not null").selectExpr("crawl_id", "site_netloc", "explode(x.links) as l").where(same_site("l.url")).selectExpr("crawl_id", "l.target as target")
    after = good.selectExpr("crawl_id", "site_netloc", "explode(r.extracted.links) as l").where(same_site("l.url") + " and l.target is not null").selectExpr("crawl_id", "l.target as target").distinct()
    return judged(
        "raw-rendered-crawl-diff", audit,
        [
            (shown, {"rendered": "count(*)"}),
            (good, {"compared": "count(*)", "differ": "count_if((r.final_url is not null and r.final_url <> f.final_url) or (r.status is not null and r.status <> f.status))"}),
            (after.join(raw, ["crawl_id", "target"], "left_anti"), {"only_after": "count(*)"}),
        ],
        (NA, "rendered = 0", "No page was rendered."),
        (ERROR, "compared = 0", "No render could be compared."),
        (FAIL, "differ > 0", "{differ} page(s) land elsewhere when rendered."),
        (WARN, "only_after > 0", "{only_after} target(s) are linked only after rendering."),
        (PASS, "true", "{compared} rendered page(s) agree with the raw crawl."),
    )


# ---- structured data


@site("schema-eligibility-matrix")
def schema_eligibility_matrix(audit: Audit) -> DataFrame:
    #: fixed values: required properties, one of which is enough, and the property that must be visible
    rules = {
        "Article": ("headline", "", "headline"), "NewsArticle": ("headline", "", "headline"), "BlogPosting": ("headline", "", "headline"),
        "Product": ("name", "offers review aggregateRating", "name"), "ProductGroup": ("name", "", "name"), "Event": ("name startDate location", "", "name"),
        "Recipe": ("name image", "", "name"), "Course": ("name description", "", "name"), "VideoObject": ("name thumbnailUrl uploadDate", "", "name"),
        "JobPosting": ("title description datePosted hiringOrganization", "", "title"), "BreadcrumbList": ("itemListElement", "", ""), "Organization": ("name", "", ""),
        "LocalBusiness": ("name address", "", ""), "WebSite": ("name", "", ""), "FAQPage": ("mainEntity", "", ""), "HowTo": ("name step", "", ""),
    }
    told = audit.spark.createDataFrame([(t, r.split(), o.split(), s or None) for t, (r, o, s) in rules.items()], "type string, required array<string>, one_of array<string>, subject string")
    html = audit.facts.where("is_html")
    nodes = html.selectExpr("crawl_id", "normalized_url", "lower(regexp_replace(concat(coalesce(x.title, ''), ' ', x.text), '(?U)\\\\s+', ' ')) as visible", "explode(x.json_ld_nodes) as node")
    loose = html.selectExpr("crawl_id", "explode(x.json_ld_nodes) as node").where("size(node.types) > 0 and not node.schema_context")
    typed = nodes.selectExpr("crawl_id", "visible", "node.json as json", "explode(node.types) as type").join(F.broadcast(told), "type")
    has = "not coalesce(trim(get_json_object(json, concat('$.', p))), '') in ('', '[]', 'null')"
    claim = "get_json_object(json, concat('$.', subject))"
    defects = typed.selectExpr(
        "crawl_id", f"int(exists(required, p -> not ({has}))) + int(size(one_of) > 0 and not exists(one_of, p -> {has})) "
        f"+ int(coalesce(length(trim({claim})) >= 3 and not startswith({claim}, '{{') and not startswith({claim}, '[') and instr(visible, lower(regexp_replace(trim({claim}), '(?U)\\\\s+', ' '))) = 0, false)) as defects",
        "type in ('FAQPage', 'HowTo') as retired",
    )
    return judged(
        "schema-eligibility-matrix", audit,
        [
            (html, {"html_pages": "count(*)", "marked": "count_if(size(x.json_ld_nodes) > 0)", "unparsed": "count_if(x.json_ld_errors > 0)"}),
            (loose, {"loose": "count(*)"}),
            (defects, {"defects": "sum(defects)", "retired": "count_if(retired)"}),
        ],
        (NA, "not array_contains(flags, 'structured-data')", "The site does not claim structured data."), _NO_PAGES,
        (FAIL, "defects + loose + unparsed > 0", "{defects + loose + unparsed} structured-data defect(s)."),
        (FAIL, "marked = 0", "None of {html_pages} page(s) carries structured data."),
        (WARN, "retired > 0", "{retired} node(s) use a type without rich results."),
        (PASS, "true", "{marked} of {html_pages} page(s) carry sound structured data."),
    )


_ECOMMERCE: Rung = (NA, "not array_contains(flags, 'ecommerce')", "The site does not claim a product catalogue.")


@site("product-variant-canonical")
def product_variant_canonical(audit: Audit) -> DataFrame:
    html = audit.facts.where("html_200").withColumn("route", F.expr(ROUTE.format("normalized_url")))
    products = html.where(_PRODUCT).select("crawl_id", "route").distinct()
    members = html.join(products, ["crawl_id", "route"], "left_semi").selectExpr("crawl_id", "route", "normalized_url", "any_noindex", "x.canonical as canonical", "x.canonical_target as target", "nullif(x.title, '') as title")
    titled = members.where("not any_noindex and title is not null").groupBy("crawl_id", "route", "title").agg(F.count("*").alias("n")).groupBy("crawl_id", "route").agg(F.max("n").alias("alike"))
    families = members.groupBy("crawl_id", "route").agg(
        F.count("*").alias("members"), F.expr("count_if(not any_noindex)").alias("indexable"), F.expr("count_if(not any_noindex and canonical is null)").alias("missing"),
        F.expr("count_if(not any_noindex and canonical is not null and target is null)").alias("unusable"), F.expr("count_if(not any_noindex and target <> normalized_url)").alias("elsewhere"),
        F.expr("count(distinct if(any_noindex, null, target))").alias("targets"), F.expr("min(if(any_noindex, null, target))").alias("target"),
    ).where("members > 1")
    judged_ = families.join(titled, ["crawl_id", "route"], "left").join(by_url(audit, "f.status as status", "any_noindex as hidden", "true as onto"), ["crawl_id", "target"], "left")
    problem = (
        "indexable >= 2 and (missing > 0 or unusable > 0 or (elsewhere = 0 and coalesce(alike, 0) > 1) "
        "or (elsewhere > 0 and targets = 1 and coalesce(onto and (status is null or status <> 200 or hidden), false)) or (elsewhere > 0 and targets > 1))"
    )
    return judged(
        "product-variant-canonical", audit, [(html.where(_PRODUCT), {"products": "count(*)"}), (judged_, {"families": "count(*)", "problems": f"count_if({problem})"})],
        _ECOMMERCE, (NA, "products = 0", "No product pages."), (NA, "families = 0", "No product at more than one address."),
        (FAIL, "problems > 0", "{problems} of {families} product(s) follow no one canonical rule."), (PASS, "true", "All {families} product(s) follow one canonical rule."),
    )


@site("product-lifecycle-state")
def product_lifecycle_state(audit: Audit) -> DataFrame:
    states = "coalesce(x.derived.product.availability, array())"
    life = (
        f"case when arrays_overlap({states}, array('instock', 'instoreonly', 'onlineonly', 'limitedavailability', 'preorder', 'presale', 'backorder')) then 'available' "
        f"when arrays_overlap({states}, array('outofstock', 'soldout')) then 'withdrawn' when array_contains({states}, 'discontinued') then 'retired' end"
    )
    treat = f"case when any_noindex then 'excluded' when x.canonical_target is not null and {ROUTE.format('x.canonical_target')} <> {ROUTE.format('normalized_url')} then 'consolidated' else 'kept' end"
    listed = audit.sitemap_urls.select("crawl_id", "normalized_url").distinct().withColumn("listed", F.lit(True))
    rows = audit.facts.where(f"html_200 and {_PRODUCT}").selectExpr("crawl_id", "normalized_url", f"{life} as life", f"{treat} as treatment").join(listed, ["crawl_id", "normalized_url"], "left")
    return judged(
        "product-lifecycle-state", audit,
        [(rows, {
            "products": "count(*)", "declared": "count(life)", "gone": "count_if(life <> 'available')", "withdrawn_out": "count_if(life = 'withdrawn' and treatment <> 'kept')",
            "contradicted": "count_if(life = 'retired' and treatment = 'excluded' and listed)", "ways": "count(distinct if(life = 'retired', treatment, null))",
        })],
        _ECOMMERCE, (NA, "products = 0", "No product pages."), (NA, "declared = 0", "No product declares availability."), (NA, "gone = 0", "All products are for sale."),
        (FAIL, "withdrawn_out > 0 or contradicted > 0 or ways > 1", "{withdrawn_out} withdrawn product(s) not kept, {contradicted} contradicted, retired ones handled {ways} way(s)."),
        (PASS, "true", "All {gone} product(s) not for sale are handled deliberately."),
    )


@site("product-schema")
def product_schema(audit: Audit) -> DataFrame:
    p = "x.derived.product"
    rows = audit.facts.where(f"html_200 and {_PRODUCT}").selectExpr(
        "crawl_id",
        f"if({p} is null, 1, int(not {p}.name) + int(size({p}.offers) = 0 and not {p}.review) + size(filter({p}.offers, o -> not o.has_price or not o.has_currency))) as failures",
        f"if({p} is null, 0, size(filter({p}.offers, o -> not o.has_availability)) + int(not {p}.image) + int(not {p}.identifier)) as gaps",
    )
    return judged(
        "product-schema", audit, [(rows, {"products": "count(*)", "failures": "sum(failures)", "gaps": "sum(gaps)"})],
        _ECOMMERCE, (NA, "products = 0", "No product pages."), (FAIL, "failures > 0", "{failures} required-field defect(s)."), (WARN, "gaps > 0", "{gaps} recommended-field gap(s)."),
        (PASS, "true", "All {products} product page(s) carry complete markup."),
    )


@site("paywall-access-model")
def paywall_access_model(audit: Audit) -> DataFrame:
    one = "int(n.access = 'invalid') + int(size(n.parts) > 0 and n.access = 'absent') + aggregate(n.parts, 0, (t, p) -> t + int(not p.selector) + int(p.access in ('absent', 'invalid')))"
    rows = audit.facts.where("html_200 and size(x.derived.paywall) > 0").selectExpr("crawl_id", f"aggregate(x.derived.paywall, 0, (s, n) -> s + {one}) as issues")
    return judged(
        "paywall-access-model", audit, [(rows, {"declared": "count(*)", "issues": "sum(issues)"})],
        (NA, "not array_contains(flags, 'paywall')", "The site does not claim a paywall."), (NA, "declared = 0", "No page declares its access."),
        (FAIL, "issues > 0", "{issues} paywall markup defect(s)."), (PASS, "true", "All {declared} page(s) carry complete markup."),
    )


@site("review-integrity")
def review_integrity(audit: Audit) -> DataFrame:
    rows = audit.facts.where("html_200").selectExpr("crawl_id", "explode(x.derived.reviews) as v")
    return judged(
        "review-integrity", audit, [(rows, {"reviews": "count(*)", "bad": "count_if(v.own or not v.author or v.rating_without_count)", "undated": "count_if(not v.dated)"})],
        (NA, "reviews = 0", "No reviews are marked up."), (FAIL, "bad > 0", "{bad} review(s) are of the site itself, anonymous, or ratings without ratings."),
        (WARN, "undated > 0", "{undated} review(s) carry no date."), (PASS, "true", "{reviews} review(s) are sound."),
    )


@site("publisher-discover-readiness")
def publisher_discover_readiness(audit: Audit) -> DataFrame:
    rows = audit.facts.where(f"html_200 and {IS_ARTICLE}").selectExpr(
        "crawl_id", "x.open_graph['og:image'] is null as missing", "try_cast(regexp_extract(x.open_graph['og:image:width'], '^\\\\s*([0-9]+)', 1) as int) < 1200 as small",
        "lower(regexp_extract(concat(coalesce(x.meta_robots, ''), ' ', coalesce(f.headers['x-robots-tag'], '')), '(?i)max-image-preview:\\\\s*([^\\\\s,]+)', 1)) as preview",
    )
    return judged(
        "publisher-discover-readiness", audit, [(rows, {"articles": "count(*)", "bad": "count_if(not missing and (coalesce(small, false) or preview not in ('', 'large')))", "missing": "count_if(missing)"})],
        (NA, "articles = 0", "No article pages."), (FAIL, "bad > 0", "{bad} article(s) opt out of large previews."), (WARN, "missing > 0", "{missing} of {articles} article(s) declare no og:image."),
        (PASS, "true", "All {articles} article(s) are eligible."),
    )


@site("analytics-implementation")
def analytics_implementation(audit: Audit) -> DataFrame:
    source = "array_join(transform(x.script_tags, s -> concat(coalesce(s.src, ''), ' ', s.text)), ' ')"
    ids = f"array_sort(array_distinct(regexp_extract_all({source}, '\\\\b(G-[A-Z0-9]{{6,}}|GTM-[A-Z0-9]{{5,}}|UA-[0-9]+-[0-9]+)\\\\b', 1)))"
    tags = "filter(transform(x.script_tags, s -> s.src), u -> rlike(u, 'googletagmanager[.]com/(gtag/js|gtm[.]js)'))"
    rows = audit.facts.where("html_200").selectExpr("crawl_id", f"array_join({ids}, ',') as ids", f"size({tags}) > size(array_distinct({tags})) as twice")
    return judged(
        "analytics-implementation", audit, [(rows, {"html_pages": "count(*)", "sets": "count(distinct ids)", "tagged": "count_if(ids <> '')", "twice": "count_if(twice)"})],
        _NO_PAGES, (WARN, "tagged = 0", "No page carries a tag."), (FAIL, "twice > 0", "{twice} page(s) load one tag twice."), (FAIL, "sets > 1", "Pages carry {sets} different sets of ids."),
        (PASS, "true", "All pages carry the same ids."),
    )


# ---- hosts, crawlers, protocol


@site("host-redirect")
def host_redirect(audit: Audit) -> DataFrame:
    from lodestar.functions import url as U
    from lodestar.functions.extract import with_extracted

    variants = audit.auxiliary.where("reason = 'host-variant'").selectExpr("crawl_id", "fetch.error as error", "fetch.status as status", "fetch.final_url as url", "size(fetch.redirect_chain) as hops", "nullif(fetch.body, '') as html")
    rows = with_extracted(variants).withColumn("landed", U.normalized(F.col("url")))
    ok = "error is null and status is not null"
    return judged(
        "host-redirect", audit,
        [(rows, {
            "tested": "count(*)", "answered": f"count_if({ok})", "broken": f"count_if({ok} and status >= 400)", "insecure": f"count_if({ok} and not startswith(url, 'https://'))",
            "places": f"count(distinct if({ok}, landed, null))", "canonicals": f"count(distinct if({ok}, extracted.canonical_target, null))", "undeclared": f"count_if({ok} and extracted.canonical_target is null)",
            "long": f"count_if({ok} and hops > 1)",
        })],
        (NA, "tested = 0", "No variants to test."), (NA, "answered = 0", "No variant answered."), (FAIL, "broken > 0", "{broken} variant(s) answered with an error."),
        (FAIL, "insecure > 0", "{insecure} variant(s) end on http."), (WARN, "places > 1 and canonicals = 1 and undeclared = 0", "Variants land on {places} URLs of one canonical."),
        (FAIL, "places > 1", "Variants land on {places} URLs."), (WARN, "long > 0", "{long} variant(s) take several hops."), (WARN, "answered < tested", "{tested - answered} variant(s) did not resolve."),
        (PASS, "true", "All {tested} variants reach one HTTPS URL."),
    )


@site("favicon-site-name")
def favicon_site_name(audit: Audit) -> DataFrame:
    html = audit.facts.where("html_200")
    icons = audit.auxiliary.where("reason = 'icon'").selectExpr("crawl_id", "fetch")
    size = F.pandas_udf(_icon_sizes, "struct<width:double,height:double>")
    rows = icons.withColumn("size", size("fetch.body", "fetch.content_type"))
    return judged(
        "favicon-site-name", audit,
        [
            (html, {"html_pages": "count(*)", "icons": "min_by(size(x.icons), struct(depth, ordinal))", "names": "count(distinct x.derived.site_name)"}),
            (rows, {
                "fetched": "count(*)", "missing": "count_if(fetch.error is not null or fetch.status is null or fetch.status <> 200)",
                "no_image": "count_if(not startswith(lower(coalesce(fetch.content_type, '')), 'image/'))", "measured": "count(size.width)", "oblong": "count_if(size.width <> size.height)",
            }),
        ],
        _NO_PAGES, (FAIL, "icons = 0", "The root declares no icon."), (FAIL, "names = 0", "No site name is declared."), (FAIL, "names > 1", "Pages disagree about the site name."),
        (WARN, "fetched = 0", "No icon was fetched."), (FAIL, "missing > 0", "{missing} icon(s) do not resolve."), (FAIL, "no_image > 0", "{no_image} icon(s) are no images."),
        (FAIL, "oblong > 0", "{oblong} icon(s) are not square."), (WARN, "measured = 0", "No icon could be measured."), (PASS, "true", "One site name, {measured} square icon(s)."),
    )


def _icon_sizes(body, kind):  # noqa: ANN001, ANN202
    import pandas as pd

    from lodestar.functions.images import icon_size

    sizes = [icon_size(b, k) for b, k in zip(body, kind, strict=True)]
    return pd.DataFrame({"width": [s[0] if s else None for s in sizes], "height": [s[1] if s else None for s in sizes]}, dtype="float64")


@site("ai-crawler-directive-verify")
def ai_crawler_directive_verify(audit: Audit) -> DataFrame:
    #: fixed values: names in robots.txt that no request carries; agents that act for a user
    tokens = ("Google-Extended", "Applebot-Extended")
    users = ("ChatGPT-User", "Perplexity-User", "Claude-User", "MistralAI-User")
    stances = audit.site_facts.where("ai_policy is not null").selectExpr("crawl_id", "origin", "robots_txt", "explode(ai_policy) as (agent, stance)")
    allowed = stances.withColumn("ok", F.element_at(R.allowed_each(F.col("robots_txt"), F.col("agent"), F.array(F.concat(F.regexp_extract("origin", r"^(https?://[^/?#]+)", 1), F.lit("/")))), 1))
    tests = audit.auxiliary.where("reason = 'user-agent-test'").selectExpr("crawl_id", "agent", "fetch.status as status").join(stances.select("crawl_id", "agent", "stance"), ["crawl_id", "agent"], "left")
    names = ", ".join(map(repr, tokens))
    return judged(
        "ai-crawler-directive-verify", audit,
        [
            (allowed, {"agents": "count(*)", "contradicted": "count_if(ok <> (stance = 'allow'))", "testable": f"count_if(agent not in ({names}))"}),
            (tests, {"tests": "count(*)", "turned_away": "count_if(stance = 'allow' and status in (401, 403, 429))", "served": f"count_if(stance = 'disallow' and agent in ({', '.join(map(repr, users))}) and status < 400)"}),
        ],
        (NA, "ai_policy is null", "No policy is recorded."), (NA, "agents = 0", "The policy names no crawlers."), (FAIL, "contradicted > 0", "robots.txt contradicts the policy for {contradicted} crawler(s)."),
        (FAIL, "turned_away > 0", "{turned_away} allowed crawler(s) are turned away."), (WARN, "served > 0", "{served} disallowed user-directed agent(s) were served."),
        (WARN, "testable > 0 and tests = 0", "No simulated request was made."), (PASS, "true", "robots.txt and requests agree with the policy for {agents} crawler(s)."),
    )


def _root(audit: Audit) -> DataFrame:
    """Per crawl, the shallowest page."""
    return audit.pages.groupBy("crawl_id").agg(F.expr("min_by(named_struct('status', fetch.status, 'error', fetch.error, 'url', fetch.final_url, 'alt_svc', fetch.headers['alt-svc']), struct(depth, ordinal))").alias("root"))


@site("http-version")
def http_version(audit: Audit) -> DataFrame:
    h3 = "rlike(coalesce(root.alt_svc, ''), '(?i)(^|,)\\\\s*h3(-[0-9]+)?\\\\s*=')"
    return observed(
        audit.site_facts.join(_root(audit), "crawl_id", "left"), "http-version",
        [
            (ERROR, "root is null or root.error is not null or root.status is null", "The root could not be fetched."),
            (WARN, "not startswith(root.url, 'https://')", "Served over plain HTTP."), (PASS, "protocol.alpn = 'h2'", "Negotiates HTTP/2."), (PASS, h3, "Advertises HTTP/3."),
            (ERROR, "protocol is null", "No handshake was recorded."), (ERROR, "protocol.error is not null", "The handshake failed: {protocol.error}."), (WARN, "true", "Only HTTP/1.1 is offered."),
        ],
    )


@site("domain-expiry-rdap")
def domain_expiry_rdap(audit: Audit) -> DataFrame:
    host = "regexp_extract(root.url, '^https?://([^/:?#]+)', 1)"
    expires = WHEN.format("rdap.expires_at")
    return observed(
        audit.site_facts.join(_root(audit), "crawl_id", "left"), "domain-expiry-rdap",
        [
            (NA, f"rdap is null and root is not null and (not contains({host}, '.') or rlike({host}, '^[0-9.]+$'))", "The host has no registrable domain."),
            (ERROR, "rdap is null", "No lookup was recorded."), (ERROR, "rdap.error is not null", "The lookup failed: {rdap.error}."),
            (FAIL, "exists(rdap.statuses, s -> lower(s) in ('pending delete', 'redemption period'))", "The domain is being deleted."),
            (ERROR, f"rdap.expires_at is null or {expires} is null", "No readable expiration date."), (FAIL, f"{expires} < rdap.fetched_at", "The domain expired."),
            (WARN, f"{expires} <= rdap.fetched_at + interval 30 days", "The domain expires within 30 days."), (PASS, "true", "The domain expires {rdap.expires_at}."),
        ],
    )


def regressed(audit: Audit, now: DataFrame) -> DataFrame:
    """(probe_id, page_url) that passed in the previous audit, with today's outcome."""
    before = audit.previous_probes.selectExpr("crawl_id", "probe_id", "coalesce(page_url, '') as page", "outcome as earlier").dropDuplicates(["crawl_id", "probe_id", "page"])
    return now.selectExpr("crawl_id", "probe_id", "coalesce(page_url, '') as page", "outcome").join(before, ["crawl_id", "probe_id", "page"])


#: detectors that read the observations of all others
AFTER: dict[str, Callable[[Audit, DataFrame], DataFrame]] = {}


def after(name: str) -> Callable[[Callable[[Audit, DataFrame], DataFrame]], Callable[[Audit, DataFrame], DataFrame]]:
    def register(run: Callable[[Audit, DataFrame], DataFrame]) -> Callable[[Audit, DataFrame], DataFrame]:
        AFTER[name] = run
        return run

    return register


@after("quarterly-regression-crawl")
def quarterly_regression_crawl(audit: Audit, now: DataFrame) -> DataFrame:
    rows = regressed(audit, now)
    dated = audit.previous_probes.select("crawl_id").distinct().withColumn("previous", F.lit(True))
    out = tally(audit, (rows, {"compared": "count(*)", "regressions": "count_if(earlier = 'pass' and outcome = 'fail')"})).join(dated, "crawl_id", "left")
    return observed(
        out, "quarterly-regression-crawl",
        [(NA, "previous is null", "There is no previous audit."), (FAIL, "regressions > 0", "{regressions} observation(s) regressed."), (PASS, "true", "{compared} observation(s) compared, none regressed.")],
    )


@after("conditional-template-monitor")
def conditional_template_monitor(audit: Audit, now: DataFrame) -> DataFrame:
    from lodestar.functions.url import path_template

    rows = regressed(audit, now).where("page <> '' and earlier = 'pass' and outcome in ('pass', 'warn', 'fail')").withColumn("template", path_template(F.col("page")))
    groups = rows.groupBy("crawl_id", "probe_id", "template").agg(F.count("*").alias("compared"), F.expr("count_if(outcome = 'fail')").alias("worse"))
    out = tally(audit, (audit.previous_probes, {"known": "count(*)"}), (groups, {"judged": "count_if(compared >= 2)", "systemic": "count_if(compared >= 2 and worse * 2 >= compared)"}))
    return observed(
        out, "conditional-template-monitor",
        [(NA, "known = 0", "There is no previous audit."), (FAIL, "systemic > 0", "{systemic} template(s) regressed as a whole."), (PASS, "true", "No template regressed as a whole ({judged} judged).")],
    )


__all__ = ["AFTER", "NOINDEX", "SITE", "Window", "judged", "site", "tally"]
