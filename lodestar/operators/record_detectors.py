"""Detectors that set person-supplied records against the crawl.

A missing record is not applicable.  A record without an owner, or due for review
before the crawl, is held: it can fail, but not pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import fixed as X
from lodestar.functions import robots as R
from lodestar.functions import scalars as S
from lodestar.functions import url as U
from lodestar.operators.audit import NETLOC, NOINDEX_OR_NONE, Audit
from lodestar.operators.ladder import ERROR, FAIL, NA, PASS, WARN, Rung, observed
from lodestar.operators.page_detectors import IS_ARTICLE
from lodestar.operators.site_detectors import WHEN, by_url, judged, site, tally
from lodestar.sources.scratch import written

#: SQL: why a record is held; null if it is not
HELD = "case when trim(coalesce(rec.owner, '')) = '' then 'no owner' when rec.next_review_at < crawled_at then 'its review is due' end"
Parts = list[tuple[DataFrame, dict[str, str]]]


def recorded(audit: Audit, section: str) -> DataFrame:
    """(crawl_id, rec): a section's record."""
    rows = audit.met(audit.given(section))
    return rows.select("crawl_id", F.struct(*[c for c in rows.columns if c != "crawl_id"]).alias("rec"))


def entries(audit: Audit, section: str, array: str) -> DataFrame:
    """(crawl_id, e): a record's entries, one row each: those of its list, and of the
    table that holds them where there is one."""
    listed = recorded(audit, section).selectExpr("crawl_id", f"explode(rec.{array}) as e")
    table = audit.rows.get(f"{section}.{array}")
    if table is None:
        return listed
    fields = [f.name for f in listed.schema["e"].dataType]
    return listed.unionByName(table.select("crawl_id", F.struct(*fields).alias("e")))


def on_record(name: str, section: str, parts: Parts, audit: Audit, *rungs: Rung) -> DataFrame:
    """Rungs before the hold rule fail; those marked by None's place come after it."""
    rows = tally(audit, *parts).join(recorded(audit, section), "crawl_id", "left").withColumn("held", F.expr(HELD))
    return observed(rows, name, [(NA, "rec is null", "No record was supplied."), *rungs])


HOLD: Rung = (WARN, "held is not null", "The record is held: {held}.")


def found_at(audit: Audit, rows: DataFrame, url: str, *columns: str) -> DataFrame:
    """Rows met with the page at their URL (null columns where none was crawled)."""
    keyed = rows.withColumn("target", F.coalesce(U.normalized(F.expr(url)), F.expr(url)))
    return keyed.join(by_url(audit, "true as crawled", "f.status as status", "kept_out", "any_noindex", *columns), ["crawl_id", "target"], "left")


# ---- records judged on their own


def simple(name: str, section: str, sums: dict[str, str], *rungs: Rung, array: str | None = None) -> None:
    """A detector over a record's entries (or the record) alone."""

    @site(name)
    def run(audit: Audit) -> DataFrame:
        parts: Parts = [(entries(audit, section, array), sums)] if array else []
        return on_record(name, section, parts, audit, *rungs)


simple(
    "ci-seo-guards", "ci_guard", {},
    (FAIL, "size(array_except(array('noindex', 'canonical', 'robots', 'critical-link'), transform(rec.caught, c -> lower(c)))) > 0 or not rec.clean_passed", "A seeded defect was not caught, or a clean build did not pass."),
    HOLD, (PASS, "true", "All seeded defects were caught, and a clean run passed."),
)
simple(
    "ci-extended-checks", "ci_rules", {"n": "count(*)", "loose": "count_if(trim(coalesce(e.owner, '')) = '' or trim(coalesce(e.severity, '')) = '' or e.false_positive_rate > 0.1)"},
    (NA, "n = 0", "No rules."), (WARN, "loose > 0", "{loose} of {n} rule(s) are held."), HOLD, (PASS, "true", "{n} rule(s) are sound."), array="rules",
)
simple(
    "inherited-domain-history", "domain_history", {"open": "count_if(not e.resolved)", "manual": "count_if(contains(lower(e.kind), 'manual'))", "archive": "count_if(rlike(lower(e.kind), 'archive|wayback'))"},
    (FAIL, "open > 0 or manual = 0 or archive = 0", "{open} issue(s) open, or a required check is missing."), HOLD, (PASS, "true", "The history was checked, nothing is open."), array="checks",
)
simple(
    "security-manual-actions", "search_console", {},
    (FAIL, "size(rec.manual_actions) > 0 or size(rec.security_issues) > 0", "Open: {coalesce(size(rec.manual_actions), 0)} manual action(s), {coalesce(size(rec.security_issues), 0)} security issue(s)."),
    (WARN, "rec.manual_actions is null or rec.security_issues is null", "A report is missing."),
    (WARN, "coalesce(rec.issues_checked_at, rec.recorded_at) < crawled_at - interval 30 days", "The reports are over 30 days old."),
    HOLD, (PASS, "true", "No manual action and no security issue."),
)
simple(
    "backlink-monitor", "disavow", {},
    (PASS, "not rec.submitted", "No disavow file was submitted."),
    (FAIL, "trim(coalesce(rec.reasons, '')) = '' or trim(coalesce(rec.attempts, '')) = ''", "Submitted without reasons or removal attempts."),
    HOLD, (PASS, "true", "Reasons and attempts are on record."),
)
simple(
    "ai-visibility-baseline", "ai_baseline",
    {
        "n": "count(*)", "unread": "count_if(regexp_extract(e.period, '^\\\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) = '')",
        "invented": "count_if(try_cast(nullif(regexp_extract(e.period, '^\\\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') as date) < try_cast(left(e.available_from, 10) as date))",
        "mixed": "count_if(size(array_distinct(regexp_extract_all(lower(e.engine), '\\\\b(google|gemini|bing|copilot|chatgpt|openai|perplexity|claude|anthropic|meta ai|grok)\\\\b', 1))) > 1 or rlike(e.engine, '(?i)\\\\b(combined|blended|composite|aggregated?|unified|all engines|all ai|cross-engine|overall|total)\\\\b'))",
    },
    (FAIL, "invented > 0", "{invented} report(s) claim history before their tool recorded it."), (FAIL, "mixed > 0", "{mixed} report(s) mix engines."), (WARN, "n = 0", "No reports."),
    (WARN, "unread > 0", "{unread} period(s) are no date range."), HOLD, (PASS, "true", "{n} report(s) are per engine and honest."), array="entries",
)


@site("analytics-reconciliation")
def analytics_reconciliation(audit: Audit) -> DataFrame:
    rows = entries(audit, "analytics", "reported").withColumn("gap", S.figure_gap(F.col("e.a"), F.col("e.b"))).withColumn("open", F.expr("gap > 0.1 and e.explanation is null"))
    return on_record(
        "analytics-reconciliation", "analytics", [(rows, {"n": "count(*)", "unexplained": "count_if(open)", "drifting": "count_if(gap > 0.05 and not open)"})], audit,
        (NA, "n = 0", "No reported figures."), (FAIL, "unexplained > 0", "{unexplained} pair(s) are over 10% apart."), (WARN, "drifting > 0", "{drifting} pair(s) are over 5% apart."), HOLD, (PASS, "true", "All {n} pair(s) agree."),
    )


simple(
    "monitoring-incident-sla", "incidents", {"n": "count(*)", "loose": "count_if(trim(coalesce(e.owner, '')) = '' or trim(coalesce(e.remediation, '')) = '')"},
    (FAIL, "loose > 0", "{loose} incident(s) have no owner or remediation."), HOLD, (PASS, "true", "{n} incident(s) are owned and remedied."), array="entries",
)
simple(
    "digital-pr-tracking", "digital_pr", {"n": "count(*)", "bad": "count_if(e.paid or trim(coalesce(e.owner, '')) = '')"},
    (FAIL, "bad > 0", "{bad} win(s) are paid or unowned."), (WARN, "n = 0", "No wins."), HOLD, (PASS, "true", "{n} win(s), earned and owned."), array="wins",
)


@site("offpage-reputation-governance")
def offpage_reputation_governance(audit: Audit) -> DataFrame:
    rows = entries(audit, "review_destinations", "entries").join(audit.site_facts.select("crawl_id", "crawled_at"), "crawl_id")
    return on_record(
        "offpage-reputation-governance", "review_destinations", [(rows, {"n": "count(*)", "lapsed": "count_if(e.next_check_at < crawled_at)", "unowned": "count_if(trim(coalesce(e.owner, '')) = '')"})], audit,
        (FAIL, "lapsed > 0", "{lapsed} destination(s) are due for a check."), (WARN, "n = 0 or unowned > 0", "{unowned} destination(s) are unowned, or there are none."), HOLD, (PASS, "true", "{n} destination(s) are checked and owned."),
    )


@site("competitor-serp-baseline")
def competitor_serp_baseline(audit: Audit) -> DataFrame:
    rows = entries(audit, "competitors", "entries").join(audit.site_facts.select("crawl_id", "site_netloc"), "crawl_id")
    own = "lower(regexp_replace(regexp_replace(e.competitor, '^https?://', ''), '^www[.]|/.*$', '')) = regexp_replace(site_netloc, '^www[.]', '')"
    return on_record(
        "competitor-serp-baseline", "competitors",
        [(rows, {"n": "count(*)", "blank": "count_if(trim(coalesce(e.keyword, '')) = '' or trim(coalesce(e.competitor, '')) = '' or trim(coalesce(e.url, '')) = '')", "own": f"count_if({own})"})], audit,
        (FAIL, "n = 0 or blank > 0 or own > 0", "{n} competitor(s), {blank} with blanks, {own} the site itself."), HOLD, (PASS, "true", "{n} competitor(s) are on record."),
    )


@site("security-dependency-maintenance")
def security_dependency_maintenance(audit: Audit) -> DataFrame:
    banner = "rlike({}, '/\\\\s*v?[0-9]|\\\\b[0-9]+[.][0-9]+')"
    banners = audit.facts.selectExpr("crawl_id", "explode(array_compact(array(concat('server: ', f.headers['server']), concat('x-powered-by: ', f.headers['x-powered-by'])))) as line").where(banner.format("line"))
    critical = "e.fixed_at is null and e.severity = 'critical'"
    return on_record(
        "security-dependency-maintenance", "vulnerabilities",
        [(entries(audit, "vulnerabilities", "entries"), {"n": "count(*)", "critical": f"count_if({critical})", "unowned": f"count_if({critical} and trim(coalesce(e.owner, '')) = '')"}), (banners, {"banners": "count(distinct line)"})], audit,
        (FAIL, "unowned > 0", "{unowned} unfixed critical vulnerability(ies) have no owner."), (WARN, "critical > 0 or banners > 0", "{critical} critical unfixed, {banners} header(s) name a version."), HOLD,
        (PASS, "true", "{n} vulnerability(ies) tracked, no unfixed critical."),
    )


@site("field-cwv-monitor")
def field_cwv_monitor(audit: Audit) -> DataFrame:
    each = entries(audit, "crux", "populations").selectExpr("crawl_id", "e.actions as actions", "stack(3, 'lcp', e.lcp_ms, 'inp', e.inp_ms, 'cls', e.cls) as (metric, p75)")
    each = each.withColumn("grade", S.field_grade(F.col("metric"), F.col("p75")))
    owned = "exists(actions, a -> a.metric = metric and trim(coalesce(a.owner, '')) <> '')"
    return on_record(
        "field-cwv-monitor", "crux", [(each, {"n": "count(*)", "missing": "count_if(p75 is null)", "unanswered": f"count_if(grade = 'poor' and not coalesce({owned}, false))"})], audit,
        (FAIL, "unanswered > 0", "{unanswered} poor metric(s) have no action."), (WARN, "n = 0 or missing > 0", "{missing} metric(s) are unavailable."), HOLD, (PASS, "true", "{n} metric(s) are graded."),
    )


#: SQL: how a report stands to the policy
_REPORT = (
    "case when not e.read or e.metrics is null then 'held' when not (e.test_profile <=> policy.test_profile) then 'failed' "
    "when exists(map_entries(policy.thresholds), t -> e.metrics[t.key] > t.value) then 'failed' "
    "when exists(map_keys(policy.thresholds), k -> e.metrics[k] is null) then 'held' when e.fetched_at < policy.revision then 'held' else 'ok' end"
)


def _reports(audit: Audit) -> DataFrame:
    return recorded(audit, "lighthouse").where("rec.policy is not null").selectExpr("crawl_id", "rec.policy as policy", "explode(rec.reports) as e")


_NO_POLICY: Rung = (NA, "rec.policy is null", "Nothing says how fast pages have to be.")
_POLICY_OWNER: Rung = (WARN, "trim(coalesce(rec.policy.owner, '')) = ''", "The policy has no owner.")


@site("lab-perf-budget")
def lab_perf_budget(audit: Audit) -> DataFrame:
    rows = _reports(audit).withColumn("state", F.expr(_REPORT))
    return on_record(
        "lab-perf-budget", "lighthouse", [(rows, {"n": "count(*)", "failed": "count_if(state = 'failed')", "open": "count_if(state = 'held')"})], audit,
        _NO_POLICY, (FAIL, "failed > 0", "{failed} report(s) break the policy."), (WARN, "n = 0 or open > 0", "{open} report(s) do not settle it."), _POLICY_OWNER, HOLD, (PASS, "true", "{n} report(s) are inside the policy."),
    )


@site("lcp-element-strategy")
def lcp_element_strategy(audit: Audit) -> DataFrame:
    reports = entries(audit, "lighthouse", "reports").withColumn("normalized_url", U.normalized(F.col("e.url"))).groupBy("crawl_id", "normalized_url").agg(F.expr("min_by(e, e.url)").alias("report"))
    given = recorded(audit, "lighthouse").selectExpr("crawl_id", "true as given")
    faces = "regexp_extract_all(array_join(regexp_extract_all(f.body, '(?is)<style\\\\b[^>]*>(.*?)</style>', 1), ' '), '(?is)@font-face\\\\s*\\\\{([^}]*)\\\\}', 1)"
    rows = audit.facts.where("is_html").join(reports, ["crawl_id", "normalized_url"], "left").join(given, "crawl_id", "left").withColumn("faces", F.expr(faces))
    media = "report.lcp_element.tag in ('img', 'image', 'video', 'picture', 'source')"
    named = "(contains(f.body, report.lcp_element.src) or contains(f.body, if(rlike(report.lcp_element.src, '^https?://'), regexp_extract(report.lcp_element.src, '^https?://[^/?#]*([^#]*)', 1), concat('/', ltrim('/', report.lcp_element.src)))))"
    slow = "(lower(coalesce(report.lcp_element.loading, '')) = 'lazy' or lower(coalesce(report.lcp_element.fetch_priority, '')) = 'low')"
    sought = "report.lcp_element.src is not null and not startswith(report.lcp_element.src, 'data:')"
    loose = "size(filter(faces, r -> not rlike(r, '(?i)font-display\\\\s*:')))"
    return observed(
        rows, "lcp-element-strategy",
        [
            (NA, "given is null", "No report was supplied."), (NA, "report is null", "No report covers this page."), (WARN, "report.lcp_element is null", "The report names no element."),
            (FAIL, f"{media} and {slow}", "The largest paint is lazy or of low priority."), (ERROR, f"{media} and {sought} and f.truncated", "The body was cut."),
            (FAIL, f"{media} and {sought} and not {named}", "The raw HTML never names the largest paint."), (PASS, media, "The largest paint is in the raw HTML."),
            (WARN, f"{loose} > 0", f"{{{loose}}} of {{size(faces)}} font face(s) set no font-display."), (NA, "size(faces) = 0", "The page declares no web font."), (PASS, "true", "Every font face sets font-display."),
        ],
        "page", "normalized_url",
    )


# ---- the URL matrix


def matrix(audit: Audit, where: str) -> DataFrame:
    """Rows (crawl_id, at, row, m) of the URL matrix, m: how its pattern is matched."""
    listed = recorded(audit, "url_matrix").selectExpr("crawl_id", "posexplode(rec.entries) as (at, row)")
    rows = listed.join(audit.site_facts.select("crawl_id", "origin"), "crawl_id").where(where)
    return rows.withColumn("m", U.matchers(F.col("row.pattern"), F.col("origin"))).drop("origin")


def best_rows(urls: DataFrame, rows: DataFrame) -> DataFrame:
    """URLs (crawl_id, url, ...) with the most specific row that fits, or null; of
    rows alike in that, the first (by ``at``)."""
    met = urls.select("crawl_id", "url").distinct().join(rows, "crawl_id").where("rlike(url, m.regex)")
    best = met.groupBy("crawl_id", "url").agg(F.expr("max_by(row, struct(m.specificity, -at))").alias("row"))
    return urls.join(best, ["crawl_id", "url"], "left")


_EXPECTED = "case when row.canonical = 'self' then url when row.canonical = 'none' then null else row.canonical end"


def _pages_as_urls(audit: Audit) -> DataFrame:
    return audit.facts.selectExpr(
        "crawl_id", "normalized_url as url", "f.status as status", "first_status", "hops", "is_html", "kept_out", "x.canonical_target as canonical", f"{NETLOC.format('normalized_url')} = site_netloc as own"
    )


_EVERYWHERE = "row.environment is null"
_PRODUCTION = "(row.environment is null or row.environment = 'production')"
_PRIORITY = f"row.priority and coalesce(row.access, '') <> 'private' and {_PRODUCTION}"


@site("url-inventory-builder")
def url_inventory_builder(audit: Audit) -> DataFrame:
    rows = matrix(audit, _EVERYWHERE)
    pages = best_rows(_pages_as_urls(audit).where("status is not null and own"), rows)
    seen = pages.where("row is not null").selectExpr("crawl_id", "row.pattern as pattern").distinct().withColumn("seen", F.lit(True))
    unseen = rows.selectExpr("crawl_id", "row.pattern as pattern", "row.priority as priority").join(seen, ["crawl_id", "pattern"], "left").where("seen is null")
    whole = "is_html and status = 200 and hops = 0"
    bad = f"if(row.priority and first_status <> row.status, 1, 0) + if({whole} and row.indexable = kept_out, 1, 0) + if({whole} and not (canonical <=> {_EXPECTED}), 1, 0)"
    return on_record(
        "url-inventory-builder", "url_matrix",
        [(rows, {"n": "count(*)"}), (pages, {"unmatched": "count_if(row is null)", "bad": f"sum({bad})"}), (unseen, {"missed": "count_if(priority)", "empty": "count_if(not coalesce(priority, false))"})], audit,
        (NA, "n = 0", "No row is for all environments."), (FAIL, "bad + missed > 0", "{bad + missed} disagreement(s) with the matrix."),
        (WARN, "unmatched > 0 or empty > 0", "{unmatched} URL(s) match no row, {empty} row(s) have no page."), HOLD, (PASS, "true", "The crawl agrees with {n} row(s)."),
    )


@site("indexability-canary")
def indexability_canary(audit: Audit) -> DataFrame:
    rows = matrix(audit, _EVERYWHERE)
    urls = entries(audit, "canary", "urls").withColumn("url", F.coalesce(U.normalized(F.col("e")), F.col("e"))).select("crawl_id", "url")
    pages = _pages_as_urls(audit).withColumn("crawled", F.lit(True))
    barred = audit.blocked.selectExpr("crawl_id", "url", "true as barred").distinct()
    met = best_rows(urls, rows).join(pages, ["crawl_id", "url"], "left").join(barred, ["crawl_id", "url"], "left")
    whole = "is_html and status = 200 and hops = 0"
    bad = (
        f"case when row is null then 0 when barred then if(row.indexable, 1, 0) when status is null then 0 else "
        f"if(first_status <> row.status, 1, 0) + if({whole} and row.indexable = kept_out, 1, 0) + if({whole} and not (canonical <=> {_EXPECTED}), 1, 0) end"
    )
    return on_record(
        "indexability-canary", "canary",
        [(rows, {"n": "count(*)"}), (met, {"urls": "count(*)", "bad": f"sum({bad})", "unmatched": "count_if(row is null)", "unreached": "count_if(row is not null and barred is null and status is null)"})], audit,
        (NA, "n = 0", "No matrix row applies."), (FAIL, "bad > 0", "{bad} disagreement(s) with the matrix."), (WARN, "unmatched > 0 or unreached > 0", "{unmatched} canary URL(s) unmatched, {unreached} unreached."),
        HOLD, (PASS, "true", "{urls} canary URL(s) agree with the matrix."),
    )


def _on_production(audit: Audit) -> DataFrame:
    """Per crawl, whether it is known to be of production."""
    named = matrix(audit, "row.environment = 'production'").groupBy("crawl_id").agg(F.count("*").alias("named"))
    other = entries(audit, "environments", "entries").join(audit.site_facts.select("crawl_id", "site_netloc"), "crawl_id").where(f"coalesce(e.kind, '') <> 'production' and {NETLOC.format('lower(e.url)')} = site_netloc")
    return tally(audit, (named, {"named": "sum(named)"}), (other, {"elsewhere": "count(*)"})).selectExpr("crawl_id", "named > 0 and elsewhere = 0 as live")


@site("production-smoke-test")
def production_smoke_test(audit: Audit) -> DataFrame:
    rows = matrix(audit, _PRODUCTION)
    pages = best_rows(_pages_as_urls(audit).where("status is not null and own"), rows).where("row is not null")
    seen = pages.selectExpr("crawl_id", "row.pattern as pattern").distinct().withColumn("seen", F.lit(True))
    unseen = rows.where("row.priority and coalesce(row.access, '') <> 'private'").selectExpr("crawl_id", "row.pattern as pattern").join(seen, ["crawl_id", "pattern"], "left_anti")
    bad = "if(row.priority and status <> 200, 1, 0) + if(row.access = 'private' and status = 200, 1, 0) + if(row.indexable and is_html and status = 200 and kept_out, 1, 0)"
    live = _on_production(audit).groupBy("crawl_id").agg(F.max("live").alias("live"))
    return on_record(
        "production-smoke-test", "url_matrix", [(live, {"on_live": "count_if(live)"}), (pages, {"bad": f"sum({bad})"}), (unseen, {"unseen": "count(*)"})], audit,
        (NA, "on_live = 0", "The crawl is not known to be of production."), (FAIL, "bad > 0", "{bad} smoke-test failure(s)."), (WARN, "unseen > 0", "{unseen} priority pattern(s) were not reached."),
        (PASS, "true", "Priority URLs answer, private ones do not."),
    )


@site("template-lab-perf")
def template_lab_perf(audit: Audit) -> DataFrame:
    rows = matrix(audit, _PRIORITY)
    reports = _reports(audit).withColumn("url", U.normalized(F.col("e.url"))).withColumn("state", F.expr(_REPORT)).withColumn("old", F.expr("coalesce(e.fetched_at < policy.revision, false)"))
    met = rows.join(reports, "crawl_id", "left").withColumn("fits", F.expr("coalesce(rlike(url, m.regex), false)"))
    each = met.groupBy("crawl_id", "row.pattern").agg(
        F.expr("count_if(fits and not old)").alias("current"), F.expr("count_if(fits and not old and state = 'failed')").alias("failed"), F.expr("count_if(fits and not old and state = 'held')").alias("open")
    )
    return on_record(
        "template-lab-perf", "lighthouse", [(each, {"n": "count(*)", "bad": "count_if(current = 0 or failed > 0)", "open": "count_if(open > 0)"})], audit,
        _NO_POLICY, (NA, "n = 0", "No priority template."), (FAIL, "bad > 0", "{bad} of {n} template(s) have no current report inside the policy."), (WARN, "open > 0", "{open} template(s) are not settled."), _POLICY_OWNER, HOLD,
        (PASS, "true", "{n} template(s) have a current report inside the policy."),
    )


# ---- records met with pages by URL


@site("content-helpfulness")
def content_helpfulness(audit: Audit) -> DataFrame:
    reviews = found_at(audit, entries(audit, "content_review", "entries"), "e.url")
    pages = _pages_as_urls(audit).where("coalesce(status, 0) < 400")
    priority = pages.join(matrix(audit, _PRIORITY), "crawl_id").where("rlike(url, m.regex)").select("crawl_id", F.col("url").alias("target")).distinct()
    unreviewed = priority.join(reviews.select("crawl_id", "target"), ["crawl_id", "target"], "left_anti")
    return on_record(
        "content-helpfulness", "content_review",
        [(reviews, {"n": "count(*)", "failing": "count_if(e.verdict = 'fails')", "gone": "count_if(status >= 400 or any_noindex)", "needs": "count_if(e.verdict = 'needs-work')"}), (unreviewed, {"unreviewed": "count(*)"})], audit,
        (FAIL, "failing + gone > 0", "{failing} page(s) fail their review, {gone} are gone."), (WARN, "needs + unreviewed > 0", "{needs} page(s) need work, {unreviewed} are not reviewed."), (PASS, "true", "{n} reviewed page(s) are helpful."),
    )


@site("keyword-intent-map")
def keyword_intent_map(audit: Audit) -> DataFrame:
    mapped = found_at(audit, entries(audit, "keyword_map", "entries"), "e.url").dropDuplicates(["crawl_id", "target"])
    indexable = by_url(audit, "f.status as status", "any_noindex").where("status = 200 and not any_noindex")
    unmapped = indexable.join(mapped.select("crawl_id", "target"), ["crawl_id", "target"], "left_anti")
    return on_record(
        "keyword-intent-map", "keyword_map",
        [(mapped, {"n": "count(*)", "broken": "count_if(crawled is null or status is null or status <> 200 or any_noindex)"}), (indexable, {"indexable": "count(*)"}), (unmapped, {"unmapped": "count(*)"})], audit,
        (FAIL, "broken > 0", "{broken} mapped URL(s) are no indexable 200."), (WARN, "unmapped * 2 > indexable", "{unmapped} of {indexable} indexable page(s) are unmapped."), (PASS, "true", "{n} mapped URL(s) are indexable."),
    )


@site("product-checkout-qa")
def product_checkout_qa(audit: Audit) -> DataFrame:
    rows = found_at(audit, entries(audit, "checkout", "cases"), "e.url")
    return on_record(
        "product-checkout-qa", "checkout", [(rows, {"n": "count(*)", "bad": "count_if(e.result = 'fail' or (crawled and (status is null or status <> 200)))", "unreached": "count_if(crawled is null)"})], audit,
        (FAIL, "bad > 0", "{bad} case(s) failed or do not answer 200."), HOLD, (WARN, "unreached > 0", "{unreached} of {n} case(s) were not reached."), (PASS, "true", "All {n} case(s) passed."),
    )


@site("availability-canary")
def availability_canary(audit: Audit) -> DataFrame:
    rows = found_at(audit, entries(audit, "canary", "urls"), "e")
    late = "rec.last_test_alert_at is not null and (rec.delivered_at is null or rec.delivered_at < rec.last_test_alert_at or (unix_timestamp(rec.delivered_at) - unix_timestamp(rec.last_test_alert_at)) / 60 > rec.target_minutes)"
    return on_record(
        "availability-canary", "canary", [(rows, {"n": "count(*)", "down": "count_if(status is not null and status <> 200)", "unreached": "count_if(status is null)"})], audit,
        (FAIL, f"down > 0 or ({late})", "{down} canary URL(s) are down, or the test alert was late."),
        (WARN, "unreached > 0 or rec.last_test_alert_at is null or trim(coalesce(rec.recipient, '')) = ''", "{unreached} unreached, or no test alert or recipient is on record."), HOLD, (PASS, "true", "{n} canary URL(s) answer, alerts arrive."),
    )


@site("experiment-cloaking-divergence")
def experiment_cloaking_divergence(audit: Audit) -> DataFrame:
    tests = entries(audit, "experiments", "entries").join(audit.site_facts.select("crawl_id", "crawled_at"), "crawl_id")
    variants = found_at(audit, tests.selectExpr("crawl_id", "explode(e.variants) as v"), "v", "is_html", "hops", "f.truncated as cut", "x.canonical_target as canonical")
    return on_record(
        "experiment-cloaking-divergence", "experiments",
        [
            (tests, {"n": "count(*)", "overdue": "count_if(e.retire_by < crawled_at)"}),
            (variants, {"unreached": "count_if(crawled is null or status is null or cut)", "twins": "count_if(status = 200 and is_html and hops = 0 and not any_noindex and canonical = target)"}),
        ], audit,
        (NA, "n = 0", "No experiments."), (FAIL, "twins + overdue > 0", "{twins} variant(s) are permanent duplicates, {overdue} experiment(s) overdue."), (WARN, "unreached > 0", "{unreached} variant(s) were not reached."), HOLD,
        (PASS, "true", "No variant outlives its experiment."),
    )


@site("staging-protection")
def staging_protection(audit: Audit) -> DataFrame:
    named = entries(audit, "environments", "entries").where("coalesce(e.kind, '') <> 'production'").selectExpr("crawl_id", "e.name as name", "e.url as url")
    asked = audit.auxiliary.where("reason = 'environment'").selectExpr("crawl_id", "url", "fetch").dropDuplicates(["crawl_id", "url"])
    login = "size(fetch.redirect_chain) > 0 and rlike(regexp_extract(fetch.final_url, '^https?://([^?#]*)', 1), '" + X.LOGIN + "')"
    rows = named.join(asked, ["crawl_id", "url"], "left")
    return on_record(
        "staging-protection", "environments",
        [(rows, {"n": "count(*)", "open": f"count_if(fetch.status = 200 and rlike(coalesce(fetch.content_type, ''), '(?i)html') and not ({login}))", "login": f"count_if(fetch.status is not null and {login})", "unasked": "count_if(fetch is null)"})], audit,
        (NA, "n = 0", "No environments."), (FAIL, "open > 0", "{open} environment(s) are open."), (WARN, "login + unasked > 0", "{login} behind a login page, {unasked} not requested."), HOLD, (PASS, "true", "All {n} environment(s) are closed."),
    )


@site("url-inspection")
def url_inspection(audit: Audit) -> DataFrame:
    rows = found_at(audit, entries(audit, "search_console", "inspections"), "e.url", "is_html", "hops", "x.canonical_target as canonical")
    barred = audit.blocked.selectExpr("crawl_id", "url as target", "true as barred").distinct()
    rows = rows.join(barred, ["crawl_id", "target"], "left").withColumn("google", U.normalized(F.col("e.google_canonical"))).withColumn("unknown", F.expr("rlike(concat(coalesce(e.coverage, ''), ' ', coalesce(e.verdict, '')), '(?i)unknown to google|not on google')"))
    compared = "not unknown and status = 200 and hops = 0 and is_html and not kept_out"
    wrong = "rlike(coalesce(e.robots, ''), '(?i)blocked|disallowed') or rlike(coalesce(e.indexing, ''), '(?i)noindex') or google <> coalesce(canonical, target)"
    return on_record(
        "url-inspection", "search_console",
        [(rows, {"n": "count(*)", "unknown": "count_if(unknown)", "bad": f"count_if({compared} and ({wrong}))", "compared": f"count_if({compared})", "unreached": "count_if(not unknown and status is null and barred is null)"})], audit,
        (NA, "rec.inspections is null", "No inspection results."), (FAIL, "bad > 0", "{bad} URL(s) disagree with the crawl."), (NA, "n > 0 and unknown = n", "All are unknown to the engine."),
        (WARN, "unreached > 0", "{unreached} URL(s) were not reached."), HOLD, (PASS, "true", "{compared} URL(s) agree."),
    )


@site("indexation-review")
def indexation_review(audit: Audit) -> DataFrame:
    rows = found_at(audit, entries(audit, "search_console", "indexation"), "e.url", "is_html", "hops", "x.canonical_target as canonical")
    ours = rows.where("status = 200 and hops = 0 and is_html and not kept_out and coalesce(canonical, target) = target")
    return on_record(
        "indexation-review", "search_console",
        [(ours, {"compared": "count(*)", "bad": "count_if(rlike(e.reason, '(?i)noindex|blocked by robots|disallowed'))", "waiting": "count_if(rlike(e.reason, '(?i)crawled\\\\s*-\\\\s*currently not indexed'))"})], audit,
        (NA, "rec.indexation is null", "No indexing report."), (FAIL, "bad > 0", "{bad} indexable page(s) are reported as excluded."), (WARN, "waiting > 0", "{waiting} page(s) are crawled, not indexed."), HOLD,
        (PASS, "true", "{compared} page(s) agree with the report."),
    )


@site("gsc-property-ownership")
def gsc_property_ownership(audit: Audit) -> DataFrame:
    rows = entries(audit, "search_console", "properties").join(audit.site_facts.selectExpr("crawl_id", "lower(origin) as origin", "site_netloc"), "crawl_id")
    rows = rows.withColumn("covers", S.property_covers(F.col("e.property"), F.col("origin")))
    return on_record(
        "gsc-property-ownership", "search_console",
        [(rows, {"n": "count(*)", "covering": "count_if(covers)", "owners": "max(if(covers, size(array_distinct(transform(e.owners, o -> lower(trim(o))))), 0))"})], audit,
        (WARN, "n = 0", "No property is named."), (FAIL, "covering = 0", "No property covers the site."), (FAIL, "owners = 0", "The property has no owner."), HOLD, (WARN, "owners = 1", "The property has one owner."),
        (PASS, "true", "A property covers the site, with {owners} owners."),
    )


def _live_sitemaps(audit: Audit) -> DataFrame:
    return audit.sitemaps.where("status < 400").select("crawl_id", "url").distinct().withColumn("target", U.normalized(F.col("url")))


@site("sitemap-submit")
def sitemap_submit(audit: Audit) -> DataFrame:
    told = entries(audit, "search_console", "sitemaps").withColumn("target", F.coalesce(U.normalized(F.col("e.url")), F.col("e.url"))).dropDuplicates(["crawl_id", "target"])
    rows = _live_sitemaps(audit).join(told, ["crawl_id", "target"], "left")
    wrong = "e.errors > 0 or rlike(coalesce(e.status, ''), '(?i)\\\\berrors?\\\\b')"
    return on_record(
        "sitemap-submit", "search_console",
        [(rows, {"found": "count(*)", "wrong": f"count_if({wrong})", "pending": "count_if(e is null)", "unread": f"count_if(e is not null and not ({wrong}) and rlike(coalesce(e.status, ''), '(?i)couldn.?t fetch|fail'))"})], audit,
        (NA, "found = 0", "The crawl found no sitemap."), (WARN, "rec.sitemaps is null", "No sitemaps report."), (FAIL, "wrong > 0", "{wrong} of {found} sitemap(s) have errors."), (WARN, "pending > 0", "{pending} sitemap(s) are not submitted."),
        (WARN, "unread > 0", "{unread} sitemap(s) could not be fetched."), HOLD, (PASS, "true", "All {found} sitemap(s) are submitted."),
    )


@site("bing-onboarding")
def bing_onboarding(audit: Audit) -> DataFrame:
    told = entries(audit, "bing", "sitemaps").withColumn("target", F.coalesce(U.normalized(F.col("e.url")), F.col("e.url")))
    missing = _live_sitemaps(audit).join(told.select("crawl_id", "target"), ["crawl_id", "target"], "left_anti")
    return on_record(
        "bing-onboarding", "bing", [(told, {"failed": "count_if(rlike(e.status, '(?i)\\\\b(error|errors|failed|fail)\\\\b|couldn.?t fetch'))"}), (missing, {"missing": "count(*)"})], audit,
        (FAIL, "not rec.verified", "The property is not verified."), (FAIL, "failed > 0", "{failed} sitemap(s) failed."), (WARN, "rec.verified is null", "No property is on record."), (WARN, "missing > 0", "{missing} sitemap(s) were not received."),
        HOLD, (PASS, "true", "The property is verified and has all sitemaps."),
    )


@site("content-decay")
def content_decay(audit: Audit) -> DataFrame:
    rows = entries(audit, "search_console", "performance").where("e.query is null").withColumn("url", F.coalesce(U.normalized(F.col("e.page")), F.col("e.page")))
    periods = rows.selectExpr("crawl_id", "e.period as period", "try_cast(nullif(regexp_extract(e.period, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') as date) as start").distinct()
    last = periods.groupBy("crawl_id").agg(F.count("*").alias("periods"), F.expr("count_if(start is null)").alias("undated"), F.expr("slice(reverse(array_sort(collect_list(struct(start, period)))), 1, 2)").alias("two"))
    clicks = rows.groupBy("crawl_id", "url", "e.period").agg(F.sum("e.clicks").alias("clicks")).join(last, "crawl_id")
    both = clicks.groupBy("crawl_id", "url").agg(F.expr("sum(if(period = get(two, 1).period, clicks, 0))").alias("before"), F.expr("sum(if(period = get(two, 0).period, clicks, 0))").alias("after"))
    decided = entries(audit, "content_decisions", "entries").withColumn("url", F.coalesce(U.normalized(F.col("e.url")), F.col("e.url"))).selectExpr("crawl_id", "url", "true as decided").distinct()
    falling = both.where("before >= 100 and after < before * 0.7").join(decided, ["crawl_id", "url"], "left")
    return on_record(
        "content-decay", "search_console", [(last, {"periods": "max(periods)", "undated": "max(undated)"}), (falling, {"falling": "count(*)", "undecided": "count_if(decided is null)"})], audit,
        (NA, "rec.performance is null and periods = 0", "No performance report."), (NA, "periods < 2", "Fewer than two periods."), (WARN, "undated > 0", "The periods can't be ordered."), (FAIL, "undecided > 0", "{undecided} of {falling} declining URL(s) have no decision."),
        (PASS, "falling = 0", "No URL declined."), HOLD, (PASS, "true", "All {falling} declining URL(s) have a decision."),
    )


@site("reporting-anomaly-thresholds")
def reporting_anomaly_thresholds(audit: Audit) -> DataFrame:
    perf = recorded(audit, "search_console").selectExpr("crawl_id", "posexplode(rec.performance) as (at, e)")
    if (table := audit.rows.get("search_console.performance")) is not None:
        fields = [f.name for f in perf.schema["e"].dataType]
        perf = perf.unionByName(table.select("crawl_id", F.col("place").cast("int").alias("at"), F.struct(*fields).alias("e")))
    totals = perf.groupBy("crawl_id", "e.period").agg(F.min("at").alias("at"), F.sum("e.clicks").alias("clicks"), F.sum("e.impressions").alias("impressions"))
    two = totals.groupBy("crawl_id").agg(F.expr("slice(reverse(array_sort(collect_list(struct(at, clicks, impressions)))), 1, 2)").alias("two"))
    rows = recorded(audit, "reporting").selectExpr("crawl_id", "rec.anomalies as anomalies", "explode(rec.thresholds) as t").join(two, "crawl_id", "left")
    value = "case t.metric when 'clicks' then get(two, {0}).clicks when 'impressions' then get(two, {0}).impressions end"
    rows = rows.selectExpr("*", f"if(lower(t.engine) = 'google' and size(two) = 2, ({value.format(0)} - {value.format(1)}) / nullif({value.format(1)}, 0), null) as moved")
    crossed = "((t.change < 0 and moved <= t.change) or (t.change >= 0 and moved >= t.change))"
    return on_record(
        "reporting-anomaly-thresholds", "reporting",
        [
            (rows, {"n": "count(*)", "unmeasured": "count_if(moved is null)", "unlogged": f"count_if({crossed} and not exists(anomalies, a -> a.metric = t.metric))"}),
            (entries(audit, "reporting", "anomalies"), {"unanswered": "count_if(trim(coalesce(e.disposition, '')) = '')"}),
        ], audit,
        (FAIL, "unlogged + unanswered > 0", "{unlogged} crossed threshold(s) are not logged, {unanswered} anomaly(ies) not answered."), (WARN, "n = 0", "No thresholds."), (WARN, "unmeasured > 0", "{unmeasured} threshold(s) can't be measured."), HOLD,
        (PASS, "true", "{n} threshold(s) checked."),
    )


@site("log-file-analysis")
def log_file_analysis(audit: Audit) -> DataFrame:
    hits = entries(audit, "server_logs", "hits").where("rlike(e.user_agent, '(?i)googlebot|bingbot')").join(audit.site_facts.select("crawl_id", "origin", "robots_txt"), "crawl_id")
    agent = F.when(F.col("e.user_agent").rlike("(?i)googlebot"), "Googlebot").otherwise("Bingbot")
    paths = hits.select("crawl_id", "robots_txt", agent.alias("agent"), F.concat(F.expr("rtrim('/', origin)"), F.col("e.path")).alias("url")).groupBy("crawl_id", "robots_txt", "agent", "url").agg(F.count("*").alias("n"))
    barred = paths.withColumn("ok", F.element_at(R.allowed_each(F.col("robots_txt"), F.col("agent"), F.array("url")), 1)).where("not ok")
    return on_record(
        "log-file-analysis", "server_logs",
        [(hits, {"hits": "count(*)", "errors": "count_if(e.status between 500 and 599)", "params": "count_if(e.parameterised)"}), (barred, {"barred": "sum(n)"})], audit,
        (NA, "rec.hits is null and hits = 0", "The log was not read."), (NA, "hits = 0", "No crawler hits."), (FAIL, "errors / hits > 0.01", "{errors} of {hits} crawler hits got a 5xx."), (FAIL, "barred > 0", "{barred} hit(s) reached disallowed URLs."),
        (WARN, "params / hits > 0.25", "{params} of {hits} hits carry parameters."), HOLD, (PASS, "true", "{hits} crawler hits are sound."),
    )


@site("indexnow-integration")
def indexnow_integration(audit: Audit) -> DataFrame:
    log = entries(audit, "index_now", "log").join(audit.site_facts.select("crawl_id", "site_netloc"), "crawl_id")
    often = log.groupBy("crawl_id", "e.url", F.expr("date(e.sent_at)").alias("day")).agg(F.count("*").alias("n")).where("n > 5")
    key = audit.auxiliary.where("reason = 'indexnow-key'").join(recorded(audit, "index_now").selectExpr("crawl_id", "rec.key as key"), "crawl_id")
    return on_record(
        "indexnow-integration", "index_now",
        [(log, {"sent": "count(*)", "foreign": f"count_if({NETLOC.format('lower(e.url)')} <> site_netloc)"}), (often, {"often": "count(*)"}), (key, {"asked": "count(*)", "right": "count_if(fetch.status = 200 and trim(fetch.body) = key)"})], audit,
        (FAIL, "asked > 0 and right = 0", "The key file is missing or wrong."), (FAIL, "foreign > 0", "{foreign} URL(s) are of another host."), (FAIL, "often > 0", "{often} URL(s) were sent over five times in a day."), (WARN, "asked = 0", "The key file was not requested."),
        HOLD, (PASS, "true", "{sent} submission(s) are sound."),
    )


@site("merchant-feed-parity")
def merchant_feed_parity(audit: Audit) -> DataFrame:
    rows = found_at(audit, entries(audit, "merchant_feed", "items"), "e.link", "html_200", "x.derived.product as product").withColumn("product", F.expr("if(html_200, product, null)"))
    plain = "regexp_replace(lower({}), '[\\\\s_]', '')"
    prices, money = "filter(product.offers, o -> o.price is not null)", "filter(product.offers, o -> o.currency is not null)"
    digits = "nullif(regexp_replace(regexp_replace(e.gtin, '[^0-9]', ''), '^0+', ''), '')"
    states = f"transform(product.availability, a -> {plain.format('a')})"
    bad = (
        f"if(size({prices}) > 0 and not exists({prices}, o -> abs(o.price - e.price) < 0.005), 1, 0) + if(size({money}) > 0 and not exists({money}, o -> o.currency = upper(e.currency)), 1, 0) "
        f"+ if(size({states}) > 0 and not array_contains({states}, {plain.format('e.availability')}), 1, 0) + if({digits} is not null and size(product.gtins) > 0 and not array_contains(product.gtins, {digits}), 1, 0)"
    )
    gaps = f"if(size({prices}) = 0, 1, 0) + if(size({money}) = 0, 1, 0) + if(size({states}) = 0, 1, 0) + if(e.gtin is not null and size(product.gtins) = 0, 1, 0)"
    return on_record(
        "merchant-feed-parity", "merchant_feed",
        [(rows, {"n": "count(*)", "bad": f"sum(if(product is null, 0, {bad}))", "gaps": f"sum(if(html_200, if(product is null, 1, {gaps}), 0))", "unreached": "count_if(not coalesce(html_200, false))"})], audit,
        (NA, "n = 0", "The feed holds no items."), HOLD, (FAIL, "bad > 0", "{bad} feed value(s) disagree with their pages."), (WARN, "unreached + gaps > 0", "{unreached} item(s) unreached, {gaps} value(s) not stated."), (PASS, "true", "All {n} item(s) agree."),
    )


@site("manual-a11y-evaluation")
def manual_a11y_evaluation(audit: Audit) -> DataFrame:
    run = audit.facts.where("r.accessibility is not null and r.accessibility.error is null")
    claim = "trim(coalesce(rec.conformance_claim, '')) <> ''"
    return on_record(
        "manual-a11y-evaluation", "a11y_evaluation",
        [(entries(audit, "a11y_evaluation", "blockers"), {"open": "count_if(not e.resolved)"}), (run, {"audited": "count(*)", "critical": "count_if(exists(r.accessibility.violations, v -> v.impact = 'critical'))"})], audit,
        (FAIL, f"open > 0 or ({claim} and critical > 0)", "{open} blocker(s) are open, or {critical} page(s) contradict the claim."), HOLD, (WARN, f"{claim} and audited = 0", "The claim could not be tested."), (PASS, "true", "No blocker is open."),
    )


# ---- redirect maps and the previous audit


def redirects(audit: Audit) -> DataFrame:
    """(crawl_id, kind, at, source, goal, expect, moves): the redirect map, resolved."""
    rows = recorded(audit, "redirect_map").selectExpr("crawl_id", "rec.kind as kind", "rec.old_origin as old_origin", "posexplode(rec.entries) as (at, e)").join(audit.site_facts.select("crawl_id", "origin"), "crawl_id")
    rows = rows.withColumn("source", U.resolved(F.col("e.from"), F.coalesce("old_origin", "origin"))).withColumn("goal", U.resolved(F.col("e.to"), F.col("origin")))
    return rows.selectExpr("crawl_id", "kind", "at", "source", "goal", "e.expect as expect", "e.to is not null as moves")


def chained(rows: DataFrame) -> DataFrame:
    """Entries (crawl_id, source, goal[, at]) whose goal is an entry too; ``loops`` if
    following them never ends.  Of entries of one source, the last by ``at`` counts.

    Chains are followed by doubling: after r rounds every entry has gone 2^r steps or to
    its chain's end.  A map of n entries has no chain of more than n steps, so that
    what still goes on after log2(n) rounds is in a loop or runs into one."""
    order = F.col("at") if "at" in rows.columns else F.lit(0)
    last = rows.where("source is not null").groupBy("crawl_id", "source").agg(F.max_by(F.struct("goal"), F.struct(order, "goal")).alias("last"))
    hop = written(last.selectExpr("crawl_id", "source", "last.goal as goal"), "redirects")
    sources = hop.selectExpr("crawl_id", "source as goal")
    jump = hop.where("goal is not null").join(sources, ["crawl_id", "goal"], "left_semi").select("crawl_id", "source", "goal")
    starts = written(jump, "chains")
    most = hop.groupBy("crawl_id").count().agg(F.max("count")).first()[0] or 0
    jump = starts
    for _ in range(most.bit_length()):
        # an entry that has come to an end needs no further look
        ahead = jump.selectExpr("crawl_id", "source as goal", "goal as far")
        jump = written(jump.join(ahead, ["crawl_id", "goal"]).selectExpr("crawl_id", "source", "far as goal"), "chains")
        if jump.isEmpty():
            break
    endless = jump.selectExpr("crawl_id", "source", "true as loops").distinct()
    return starts.join(endless, ["crawl_id", "source"], "left").selectExpr("crawl_id", "source", "loops is not null as loops")


@site("migration-map-builder")
def migration_map_builder(audit: Audit) -> DataFrame:
    rows = redirects(audit)
    old = audit.previous_pages.where("status = 200").selectExpr("crawl_id", "url as source")
    listed = audit.sitemap_urls.join(recorded(audit, "redirect_map").selectExpr("crawl_id", "rec.old_origin as old_origin"), "crawl_id").where(f"{NETLOC.format('normalized_url')} = {NETLOC.format('lower(old_origin)')}").selectExpr("crawl_id", "normalized_url as source")
    unmapped = old.union(listed).distinct().join(rows.select("crawl_id", "source"), ["crawl_id", "source"], "left_anti")
    return on_record(
        "migration-map-builder", "redirect_map",
        [(rows, {"n": "count(*)", "unread": "count_if(source is null)"}), (chained(rows), {"chains": "count_if(not loops)", "loops": "count_if(loops)"}), (unmapped, {"unmapped": "count(*)"})], audit,
        (FAIL, "(rec.kind = 'move' and (rec.old_origin is null or unmapped > 0)) or unread + chains + loops > 0", "{unread} unreadable, {chains} chained, {loops} looping, {unmapped} unmapped."), HOLD,
        (PASS, "rec.kind = 'history-only'", "Only history is kept."), (PASS, "true", "{n} entries, none chains or loops."),
    )


def tested(audit: Audit) -> DataFrame:
    """Redirect map entries with what their old URL answered, as ``state``."""
    asked = audit.auxiliary.where("reason = 'redirect-map'").withColumn("source", U.normalized(F.col("url"))).withColumn("landed", U.normalized(F.col("fetch.final_url"))).select("crawl_id", "source", "fetch", "landed").dropDuplicates(["crawl_id", "source"])
    state = (
        "case when fetch is null then 'unrequested' when rlike(coalesce(fetch.error, ''), '" + X.LOOPING + "') then 'failed' when fetch.error is not null or fetch.status is null then 'unanswered' "
        "when size(fetch.redirect_chain) > 1 then 'failed' when expect is not null and coalesce(try_element_at(fetch.redirect_chain, 1).status, fetch.status) <> expect then 'failed' "
        "when moves and not (landed <=> goal) then 'failed' when moves and fetch.status >= 400 then 'failed' else 'ok' end"
    )
    return redirects(audit).join(asked, ["crawl_id", "source"], "left").withColumn("state", F.expr(state))


_TESTED = {"n": "count(*)", "failed": "count_if(state = 'failed')", "unrequested": "count_if(state = 'unrequested')", "unanswered": "count_if(state = 'unanswered')"}
_UNPROVEN: Rung = (WARN, "unrequested + unanswered > 0", "{unrequested} entry(ies) not requested, {unanswered} not answered.")


@site("migration-redirect-test")
def migration_redirect_test(audit: Audit) -> DataFrame:
    return on_record(
        "migration-redirect-test", "redirect_map", [(tested(audit), _TESTED)], audit,
        (NA, "n = 0", "The map has no entries."), (FAIL, "failed > 0", "{failed} redirect(s) are wrong."), _UNPROVEN, (PASS, "true", "All {n} redirects are right."),
    )


@site("migration-redirects-live")
def migration_redirects_live(audit: Audit) -> DataFrame:
    live = _on_production(audit).groupBy("crawl_id").agg(F.max("live").alias("live"))
    root = audit.auxiliary.where("reason = 'old-root'").selectExpr("crawl_id", "size(fetch.redirect_chain) > 0 as moved")
    return on_record(
        "migration-redirects-live", "redirect_map", [(live, {"on_live": "count_if(live)"}), (tested(audit), _TESTED), (root, {"stuck": "count_if(not moved)"})], audit,
        (NA, "on_live = 0", "The crawl is not known to be of production."), (NA, "n = 0", "The map has no entries."), (FAIL, "failed > 0 or (rec.kind = 'move' and stuck > 0)", "{failed} redirect(s) are wrong, or the old root does not redirect."),
        _UNPROVEN, HOLD, (PASS, "true", "All {n} redirects are right."),
    )


def _previous(audit: Audit) -> DataFrame:
    pattern = NOINDEX_OR_NONE
    return audit.previous_pages.selectExpr(
        "crawl_id", "url", "status as was", "title as old_title", "h1 as old_h1", "words as old_words", "canonical as old_canonical",
        f"status = 200 and not rlike(coalesce(meta_robots, ''), '{pattern}') and not rlike(coalesce(x_robots_tag, ''), '{pattern}') as was_indexable",
    )


_NO_PREVIOUS: Rung = (NA, "known = 0", "There is no previous audit.")


@site("post-migration-monitor")
def post_migration_monitor(audit: Audit) -> DataFrame:
    before = _previous(audit)
    rows = tested(audit).join(before.withColumnRenamed("url", "source"), ["crawl_id", "source"], "left")
    goals = rows.where("moves and was_indexable").withColumnRenamed("goal", "target").join(by_url(audit, "f.status as status", "kept_out", "true as crawled"), ["crawl_id", "target"], "left")
    barred = audit.blocked.selectExpr("crawl_id", "url as target", "true as barred").distinct()
    goals = goals.join(barred, ["crawl_id", "target"], "left")
    return on_record(
        "post-migration-monitor", "redirect_map",
        [(before, {"known": "count(*)"}), (rows, {"wrong": "count_if(state = 'failed')", "unproven": "count_if(state in ('unrequested', 'unanswered'))"}), (goals, {"lost": "count_if(barred or status >= 400 or (status = 200 and kept_out))", "unreached": "count_if(crawled is null and barred is null)"})], audit,
        _NO_PREVIOUS, (FAIL, "wrong + lost > 0", "{wrong} redirect(s) are wrong, {lost} destination(s) lost indexability."), (WARN, "unproven + unreached > 0", "{unproven} unproven, {unreached} unreached."), HOLD, (PASS, "true", "The migration holds."),
    )


@site("content-parity-diff")
def content_parity_diff(audit: Audit) -> DataFrame:
    tokens = "array_distinct(regexp_extract_all(lower(coalesce({}, '')), '([\\\\p{{L}}\\\\p{{N}}]{{2,}})', 1))"
    rows = redirects(audit).where("goal is not null").join(_previous(audit).where("was = 200").withColumnRenamed("url", "source"), ["crawl_id", "source"])
    met = rows.withColumnRenamed("goal", "target").join(
        by_url(audit, "html_200 and not f.truncated as read", "x.title as title", "try_element_at(filter(x.headings, h -> h.level = 1), 1).text as h1", "aggregate(x.content.sections, 0, (n, s) -> n + s.words) as words", "x.canonical_target as canonical"),
        ["crawl_id", "target"], "left",
    )
    old = f"array_union({tokens.format('old_title')}, {tokens.format('old_h1')})"
    bad = f"read and ((size({old}) > 0 and h1 is not null and not arrays_overlap({tokens.format('h1')}, {old})) or (old_words > 0 and words < old_words * 0.5) or (canonical is not null and canonical <> target))"
    return on_record(
        "content-parity-diff", "redirect_map",
        [(audit.previous_pages, {"known": "count(*)"}), (met, {"n": "count(*)", "bad": f"count_if({bad})", "retitled": f"count_if(read and not coalesce({bad}, false) and lower(trim(title)) <> lower(trim(old_title)))", "unreached": "count_if(not coalesce(read, false))"})], audit,
        _NO_PREVIOUS, (FAIL, "bad > 0", "{bad} migrated URL(s) lost their content."), (NA, "n = 0", "No entry has an old page."), (WARN, "retitled + unreached > 0", "{retitled} retitled, {unreached} unreached."), HOLD, (PASS, "true", "{n} migrated URL(s) match."),
    )


@site("production-crawl-verify")
def production_crawl_verify(audit: Audit) -> DataFrame:
    own = audit.site_facts.selectExpr("crawl_id", "rtrim('/', origin) as origin", "production_origin")
    before = _previous(audit).where("was_indexable").join(own, "crawl_id")
    moved = "if(production_origin is not null and startswith({0}, rtrim('/', production_origin)), concat(origin, substring({0}, length(rtrim('/', production_origin)) + 1)), {0})"
    rows = before.selectExpr("crawl_id", f"{moved.format('url')} as target", f"{moved.format('old_canonical')} as wanted").join(
        by_url(audit, "f.status as status", "kept_out", "is_html", "x.canonical_target as canonical"), ["crawl_id", "target"], "left"
    ).join(audit.blocked.selectExpr("crawl_id", "url as target", "true as barred").distinct(), ["crawl_id", "target"], "left")
    seen = _pages_as_urls(audit).where("status is not null and own")
    rows_of = matrix(audit, _PRIORITY)
    missed = rows_of.join(seen.select("crawl_id", "url"), "crawl_id", "left").withColumn("fits", F.expr("coalesce(rlike(url, m.regex), false)")).groupBy("crawl_id", "row.pattern").agg(F.max("fits").alias("fits")).where("not fits")
    bad = "barred or status >= 400 or (status = 200 and kept_out) or (status = 200 and is_html and not (canonical <=> wanted))"
    return judged(
        "production-crawl-verify", audit,
        [(audit.previous_pages, {"known": "count(*)"}), (rows, {"bad": f"count_if({bad})", "compared": "count(status)", "unreached": "count_if(status is null and barred is null)"}), (missed, {"missed": "count(*)"})],
        _NO_PREVIOUS, (FAIL, "bad + missed > 0", "{bad} regression(s), {missed} priority pattern(s) missed."), (WARN, "unreached > 0", "{unreached} URL(s) were not reached."), (PASS, "true", "{compared} URL(s) are still indexable."),
    )


@site("prelaunch-baseline-snapshot")
def prelaunch_baseline_snapshot(audit: Audit) -> DataFrame:
    kept = recorded(audit, "crux").select("crawl_id").union(recorded(audit, "lighthouse").select("crawl_id")).distinct()
    return judged(
        "prelaunch-baseline-snapshot", audit, [(audit.previous_pages, {"known": "count(*)"}), (kept, {"measured": "count(*)"})],
        (NA, "release_id is null", "The audit is of no release."), (FAIL, "known = 0", "A release without a previous audit."), (WARN, "settings is null", "The crawl's settings are unknown."), (WARN, "measured = 0", "No field or lab data."),
        (PASS, "true", "A baseline is there."),
    )


@site("release-regression-review")
def release_regression_review(audit: Audit) -> DataFrame:
    back = "array_except(array_intersect(g.passed_before, g.failing_now), coalesce(g.reopened, array()))"
    rows = audit.site_facts.join(audit.gates.select("crawl_id", F.struct("passed_before", "failing_now", "reopened").alias("g")), "crawl_id", "left")
    return observed(
        rows, "release-regression-review",
        [
            (NA, "g is null", "No release's gates are known."), (FAIL, f"size({back}) > 0", f"Gate(s) {{array_join(array_sort({back}), ', ')}} passed before and fail now."),
            (PASS, "true", "No gate that passed before fails now, but for reopened ones."),
        ],
    )


@site("a11y-regression-sampling")
def a11y_regression_sampling(audit: Audit) -> DataFrame:
    of = "transform(filter({}, v -> v.impact = '{}'), v -> v.id)"
    now = audit.facts.where("r.accessibility is not null and r.accessibility.error is null").selectExpr("crawl_id", "normalized_url as url", "r.accessibility.violations as now")
    rows = now.join(audit.previous_pages.where("axe is not null").select("crawl_id", "url", "axe"), ["crawl_id", "url"])
    return judged(
        "a11y-regression-sampling", audit,
        [
            (audit.previous_pages, {"known": "count(*)"}),
            (rows, {"compared": "count(*)", "fresh": f"count_if(size(array_except({of.format('now', 'critical')}, {of.format('axe', 'critical')})) > 0)", "serious": f"sum(size({of.format('now', 'serious')}))", "serious_before": f"sum(size({of.format('axe', 'serious')}))"}),
        ],
        _NO_PREVIOUS, (NA, "compared = 0", "No page can be compared."), (FAIL, "fresh > 0", "{fresh} page(s) have a new critical violation."), (WARN, "serious > serious_before", "Serious violations rose from {serious_before} to {serious}."),
        (PASS, "true", "{compared} page(s) compared."),
    )


@site("schema-hreflang-maintenance")
def schema_hreflang_maintenance(audit: Audit) -> DataFrame:
    kinds = "array_distinct(flatten(transform(x.json_ld_nodes, n -> n.types)))"
    rows = audit.facts.where("html_200").selectExpr("crawl_id", "normalized_url as url", f"{kinds} as kinds", "x.json_ld_errors as errors").join(audit.previous_pages.where("status = 200").select("crawl_id", "url", "json_ld_types"), ["crawl_id", "url"])
    pairs = audit.previous_pages.selectExpr("crawl_id", "url as page", "explode(hreflang) as a").selectExpr("crawl_id", "page", "a.url as target")
    mutual = pairs.join(pairs.selectExpr("crawl_id", "target as page", "page as target"), ["crawl_id", "page", "target"], "left_semi").where("page < target").distinct()
    now = audit.alternates.selectExpr("crawl_id", "page", "alt.target as target").distinct()
    both = now.join(now.selectExpr("crawl_id", "target as page", "page as target"), ["crawl_id", "page", "target"], "left_semi")
    crawled = audit.facts.where("html_200").select("crawl_id", "normalized_url")
    known = mutual.join(crawled.withColumnRenamed("normalized_url", "page"), ["crawl_id", "page"], "left_semi").join(crawled.withColumnRenamed("normalized_url", "target"), ["crawl_id", "target"], "left_semi")
    lost = known.join(both, ["crawl_id", "page", "target"], "left_anti")
    gone = "size(array_except(json_ld_types, kinds)) > 0"
    return judged(
        "schema-hreflang-maintenance", audit,
        [(audit.previous_pages, {"known": "count(*)"}), (rows, {"compared": "count(*)", "broken": f"count_if({gone} and errors > 0)", "dropped": f"count_if({gone} and errors = 0)"}), (lost, {"lost": "count(*)"})],
        _NO_PREVIOUS, (FAIL, "broken + lost > 0", "{broken} page(s) lost types to errors, {lost} reciprocal pair(s) are lost."), (WARN, "dropped > 0", "{dropped} page(s) dropped a type."), (PASS, "true", "{compared} page(s) keep their markup."),
    )


# ---- news and video sitemaps


_OWN = f"{NETLOC.format('loc')} = site_netloc"


@site("news-sitemap")
def news_sitemap(audit: Audit) -> DataFrame:
    from lodestar.functions.language import codes as known_codes

    docs = audit.sitemaps.withColumn("named", F.expr("rlike(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '" + X.NEWS_NAME + "')"))
    rows = audit.sitemap_news.join(audit.site_facts.select("crawl_id", "site_netloc"), "crawl_id").join(audit.sitemaps.selectExpr("crawl_id", "url as sitemap", "fetched_at").dropDuplicates(["crawl_id", "sitemap"]), ["crawl_id", "sitemap"], "left")
    rows = rows.withColumn("span", S.publication_span(F.col("publication_date"))).selectExpr("*", "span.earliest as earliest", "span.latest as latest", "lower(trim(language)) as code")
    codes = ", ".join(f"'{c}'" for c in sorted(known_codes(audit.spark).languages))
    good = f"(code in ('zh-cn', 'zh-tw') or rlike(code, '^[a-z]{{3}}$') or code in ({codes}))"
    tagged = f"(rlike(code, '^[a-z]{{2}}-') and split(code, '-')[0] in ({codes}))"
    defects = (
        "int(publication_name is null or language is null or publication_date is null or title is null) "
        f"+ int(coalesce(not {good} and not {tagged}, false)) + int(publication_date is not null and earliest is null) "
        "+ int(coalesce(earliest > fetched_at + interval 1 hour, false)) + int(coalesce(latest < fetched_at - interval 3 days, false))"
    )
    held = f"not ({_OWN}) or coalesce(not {good} and {tagged}, false) or coalesce(latest < fetched_at - interval 2 days and latest >= fetched_at - interval 3 days, false)"
    return judged(
        "news-sitemap", audit,
        [
            (docs, {"unfetched": "count_if(named and (status is null or status <> 200))", "crowded": "count_if(news_count > 1000)", "cut": "count_if(truncated and news_count > 0)"}),
            (rows, {"n": "count(*)", "defects": f"sum({defects})", "untimed": "count_if(earliest is not null and fetched_at is null)", "look": f"count_if({held})"}),
        ],
        (FAIL, "unfetched > 0", "{unfetched} news sitemap(s) could not be fetched."), (FAIL, "crowded > 0", "{crowded} file(s) carry over 1,000 entries."), (ERROR, "cut > 0", "{cut} sitemap(s) were cut."), (NA, "n = 0", "No news entries."),
        (ERROR, "untimed > 0", "An entry's sitemap has no fetch time."), (FAIL, "defects > 0", "{defects} defect(s) in {n} entries."), (WARN, "look > 0", "{look} of {n} entries need a look."), (PASS, "true", "{n} news entries are recent and complete."),
    )


@site("news-article-policy")
def news_article_policy(audit: Audit) -> DataFrame:
    feed = audit.sitemap_news.groupBy("crawl_id", F.col("loc").alias("normalized_url")).agg(F.min("publication_date").alias("fed"))
    strip = "regexp_replace(t, '^(https?://schema[.]org/|schema:)', '')"
    news = f"exists(x.json_ld_nodes, n -> exists(n.types, t -> {strip} in ('NewsArticle', 'AnalysisNewsArticle', 'AskPublicNewsArticle', 'BackgroundNewsArticle', 'OpinionNewsArticle', 'ReportageNewsArticle', 'ReviewNewsArticle')))"
    org = f"exists(x.json_ld_nodes, n -> exists(n.types, t -> {strip} in ('Organization', 'NewsMediaOrganization', 'Corporation', 'NGO')) and get_json_object(n.json, '$.{{}}') is not null)"
    segs = "split(regexp_extract(l.url, '^https?://[^/?#]*([^?#]*)', 1), '/')"
    contact = f"exists(x.links, l -> rlike(l.url, '(?i)^(mailto|tel):') or rlike(trim(l.anchor_text), '{X.CONTACT_TEXT}') or exists({segs}, s -> rlike(s, '{X.CONTACT_PATH}')))"
    about = f"exists(x.links, l -> rlike(trim(l.anchor_text), '{X.ABOUT_TEXT}') or exists({segs}, s -> rlike(s, '{X.ABOUT_PATH}')))"
    declared = f"exists(x.json_ld_nodes, n -> exists(n.types, t -> {strip} = 'AdvertiserContentArticle'))"
    sponsored = f"({declared} or exists(split(regexp_extract(f.final_url, '^https?://[^/?#]*([^?#]*)', 1), '/'), s -> rlike(s, '{X.SPONSORED}')))"
    told = f"rlike(concat(x.text, ' ', coalesce(x.authorship.byline, ''), ' ', array_join(transform(x.images, i -> coalesce(i.alt, '')), ' ')), '{X.DISCLOSED}')"
    pages = audit.facts.where("html_200").selectExpr(
        "crawl_id", "normalized_url", f"{news} as typed", "f.truncated as cut", f"{contact} or {org.format('email')} or {org.format('telephone')} or {org.format('contactPoint')} as contact", f"{about} or {org.format('name')} as publisher",
        "coalesce(x.derived.article.author, x.authorship.byline, x.authorship.meta_author, nullif(trim(x.authorship.article_author), '')) as author",
        "coalesce(x.derived.article.published, nullif(trim(x.authorship.published_time), '')) as dated", "size(x.authorship.times) as times", f"{sponsored} and not {told} as undisclosed",
    ).join(feed, ["crawl_id", "normalized_url"], "left")
    span = "try_cast(concat(left(fed, 10), '{}') as timestamp)"
    early = f"if(length(trim(fed)) = 10, {span.format('T00:00:00+14:00')}, try_cast(fed as timestamp))"
    late = f"if(length(trim(fed)) = 10, {span.format('T23:59:59-12:00')}, try_cast(fed as timestamp))"
    redated = f"{WHEN.format('dated')} < {early} - interval 1 day or {WHEN.format('dated')} > {late} + interval 1 day"
    is_news = "(fed is not null or typed)"
    return judged(
        "news-article-policy", audit,
        [
            (pages, {
                "articles": f"count_if({is_news} and not cut)", "cut": f"count_if({is_news} and cut)", "redated": f"count_if({is_news} and not cut and ({redated}))", "undisclosed": f"count_if({is_news} and not cut and undisclosed)",
                "no_author": f"count_if({is_news} and not cut and author is null)", "no_date": f"count_if({is_news} and not cut and dated is null and times = 0)", "contacts": "count_if(contact)", "publishers": "count_if(publisher)",
            }),
            (feed, {"fed": "count(*)"}),
        ],
        (ERROR, "articles = 0 and (cut > 0 or fed > 0)", "No listed article was read."), (NA, "articles = 0", "The site offers no news."), (FAIL, "redated + undisclosed > 0", "{redated} redated, {undisclosed} undisclosed article(s)."),
        (WARN, "no_author + no_date > 0 or contacts = 0 or publishers = 0", "{no_author} without author, {no_date} without date, or no contact or publisher."), (PASS, "true", "{articles} news article(s) are attributed and dated."),
    )


_PLAYERS = "filter(x.frames, p -> rlike(p.src, '(?i)youtube(-nocookie)?[.]com/embed|player[.]vimeo[.]com|dailymotion[.]com/embed|fast[.]wistia'))"
_VIDEOS = f"size(filter(x.media, i -> i.kind = 'video' and not i.ambient)) + size({_PLAYERS})"


@site("video-watch-page")
def video_watch_page(audit: Audit) -> DataFrame:
    urls = f"concat(transform(filter(x.media, i -> i.kind = 'video'), i -> coalesce(i.poster, '')), transform({_PLAYERS}, p -> p.src), transform(x.derived.videos, v -> coalesce(v.content_url, '')))"
    rows = audit.facts.where("is_html").withColumn("own", F.expr(f"filter({urls}, u -> u <> '' and {NETLOC.format('u')} = site_netloc)"))
    rows = rows.withColumn("barred", R.blocked_of(F.col("robots_txt"), "Googlebot", F.col("own")))
    thumb = "exists(x.media, i -> i.kind = 'video' and i.poster is not null) or exists(x.derived.videos, v -> v.thumbnail) or x.open_graph['og:image'] is not null"
    return observed(
        rows, "video-watch-page",
        [
            (NA, f"({_VIDEOS}) = 0", "The page has no player."), (NA, f"x.derived.product is not null or {IS_ARTICLE}", "The video accompanies a product or article."), (NA, "f.status is null or f.status <> 200", "Response was not a 200."),
            (FAIL, "any_noindex", "The watch page is noindex."), (FAIL, "size(barred) > 0", "robots.txt blocks {size(barred)} player or thumbnail URL(s)."),
            (WARN, f"(x.canonical_target is not null and x.canonical_target <> normalized_url) or not ({thumb}) or not exists(x.headings, h -> h.level = 1) or x.word_count < 50", "Canonical elsewhere, no thumbnail, no h1, or under 50 words."),
            (PASS, "true", "The watch page may be indexed."),
        ],
        "page", "normalized_url",
    )


@site("videoobject-schema")
def videoobject_schema(audit: Audit) -> DataFrame:
    shown = F.expr(f"concat(transform(filter(x.media, i -> i.kind = 'video' and not i.ambient), i -> coalesce(i.src, '')), transform({_PLAYERS}, p -> p.src))")
    named = F.expr("array_compact(flatten(transform(x.derived.videos, v -> array(v.content_url, v.embed_url))))")
    rows = audit.facts.where("is_html").withColumn("players", F.transform(shown, S.media_id)).withColumn("marked", F.array_compact(F.transform(named, S.media_id)))
    return observed(
        rows, "videoobject-schema",
        [
            (NA, f"({_VIDEOS}) = 0 and size(x.derived.videos) = 0", "The page has no video."), (FAIL, "x.json_ld_errors > 0", "JSON-LD does not parse."), (FAIL, "size(x.derived.videos) = 0", "A player without VideoObject."),
            (FAIL, "exists(x.derived.videos, v -> not v.name or not v.thumbnail or v.uploaded is null)", "A VideoObject lacks a required field."),
            (FAIL, f"exists(x.derived.videos, v -> {WHEN.format('v.uploaded')} is null)", "An upload date is no date."),
            (WARN, "size(players) > size(x.derived.videos) or (size(players) > 0 and size(marked) > 0 and not arrays_overlap(players, marked))", "Players and markup do not match."),
            (PASS, "true", "{size(x.derived.videos)} VideoObject(s) are complete."),
        ],
        "page", "normalized_url",
    )


@site("video-sitemap")
def video_sitemap(audit: Audit) -> DataFrame:
    docs = audit.sitemaps.withColumn("named", F.expr("rlike(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '" + X.VIDEO_NAME + "')"))
    rows = audit.sitemap_video.join(audit.site_facts.select("crawl_id", "site_netloc", "robots_txt"), "crawl_id")
    rows = rows.withColumn("own", F.expr(f"filter(array_compact(array(loc, thumbnail_url, content_url, player_url)), u -> {NETLOC.format('u')} = site_netloc)")).withColumn("barred", R.blocked_of(F.col("robots_txt"), "Googlebot", F.col("own")))
    pages = rows.selectExpr("crawl_id", "loc as target").distinct().join(audit.facts.where("html_200").selectExpr("crawl_id", "normalized_url as target", f"({_VIDEOS}) + size(x.derived.videos) as videos"), ["crawl_id", "target"])
    missing = "title is null or description is null or thumbnail_url is null or (content_url is null and player_url is null)"
    return judged(
        "video-sitemap", audit,
        [
            (docs, {"unfetched": "count_if(named and (status is null or status <> 200))", "cut": "count_if(truncated and video_count > 0)"}),
            (rows, {"n": "count(*)", "bad": f"count_if({missing}) + count_if(size(barred) > 0)", "elsewhere": f"count_if(not ({_OWN}))"}), (pages, {"empty": "count_if(videos = 0)"}),
        ],
        (FAIL, "unfetched > 0", "{unfetched} video sitemap(s) could not be fetched."), (NA, "n = 0 and cut = 0", "No video entries."), (FAIL, "bad > 0", "{bad} defect(s) in {n} video entries."), (ERROR, "cut > 0", "{cut} sitemap(s) were cut."),
        (WARN, "empty + elsewhere > 0", "{empty} page(s) show no video, {elsewhere} entries are on another host."), (PASS, "true", "{n} video entries are complete."),
    )


# ---- brand, locations, analytics plans


_FOLD = "lower(regexp_replace(regexp_replace({}, '^https?://(www[.])?', ''), '/+$', ''))"


@site("brand-entity-consistency")
def brand_entity_consistency(audit: Audit) -> DataFrame:
    nodes = audit.facts.where("html_200").selectExpr("crawl_id", "explode(x.derived.organizations) as o").join(recorded(audit, "brand"), "crawl_id")
    known = f"transform(rec.profiles, p -> {_FOLD.format('p')})"
    seen = nodes.selectExpr("crawl_id", "explode(o.same_as) as s").selectExpr("crawl_id", f"{_FOLD.format('s')} as profile").distinct()
    absent = recorded(audit, "brand").selectExpr("crawl_id", f"explode({known}) as profile").join(seen, ["crawl_id", "profile"], "left_anti")
    return on_record(
        "brand-entity-consistency", "brand",
        [(nodes, {"n": "count(*)", "bad": f"count_if(exists(o.same_as, s -> not array_contains({known}, {_FOLD.format('s')})) or (o.name is not null and not array_contains(transform(rec.names, m -> lower(trim(m))), lower(trim(o.name)))))"}), (absent, {"absent": "count(*)"})], audit,
        (NA, "n = 0", "No organization is marked up."), (FAIL, "bad > 0", "{bad} node(s) name another brand or profile."), (WARN, "absent > 0", "{absent} recorded profile(s) are not marked up."), HOLD, (PASS, "true", "{n} node(s) agree with the record."),
    )


@site("gbp-setup")
def gbp_setup(audit: Audit) -> DataFrame:
    rows = found_at(audit, entries(audit, "gbp", "locations"), "e.url", "x.derived.businesses as nodes")
    plain = "regexp_replace(lower(coalesce({}, '')), '[^\\\\p{{L}}\\\\p{{N}}]', '')"
    same = " and ".join(f"(n.{c} is null or {plain.format('n.' + c)} = {plain.format('e.' + c)})" for c in ("name", "address", "phone"))
    return on_record(
        "gbp-setup", "gbp", [(rows, {"n": "count(*)", "bad": f"count_if(size(nodes) > 0 and not exists(nodes, n -> {same}))", "silent": "count_if(crawled is null or size(nodes) = 0)"})], audit,
        (NA, "not rec.eligible", "The business is not eligible."), (FAIL, "bad > 0", "{bad} location(s) differ from their page."), (WARN, "rec.status = 'pending' or silent > 0", "Pending, or {silent} location(s) are unreached or not marked up."), HOLD,
        (PASS, "true", "All {n} location(s) agree."),
    )


_HITS = "filter(r.requests, u -> rlike(u, '/(g/)?collect([?]|$)'))"


@site("analytics-consent-matrix")
def analytics_consent_matrix(audit: Audit) -> DataFrame:
    named = f"transform({_HITS}, u -> regexp_extract(u, '[?&]en=([^&#]*)', 1))"
    rows = audit.facts.where("is_html").join(recorded(audit, "analytics"), "crawl_id", "left").withColumn("names", F.expr(named)).withColumn("held", F.expr(HELD))
    planned = "filter(rec.events, e -> e.status = 'planned' and e.trigger = 'load')"
    return observed(
        rows, "analytics-consent-matrix",
        [
            (NA, "rec is null", "No plan was supplied."), (NA, "r is null", "The page was not rendered."), (ERROR, "r.error is not null", "Rendering failed: {r.error}."),
            (FAIL, f"rec.consent_default = 'denied' and size({_HITS}) > 0", "A hit was sent before consent."), (FAIL, f"rec.consent_default <> 'denied' and exists({planned}, e -> not array_contains(names, e.name))", "A planned event is absent."),
            (FAIL, "size(names) > size(array_distinct(names))", "An event is sent twice."), (WARN, f"size({_HITS}) > 50", "The list of hits may be cut."), HOLD, (PASS, "true", "Hits agree with the plan."),
        ],
        "page", "normalized_url",
    )


@site("live-analytics-smoke")
def live_analytics_smoke(audit: Audit) -> DataFrame:
    shown = audit.facts.where("r is not null and r.error is null").selectExpr("crawl_id", "normalized_url", f"explode({_HITS}) as u").selectExpr("crawl_id", "normalized_url", "regexp_extract(u, '[?&]en=([^&#]*)', 1) as name", "regexp_extract(u, '[?&]tid=([^&#]*)', 1) as id")
    plan = entries(audit, "analytics", "events").selectExpr("crawl_id", "e.name as name", "e.status as planned")
    seen = shown.groupBy("crawl_id", "name").agg(F.count("*").alias("hits"))
    ids = shown.join(recorded(audit, "analytics").selectExpr("crawl_id", "rec.measurement_ids as ids"), "crawl_id").where("id <> '' and not array_contains(ids, id)")
    live = _on_production(audit).groupBy("crawl_id").agg(F.max("live").alias("live"))
    met = plan.join(seen, ["crawl_id", "name"], "left")
    return on_record(
        "live-analytics-smoke", "analytics",
        [(live, {"on_live": "count_if(live)"}), (met, {"absent": "count_if(planned in ('planned', 'sent') and hits is null)", "unwanted": "count_if(planned = 'suppressed' and hits > 0)"}), (ids, {"foreign": "count(distinct id)"}), (shown, {"hits": "count(*)"})], audit,
        (NA, "on_live = 0", "The crawl is not known to be of production."), (WARN, "hits = 0", "No page was rendered with hits."), (FAIL, "absent + unwanted + foreign > 0", "{absent} event(s) absent, {unwanted} unwanted, {foreign} foreign id(s)."), HOLD,
        (PASS, "true", "Events agree with the plan."),
    )

