"""Comparisons between runs, and summaries of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_moves(now: DataFrame, before: DataFrame) -> DataFrame:
    """Checks that are new, dropped, or whose status or basis changed."""
    a = now.select("site", "check_id", F.struct("status", "basis").alias("now"))
    b = before.select("site", "check_id", F.struct("status", "basis").alias("before"))
    both = a.join(b, ["site", "check_id"], "full")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "dropped").otherwise("moved")
    return both.where(~F.col("now").eqNullSafe(F.col("before"))).select("site", "check_id", kind.alias("kind"), "before", "now")


def deltas(now: DataFrame, before: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """Figures of two runs side by side, with their difference (missing: 0)."""
    a = now.select(*keys, *[F.col(f).alias(f"{f}_now") for f in figures])
    b = before.select(*keys, *[F.col(f).alias(f"{f}_before") for f in figures])
    both = a.join(b, keys, "full").fillna(0)
    return both.select(*keys, *[c for f in figures for c in (f"{f}_before", f"{f}_now", (F.col(f"{f}_now") - F.col(f"{f}_before")).alias(f"{f}_delta"))])


def settings_differ(now: DataFrame, before: DataFrame) -> DataFrame:
    """Settings (run-wide key, value rows) that two runs do not share."""
    both = now.withColumnRenamed("value", "now").join(before.withColumnRenamed("value", "before"), "key", "full")
    return both.where(~F.col("now").eqNullSafe(F.col("before")))


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Per crawl: pages, errors, answers that are no 2xx, median time to first byte
    if there is one (rounded, halves up)."""
    ttfb = F.floor(F.percentile("ttfb_ms", 0.5) + 0.5) if "ttfb_ms" in pages.columns else F.lit(None).cast("long")
    status = F.col("fetch.status")
    return pages.groupBy("crawl_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("fetch.error").isNotNull()).alias("errors"), F.count_if(status.isNotNull() & ~status.between(200, 299)).alias("not_2xx"),
        F.count_if(F.col("extracted").isNotNull()).alias("html"), F.max("depth").alias("deepest"), F.sum("fetch.byte_length").alias("bytes"), ttfb.alias("median_ttfb_ms"),
    )


def render_summary(pages: DataFrame) -> DataFrame:
    """Per crawl: pages rendered, renders that failed."""
    return pages.groupBy("crawl_id").agg(
        F.count_if(F.col("rendered").isNotNull()).alias("rendered"), F.count_if(F.col("rendered.error").isNotNull()).alias("failed"), F.count_if(F.col("rendered_mobile").isNotNull()).alias("mobile")
    )


def observation_summary(observations: DataFrame) -> DataFrame:
    """Per crawl: observations by outcome and distinct detectors."""
    outcomes = ("pass", "warn", "fail", "error", "not-applicable")
    return observations.groupBy("crawl_id").agg(
        F.count("*").alias("observations"), F.countDistinct("probe_id").alias("detectors"), *[F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in outcomes]
    )


def basis_histogram(graded: DataFrame) -> DataFrame:
    return graded.groupBy("crawl_id", "basis").agg(F.count("*").alias("checks"))


def failure_tally(observations: DataFrame, top: int = 8) -> DataFrame:
    """The detectors with most failures, over all crawls: a top-k report."""
    fails = observations.where("outcome = 'fail'").groupBy("probe_id").agg(F.count("*").alias("fails"), F.countDistinct("crawl_id").alias("crawls"))
    return fails.orderBy(F.desc("fails"), "probe_id").limit(top)


def phase_moves(now: DataFrame, before: DataFrame) -> DataFrame:
    """Progress rows of two audits over the union of their phases."""
    return deltas(now, before, ["phase"], ["active", "passed", "failed", "percent"])


def evidence_drilldown(links: DataFrame, observations: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence of checks with its observation and, where it has one, its page."""
    return links.join(observations, "observation_id").join(pages, "page_id", "left")


def recent(audits: DataFrame, sites: DataFrame, limit: int = 20) -> DataFrame:
    """The newest audits with their site: a top-k report."""
    return audits.join(sites, "site_id").orderBy(F.desc("created_at"), "audit_id").limit(min(limit, 100))


def latest_complete(audits: DataFrame) -> DataFrame:
    """Per site the audit that was completed last, other than the current one."""
    done = audits.where("status = 'complete' and not coalesce(current, false)")
    return done.groupBy("site_id").agg(F.max_by("audit_id", F.struct("finished_at", "audit_id")).alias("audit_id"))


def totals(sites: DataFrame) -> DataFrame:
    """Sums over a run's sites (pages, graded, total, passed, failed, in_progress, decision);
    one without graded checks (null) failed.  No row for fewer than two that did not."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "graded", "total", "passed", "failed", "in_progress")]
    done = sites.where("graded is not null")
    failed = sites.agg(F.count_if(F.col("graded").isNull()).alias("not_analyzed"))
    out = done.agg(F.count("*").alias("analyzed"), *sums, F.count_if(F.col("decision") == "GO").alias("go"), F.count_if(F.col("decision") == "HOLD").alias("hold"))
    share = F.when(F.col("total") > 0, F.floor(F.col("graded") / F.col("total") * 100 + 0.5)).otherwise(0).cast("int")
    return out.join(failed, F.lit(True)).where("analyzed >= 2").withColumn("percent", share)  # two rows meet


def audits_of(audits: DataFrame, site_id: str | int) -> DataFrame:
    """A site's audits, the newest first."""
    return audits.where(F.col("site_id") == F.lit(site_id)).orderBy(F.desc("created_at"), F.desc("audit_id"))


def without_sites(gone: DataFrame, sites: DataFrame, audits: DataFrame, *of_audits: DataFrame) -> list[DataFrame]:
    """Tables once sites are deleted: their audits go, and all rows of those."""
    left = audits.join(gone.select("site_id"), "site_id", "left_anti")
    ended = audits.join(gone.select("site_id"), "site_id", "left_semi").select("audit_id")
    return [sites.join(gone.select("site_id"), "site_id", "left_anti"), left, *[t.join(ended, "audit_id", "left_anti") for t in of_audits]]


def resolved_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the page that they lead to; those to no page stay."""
    to = pages.select("crawl_id", F.col("normalized_url").alias("target"), F.col("page_id").alias("to_page_id"))
    return links.join(to, ["crawl_id", "target"], "left")


def violations(states: DataFrame, observations: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows that break what the tables promise, as (rule, key)."""
    rules = [
        states.where("applicability = 'no' and trim(coalesce(applicability_rationale, '')) = ''").select(F.lit("excluded_needs_rationale").alias("rule"), F.concat_ws("/", "crawl_id", "check_id").alias("key")),
        states.where("coverage = 'attested' and attestation_expires_at is null").select(F.lit("attestation_needs_expiry"), F.concat_ws("/", "crawl_id", "check_id")),
        observations.where("(scope = 'page') <> (page_url is not null)").select(F.lit("page_scope_needs_page"), F.concat_ws("/", "crawl_id", "probe_id")),
        pages.groupBy("crawl_id", "url").count().where("count > 1").select(F.lit("page_is_unique"), F.concat_ws("/", "crawl_id", "url")),
        states.groupBy("crawl_id", "check_id").count().where("count > 1").select(F.lit("state_is_unique"), F.concat_ws("/", "crawl_id", "check_id")),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.union(rule)
    return out


def joined_checks(checks: DataFrame, states: DataFrame) -> DataFrame:
    """The catalogue with the state of each check; one without a state is not started."""
    out = checks.withColumnRenamed("id", "check_id").join(states.drop("phase", "launch_gate", "automation"), "check_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("not-started"))).withColumn("applicability", F.coalesce("applicability", F.when(F.col("universal"), "yes").otherwise("review")))


def tiles(joined: DataFrame) -> DataFrame:
    """Counts by status over checks in scope, and checks whose scope is open."""
    on = F.col("applicability") == "yes"
    names = ("passed", "failed", "in-progress", "not-started", "skipped")
    return joined.agg(F.count_if(on).alias("active"), *[F.count_if(on & (F.col("status") == s)).alias(s.replace("-", "_")) for s in names], F.count_if(F.col("applicability") == "review").alias("review"))


def check_table(joined: DataFrame, search: str | None = None, gates_only: bool = False, **equal: str | int) -> DataFrame:
    """Checks that fit all filters: equal columns, gates, a text in id or title."""
    out = joined.where("launch_gate") if gates_only else joined
    for column, value in equal.items():
        out = out.where(F.col(column) == F.lit(value))
    if search:
        needle = F.lit(search.lower())
        out = out.where(F.contains(F.lower("title"), needle) | (F.col("check_id") == search))
    return out


def best_sources(checks: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """(check_id, topic, source_id, overlap): for each topic that a check names, the source
    whose topic shares most of its words, if that is at least ``least`` of them.

    ``checks``: check_id, topic; ``sources``: source_id, topic.  Topics decide, so that each
    different one is compared once: of sources with the same words only the one of the
    greatest id can be best.  Topics meet on as few of their rarest words as ``least``
    allows (one that shares s of n words shares one of any n - s + 1), and are then
    compared whole."""

    def worded(rows: DataFrame) -> DataFrame:
        tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("topic"), F.lit(r"([\p{L}\p{N}]+)"), 1)))
        return rows.withColumn("tokens", tokens).where(F.size("tokens") > 0)

    a = worded(checks.select("topic").distinct()).withColumn("n", F.size("tokens"))
    b = worded(sources).groupBy("tokens").agg(F.max("source_id").alias("source_id")).withColumnRenamed("tokens", "theirs")
    known = b.select(F.explode("theirs").alias("word"), "theirs", "source_id")
    often = known.groupBy("word").agg(F.count("*").alias("often"))
    each = a.select("topic", "tokens", "n", F.explode("tokens").alias("word")).join(often, "word", "left")
    rarest = each.groupBy("topic").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("words"))
    # a hair less than asked, so that no rounding loses a pair; the whole comparison decides
    asked = rarest.select("topic", "tokens", "n", F.explode(F.slice("words", F.lit(1), F.least("n", F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9)).cast("int") + 1))).alias("w"))
    met = asked.select("topic", "tokens", "n", F.col("w.word").alias("word")).join(known, "word").drop("word")
    overlap = met.select("topic", "source_id", F.size("theirs").alias("m"), (F.size(F.array_intersect("tokens", "theirs")) / F.col("n")).alias("overlap"))
    best = overlap.where(F.col("overlap") >= least).groupBy("topic").agg(F.max_by(F.struct("source_id", "overlap"), F.struct(F.col("overlap"), -F.col("m"), F.col("source_id"))).alias("b"))
    return checks.select("check_id", "topic").distinct().join(best, "topic").select("check_id", "topic", "b.source_id", "b.overlap")
