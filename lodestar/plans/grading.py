"""Observations graded against a catalogue of checks.

Every check is graded once per crawl by the first row of an ordered ladder that
fits; observations are tallied per (crawl, detector) before they meet the
catalogue, so that the join carries counts and not observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.audit import Audit
from lodestar.operators.page_detectors import PAGE
from lodestar.operators.site_detectors import AFTER, SITE
from lodestar.sources.scratch import written


def implemented() -> list[str]:
    """The ids of all detectors."""
    from lodestar.operators import record_detectors  # noqa: F401  registers its detectors

    return sorted({*PAGE, *SITE, *AFTER})


def scopes(checks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(crawl_id, check ..., scope, scope_rationale): checks against site profiles.

    ``profiles``: crawl_id, flags (null or empty: the profile is undecided)."""
    scope = F.expr("case when universal or arrays_overlap(checks.flags, profile) then 'yes' when size(profile) = 0 then 'review' else 'no' end")
    sites = profiles.select("crawl_id", F.coalesce("flags", F.array().cast("array<string>")).alias("profile"))
    # a catalogue has about a hundred checks; it is met with every profile
    met = checks.alias("checks").join(sites, F.lit(True))
    why = F.when(scope == "no", F.concat(F.lit("The profile claims none of: "), F.array_join("checks.flags", ", "), F.lit(".")))
    return met.select("crawl_id", "checks.*", scope.alias("scope"), why.alias("scope_rationale"))


def tallies(observations: DataFrame) -> DataFrame:
    """Counts of outcomes per (crawl, detector)."""
    counts = [F.count_if(F.col("outcome") == o).alias(n) for o, n in (("pass", "passes"), ("warn", "warns"), ("fail", "fails"), ("error", "errors"), ("not-applicable", "nots"))]
    return observations.groupBy("crawl_id", "probe_id").agg(F.count("*").alias("observations"), *counts)


LADDER = (
    ("scope = 'no'", "not-started", "not-applicable", "out-of-scope"),
    ("scope = 'review'", "not-started", "unknown", "scope-undecided"),
    ("automation = 'attested'", "not-started", "unknown", "attested-only"),
    ("missing > 0", "not-started", "unknown", "detectors-missing"),
    ("silent > 0", "not-started", "unknown", "no-observation"),
    ("errors > 0", "not-started", "unknown", "probe-error"),
    ("fails > 0", "failed", "verified", "verified-fail"),
    ("warns > 0", "in-progress", "unknown", "held-by-warning"),
    ("automation = 'assisted'", "in-progress", "unknown", "awaiting-confirmation"),
    ("passes = 0", "passed", "not-applicable", "nothing-to-verify"),
    ("true", "passed", "verified", "verified-pass"),
)


def grade(checks: DataFrame, profiles: DataFrame, observations: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """One graded row per (crawl, check): scope, status, coverage, basis, counts and
    the failing detectors."""
    known = F.array(*[F.lit(d) for d in (implemented() if detectors is None else detectors)]).cast("array<string>")
    scoped = scopes(checks, profiles)
    bound = scoped.select("crawl_id", "id", F.explode("detectors").alias("probe_id"))
    met = bound.join(tallies(observations), ["crawl_id", "probe_id"], "left")
    sums = met.groupBy("crawl_id", "id").agg(
        F.count_if(~F.array_contains(known, F.col("probe_id"))).alias("missing"), F.count_if(F.coalesce("observations", F.lit(0)) == 0).alias("silent"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("observations", "passes", "warns", "fails", "errors", "nots")],
        F.array_sort(F.collect_set(F.when(F.col("fails") > 0, F.col("probe_id")))).alias("failing_detectors"),
    )
    out = scoped.join(sums, ["crawl_id", "id"], "left").fillna(0, ["missing", "silent", "observations", "passes", "warns", "fails", "errors", "nots"])
    whens = " ".join(f"when {c} then named_struct('status', '{s}', 'coverage', '{v}', 'basis', '{b}')" for c, s, v, b in LADDER)
    graded = out.withColumn("g", F.expr(f"case {whens} end"))
    return graded.select(
        "crawl_id", F.col("id").alias("check_id"), "phase", "launch_gate", "automation", F.col("scope").alias("applicability"), F.col("scope_rationale").alias("applicability_rationale"),
        "g.status", "g.coverage", "g.basis", "observations", "passes", "warns", "fails", "errors", F.col("nots").alias("not_applicable"), F.coalesce("failing_detectors", F.array()).alias("failing_detectors"),
    )


def evidence(graded: DataFrame, checks: DataFrame, observations: DataFrame) -> DataFrame:
    """(crawl_id, check_id, observation ...): the observations behind a grade."""
    bound = checks.select(F.col("id").alias("check_id"), F.explode("detectors").alias("probe_id"))
    linked = observations.join(bound, "probe_id")
    return linked.join(graded.where("basis not in ('out-of-scope', 'scope-undecided', 'attested-only')").select("crawl_id", "check_id", "basis"), ["crawl_id", "check_id"])


def probe_matrix(checks: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """Per check its detectors, which of them exist, and whether it can be covered."""
    known = set(implemented() if detectors is None else detectors)
    names = F.array(*[F.lit(d) for d in sorted(known)]).cast("array<string>")
    missing = F.array_except("detectors", names)
    coverable = (F.size("detectors") > 0) & (F.size(missing) == 0) & (F.col("automation") != "attested")
    return checks.select(F.col("id").alias("check_id"), "automation", "detectors", missing.alias("missing"), coverable.alias("coverable"))


def orphans(checks: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """Detectors that no check names."""
    spark = checks.sparkSession
    every = spark.createDataFrame([(d,) for d in (implemented() if detectors is None else detectors)], "probe_id string")
    return every.join(checks.select(F.explode("detectors").alias("probe_id")), "probe_id", "left_anti")


#: detectors that stand guard over a release, and for what
GUARDS = {
    "metadata-completeness": "noindex", "canonicalization": "canonical", "sitemap-canonical-agreement": "canonical", "robots-txt": "robots", "broken-links": "critical-link",
}


def guard(observations: DataFrame) -> DataFrame:
    """Per crawl: failures by concern, warnings, and whether the release may go on."""
    concern = F.create_map(*[F.lit(x) for pair in GUARDS.items() for x in pair])[F.col("probe_id")]
    rows = observations.withColumn("concern", concern)
    own = F.col("concern").isNotNull()
    return rows.groupBy("crawl_id").agg(
        F.count_if(own & (F.col("outcome") == "fail")).alias("failures"), F.count_if(own & (F.col("outcome") == "warn")).alias("warnings"),
        F.array_sort(F.collect_set(F.when(own & (F.col("outcome") == "fail"), F.col("concern")))).alias("concerns"),
    ).withColumn("passed", F.col("failures") == 0)


def observe(audit: Audit) -> DataFrame:
    """All observations of all detectors, in two stages: detectors that look at the crawl,
    written once, then those that look at the others' observations."""
    from lodestar.operators import record_detectors  # noqa: F401
    from lodestar.operators.page_detectors import page_observations

    first = page_observations(audit)
    for run in SITE.values():
        first = first.unionByName(run(audit))
    first = written(first, "observations")
    out = first
    for run in AFTER.values():
        out = out.unionByName(run(audit, first))
    return out


def gate_history(checks: DataFrame, previous: DataFrame, graded: DataFrame, reopened: DataFrame) -> DataFrame:
    """(crawl_id, passed_before, failing_now, reopened) of launch gates.

    ``previous``: crawl_id, check_id, status; ``reopened``: crawl_id, check_id."""
    gates = checks.where("launch_gate").select(F.col("id").alias("check_id"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("crawl_id").agg(F.array_sort(F.collect_set("check_id")).alias(name))

    before = listed(previous.where("status = 'passed'").join(gates, "check_id", "left_semi"), "passed_before")
    now = listed(graded.where("status = 'failed'").join(gates, "check_id", "left_semi"), "failing_now")
    out = graded.select("crawl_id").distinct().join(before, "crawl_id", "left").join(now, "crawl_id", "left").join(listed(reopened, "reopened"), "crawl_id", "left")
    none = F.array().cast("array<string>")
    return out.select("crawl_id", *[F.coalesce(c, none).alias(c) for c in ("passed_before", "failing_now", "reopened")])
