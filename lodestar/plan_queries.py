"""Queries of plans, sources and scalar functions over the driver's tables, each with
the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.detector_queries import AT, C, built_pages, customers, several
from lodestar.functions import robots as R
from lodestar.functions import scalars as S
from lodestar.functions import url as U
from lodestar.plans import compare, grading, queue, readiness
from lodestar.queries import _CHECKS, _catalogue, query, read
from lodestar.schemas import CHECKS
from lodestar.sources import feeds, records, sitemaps, store
from lodestar.sources.scratch import written

CHK = "(VALUES " + ", ".join(f"({j}, '{i}', {p}, {str(g).lower()}, {str(u).lower()}, '{a}', '{d}')" for j, (i, p, g, a, u, _, d) in enumerate(_CHECKS)) + ") AS chk(j, id, phase, gate, universal, automation, detectors)"
_ASSESSED = "2026-01-01 00:00:00"


def _each_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites, with every check of a small catalogue (j counts them)."""
    ids = F.array(*[F.lit(c[0]) for c in _CHECKS])
    return several(customers(spark, sf_dir), len(_CHECKS), "j").withColumn("check_id", F.get(ids, F.col("j")))


# ---- states, attestations, readiness

_STATE = {
    "applicability": "case (k + j) % 5 when 0 then 'no' when 1 then 'review' else 'yes' end", "applicability_rationale": "case when (k + j) % 5 = 0 and k % 2 = 1 then 'sold' else '' end",
    "status": "case (k + 2 * j) % 4 when 1 then 'failed' when 3 then 'skipped' else 'passed' end", "coverage": "case when (k + j) % 3 = 0 then 'attested' else 'verified' end",
    "attestation_expires_at": "case when k % 13 = 0 then null when bal < 0 then timestamp '2025-06-01 00:00:00' else timestamp '2027-01-01 00:00:00' end",
}


def _site_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_check(spark, sf_dir).where("(k + j) % 7 <> 0").selectExpr("crawl_id", "check_id", *[f"{e} as {n}" for n, e in _STATE.items()])


_STATES = f"""
WITH s0 AS (SELECT c.*, chk.*, (k + j) % 7 <> 0 AS there, {', '.join(f'{e} AS x_{n}' for n, e in _STATE.items())} FROM {C} c, {CHK}),
s1 AS (SELECT *, CASE WHEN there THEN x_applicability WHEN universal THEN 'yes' ELSE 'review' END AS scope, CASE WHEN there THEN x_status ELSE 'not-started' END AS was,
       there AND x_coverage = 'attested' AND (x_attestation_expires_at IS NULL OR x_attestation_expires_at <= TIMESTAMP '2026-01-01 00:00:00') AS lapsed, CASE WHEN there THEN x_applicability_rationale ELSE '' END AS why FROM s0),
s AS (SELECT *, CASE WHEN lapsed AND was = 'passed' THEN 'in-progress' ELSE was END AS status FROM s1)
"""


@query(_STATES + """
SELECT crawl_id, count(*) FILTER (WHERE gate AND scope = 'yes' AND status <> 'passed') AS gates_outstanding, count(*) FILTER (WHERE gate AND scope = 'yes' AND was = 'passed' AND status <> 'passed') AS attestations_lapsed,
       count(*) FILTER (WHERE scope = 'no' AND why = '') AS excluded_without_rationale, count(*) FILTER (WHERE gate AND scope = 'yes' AND status = 'skipped') AS skipped_gates,
       coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE (scope = 'no' AND why = '') OR (gate AND scope = 'yes' AND status = 'skipped')), '') AS violations,
       CASE WHEN count(*) FILTER (WHERE gate AND (scope = 'review' OR scope = 'yes' AND status <> 'passed')) = 0 THEN 'GO' ELSE 'HOLD' END AS decision FROM s GROUP BY 1
""")
def attested_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = written(_site_states(spark, sf_dir), "states")
    sites = customers(spark, sf_dir).select("crawl_id", F.lit(_ASSESSED).cast("timestamp").alias("assessed_at"))
    out = readiness.launch_readiness(_catalogue(spark), states, sites)
    return out.select("crawl_id", "gates_outstanding", "attestations_lapsed", "excluded_without_rationale", "skipped_gates", F.array_join("violations", ",").alias("violations"), "decision")


@query(_STATES + """
SELECT 'excluded_needs_rationale' AS rule, count(*) AS n FROM s WHERE there AND x_applicability = 'no' AND why = '' UNION ALL
SELECT 'attestation_needs_expiry', count(*) FROM s WHERE there AND x_coverage = 'attested' AND x_attestation_expires_at IS NULL UNION ALL
SELECT 'page_scope_needs_page', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'page_is_unique', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'state_is_unique', count(*) FROM s WHERE there AND k % 9 = 0
""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    states = written(_site_states(spark, sf_dir), "states")
    twice = states.withColumn("times", F.when(F.col("crawl_id").cast("long") % 9 == 0, 2).otherwise(1))
    observations = rows.selectExpr("crawl_id", "'p' as probe_id", "if(k % 2 = 0, 'page', 'site') as scope", "if((k % 3 = 0) <> (k % 2 = 0), '/', null) as page_url")
    pages = several(rows, 2).where("i = 0 or bal < 0").selectExpr("crawl_id", "'/' as url")
    found = compare.violations(states, observations, pages).where("rule <> 'state_is_unique'")
    doubled = twice.select("crawl_id", "check_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i")).drop("i")
    again = compare.violations(doubled.selectExpr("*", "'yes' as applicability", "'' as applicability_rationale", "'' as coverage", "timestamp(null) as attestation_expires_at"), observations.limit(0), pages.limit(0))
    return found.unionByName(again).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""
WITH a AS (SELECT crawl_id, id, k, j, bal, CASE WHEN k % 4 = 0 THEN 'unknown' WHEN k % 4 = 1 AND bal < 0 THEN 'ended' WHEN k % 4 = 2 AND k % 3 = 0 THEN 'unexplained' ELSE 'taken' END AS told FROM {C}, {CHK} WHERE (k + j) % 2 = 0)
SELECT crawl_id, count(*) FILTER (WHERE told = 'taken') AS history, count(*) FILTER (WHERE told <> 'taken') AS refused, count(*) FILTER (WHERE told = 'taken') + (SELECT count(*) FROM {C} x, {CHK} WHERE x.crawl_id = a.crawl_id AND (x.k + chk.j) % 7 <> 0
  AND NOT ((x.k + chk.j) % 2 = 0 AND x.k % 4 <> 0 AND NOT (x.k % 4 = 1 AND x.bal < 0) AND NOT (x.k % 4 = 2 AND x.k % 3 = 0))) AS states FROM a GROUP BY crawl_id
""")
def recorded_attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _each_check(spark, sf_dir).where("(k + j) % 2 = 0").selectExpr(
        "crawl_id", "if(k % 4 = 0, concat('x', check_id), check_id) as check_id", "'me' as attested_by", "'done' as statement", "if(k % 4 = 1 and bal < 0, timestamp '2025-01-01', timestamp '2027-01-01') as expires_at",
        "'passed' as status", "if(k % 4 = 2 and k % 3 = 0, 'no', null) as applicability", "' ' as applicability_rationale",
    )
    history, states, refused = readiness.record_attestations(given, _catalogue(spark), _site_states(spark, sf_dir), F.lit(_ASSESSED).cast("timestamp"))
    of = [rows.groupBy("crawl_id").agg(F.count("*").alias(n)) for rows, n in ((history, "history"), (refused, "refused"), (states, "states"))]
    sites = given.select("crawl_id").distinct()
    for counts in of:
        sites = sites.join(counts, "crawl_id", "left")
    return sites.fillna(0)


_MERGED = ("1.5", "2.1", "4.2")


@query(f"""
WITH r AS (SELECT crawl_id, id AS check_id, k + j AS x FROM {C}, (VALUES (0, '1.5'), (1, '2.1'), (2, '4.2')) AS t(j, id))
SELECT crawl_id, check_id, CASE WHEN x % 5 <> 0 AND (x % 3 <> 0 OR (x % 2 = 0 AND check_id <> '2.1')) THEN CASE WHEN x % 2 = 0 THEN 'failed' ELSE 'passed' END ELSE 'attested' END AS status FROM r WHERE x % 5 <> 0 OR x % 3 = 0
""")
def merged_attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = several(customers(spark, sf_dir), 3, "j").withColumn("check_id", F.get(F.array(*map(F.lit, _MERGED)), F.col("j"))).withColumn("x", F.expr("k + j"))
    machine = rows.where("x % 5 <> 0").selectExpr("crawl_id", "check_id", "if(x % 2 = 0, 'failed', 'passed') as status", "if(x % 2 = 0, 'verified-fail', 'verified-pass') as basis")
    attested = rows.where("x % 3 = 0").selectExpr("crawl_id", "check_id", "'attested' as status")
    return readiness.merge_attested(machine, attested).select("crawl_id", "check_id", "status")


# ---- reviews and cutover


def _runs(rows: DataFrame, **given: str) -> DataFrame:
    told = {
        "site_id": "crawl_id", "run_id": "concat(crawl_id, '-', check_id, '-', r)", "check_id": "check_id", "release_id": "'r1'", "scope_revision": "'s1'", "criteria_revision": "'v'", "origin": f"'{AT}'", "environment": "'pre-production'",
        "tested_at": "timestamp '2025-10-01'", "tester": "'ann'", "result": "'passed'", "evidence": "'e'", "reviewed_by": "'bob'", "reviewed_at": "timestamp '2025-10-02'", "next_review_at": "timestamp '2026-06-01'", "event_trigger": "''",
    } | given
    return rows.selectExpr(*[f"{e} as {n}" for n, e in told.items()])


def _releases(rows: DataFrame, **given: str) -> DataFrame:
    told = {
        "crawl_id": "crawl_id", "site_id": "crawl_id", "release_id": "'r1'", "scope_revision": "'s1'", "origin": f"'{AT}'", "assessed_at": f"timestamp '{_ASSESSED}'", "criteria": "map('none', 'x')", "version": "'v'",
    } | given
    return rows.selectExpr(*[f"{e} as {n}" for n, e in told.items()])


_V = "(k + 3 * j) % 12"


@query(f"""
SELECT crawl_id, id AS check_id, CASE {_V} WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'invalid' WHEN 3 THEN 'reopened' WHEN 4 THEN 'failed' WHEN 5 THEN 'overdue' WHEN 6 THEN 'reconcile' WHEN 7 THEN 'current' WHEN 8 THEN 'unfinished'
 WHEN 10 THEN 'current' WHEN 11 THEN 'invalid' ELSE CASE WHEN k % 2 = 0 THEN 'review-required' ELSE 'not-reviewed' END END AS review_state FROM {C}, {CHK}
""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a check by v: 0 none, 1 two at one time, 2 no tester, 3 reopened, 4 failed, 5 overdue, 6 other evidence, 7 sound, 8 unfinished, 9 of another release, 10 cited, 11 one id twice."""
    rows = _each_check(spark, sf_dir).withColumn("v", F.expr(_V))
    runs = _runs(
        several(rows.where("v <> 0"), 2, "r").where("r = 0 or v in (1, 11)"), run_id="concat(crawl_id, '-', check_id, '-', if(v = 11, 0, r))", release_id="if(v = 9, 'r0', 'r1')", tester="if(v = 2, ' TBD ', 'ann')",
        tested_at="if(v = 11 and r = 1, timestamp '2025-09-01', timestamp '2025-10-01')", result="case v when 3 then 'reopened' when 4 then 'failed' when 8 then 'in-progress' else 'passed' end", event_trigger="if(v = 3, 'a change', '')",
        next_review_at="if(v = 5, timestamp '2025-12-31', timestamp '2026-06-01')", evidence="case v when 6 then 'other' when 10 then 'ref' else 'e' end",
    )
    states = rows.selectExpr("crawl_id", "check_id", "case when v = 8 then 'in-progress' when v = 4 then 'failed' when v in (0, 9) then if(k % 2 = 0, 'passed', 'failed') else 'passed' end as status", "'e' as evidence", "'ref' as evidence_ref")
    return readiness.read_reviews(_catalogue(spark), states, runs, _releases(customers(spark, sf_dir))).select("crawl_id", "check_id", "review_state")


_FEW = (("1.1", 1, True), ("5.1", 5, True), ("6.1", 1, False))


@query(f"""
WITH x AS (SELECT *, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS input_errors, CASE WHEN bal < 0 THEN 1 ELSE 0 END AS scope_errors, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS live_outstanding, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS pre_incomplete,
       CASE WHEN k % 5 = 0 OR k % 7 = 0 OR n % 4 = 0 THEN 1 ELSE 0 END AS live_incomplete, n % 5 <> 0 AND bal >= 0 AS record_valid FROM {C}),
y AS (SELECT *, input_errors = 0 AND scope_errors = 0 AND pre_incomplete = 0 AS ready FROM x),
z AS (SELECT *, CASE WHEN ready AND live_outstanding = 0 AND live_incomplete = 0 AND record_valid THEN 'GO' ELSE 'HOLD' END AS final FROM y)
SELECT crawl_id, CASE WHEN ready THEN 'READY FOR CUTOVER' ELSE 'HOLD' END AS cutover, final, input_errors, scope_errors, live_outstanding, pre_incomplete, live_incomplete, record_valid,
 CASE WHEN k % 3 = 0 THEN 'none' WHEN k % 3 = 1 THEN 'recorded' WHEN final = 'GO' THEN 'agrees' ELSE 'conflict' END AS launch_decision FROM z
""")
def cutover_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = spark.createDataFrame([("v", i, i, p, g, "automated", True, [], ["d"], "P0") for i, p, g in _FEW], CHECKS)
    rows = several(customers(spark, sf_dir), 3, "j").withColumn("check_id", F.get(F.array(*[F.lit(c[0]) for c in _FEW]), F.col("j")))
    states = rows.selectExpr("crawl_id", "check_id", "'yes' as applicability", "'' as applicability_rationale", "if(j = 1 and n % 4 = 0, 'failed', 'passed') as status", "'verified' as coverage", "timestamp(null) as attestation_expires_at", "'e' as evidence", "'' as evidence_ref")
    kept = rows.where("not (j = 0 and k % 4 = 0) and not (j = 1 and k % 5 = 0)").withColumn("r", F.lit(0))
    runs = _runs(kept, environment="if(j = 1, 'production', 'pre-production')", tested_at="if(j = 1 and k % 7 <> 0, timestamp '2025-12-20', timestamp '2025-10-01')", reviewed_at="timestamp '2025-12-21'")
    stray = _runs(rows.where("j = 0 and k % 6 = 0").withColumn("r", F.lit(9)), check_id="'9.9'")
    records = (
        "named_struct('authorizer', if(n % 5 = 0, 'n/a', 'ann'), 'decision_reference', 'd', 'authorized_at', timestamp '2025-12-01', 'cutover_at', timestamp '2025-12-10', 'release_id', 'r1', 'scope_revision', 's1', 'origin', '{0}', 'assessment', 'READY FOR CUTOVER')".format(AT)
    )
    releases = _releases(
        customers(spark, sf_dir), origin=f"if(bal < 0, 'http://example.com', '{AT}')", scope_approver="'ann'", scope_approved_at="timestamp '2025-09-01'", scope_approval_evidence="'mail'", decision_owner="'bob'", cutover=records,
        decision="case k % 3 when 0 then null when 1 then 'HOLD' else 'GO' end",
    )
    runs = runs.unionByName(stray).join(releases.select("site_id", F.col("origin").alias("at")), "site_id").withColumn("origin", F.col("at")).drop("at")
    out = readiness.cutover_readiness(checks, states, runs, releases)
    return out.select("crawl_id", "cutover", "final", "input_errors", "scope_errors", "live_outstanding", "pre_incomplete", "live_incomplete", "record_valid", "launch_decision")


# ---- the guard, matrices, gates and evidence

_PROBES = ("metadata-completeness", "canonicalization", "sitemap-canonical-agreement", "robots-txt", "broken-links", "click-depth", "http-status")
_CASES = " ".join(f"WHEN {i + 1} THEN '{p}'" for i, p in enumerate(_PROBES))


@query(f"""
WITH o AS (SELECT l_orderkey::VARCHAR AS crawl_id, CASE l_linenumber {_CASES} END AS p, CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE 'pass' END AS outcome FROM lineitem),
g AS (SELECT *, CASE p WHEN 'metadata-completeness' THEN 'noindex' WHEN 'canonicalization' THEN 'canonical' WHEN 'sitemap-canonical-agreement' THEN 'canonical' WHEN 'robots-txt' THEN 'robots' WHEN 'broken-links' THEN 'critical-link' END AS concern FROM o)
SELECT crawl_id, count(*) FILTER (WHERE concern IS NOT NULL AND outcome = 'fail') AS failures, count(*) FILTER (WHERE concern IS NOT NULL AND outcome = 'warn') AS warnings,
 coalesce(string_agg(DISTINCT concern, ',' ORDER BY concern) FILTER (WHERE outcome = 'fail'), '') AS concerns, count(*) FILTER (WHERE concern IS NOT NULL AND outcome = 'fail') = 0 AS passed FROM g GROUP BY 1
""")
def release_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _PROBES))
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("crawl_id"), F.get(names, F.col("l_linenumber") - 1).alias("probe_id"), F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").otherwise("pass").alias("outcome")
    )
    return grading.guard(rows).withColumn("concerns", F.array_join("concerns", ","))


@query(f"""
SELECT id AS check_id, coalesce(string_agg(d, ',') FILTER (WHERE d NOT IN ('d1', 'd2')), '') AS missing, any_value(automation) <> 'attested' AND count(*) FILTER (WHERE d NOT IN ('d1', 'd2')) = 0 AS coverable
FROM (SELECT *, unnest(string_split(detectors, ',')) AS d FROM {CHK}) GROUP BY 1
""")
def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.probe_matrix(_catalogue(spark), ["d1", "d2"]).select("check_id", F.array_join("missing", ",").alias("missing"), "coverable")


@query(f"""
WITH g AS (SELECT crawl_id, id, k, j FROM {C}, {CHK} WHERE gate)
SELECT crawl_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE (k + j) % 2 = 0), '') AS passed_before, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE (k + j) % 3 = 0), '') AS failing_now,
 coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE (k + j) % 4 = 0), '') AS reopened FROM g GROUP BY 1
""")
def gates_of_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each_check(spark, sf_dir)
    previous = rows.selectExpr("crawl_id", "check_id", "if((k + j) % 2 = 0, 'passed', 'failed') as status")
    graded = rows.selectExpr("crawl_id", "check_id", "if((k + j) % 3 = 0, 'failed', 'passed') as status")
    gates = [c[0] for c in _CHECKS if c[2]]
    reopened = rows.where("(k + j) % 4 = 0").where(F.col("check_id").isin(*gates)).select("crawl_id", "check_id")
    out = grading.gate_history(_catalogue(spark), previous, graded, reopened)
    return out.select("crawl_id", *[F.array_join(c, ",").alias(c) for c in ("passed_before", "failing_now", "reopened")])


@query(f"""
WITH o AS (SELECT l_orderkey::VARCHAR AS crawl_id, 'd' || l_linenumber AS p FROM lineitem), b AS (SELECT id, unnest(string_split(detectors, ',')) AS p FROM {CHK} WHERE id IN ('1.1', '1.2'))
SELECT crawl_id, id AS check_id, count(*) AS observations FROM o JOIN b ON o.p = b.p GROUP BY 1, 2
""")
def evidence_of_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("crawl_id"), F.concat(F.lit("d"), "l_linenumber").alias("probe_id"))
    crawled = rows.select("crawl_id").distinct()
    graded = crawled.select("crawl_id", F.explode(F.array(*[F.lit(c[0]) for c in _CHECKS])).alias("check_id")).withColumn("basis", F.when(F.col("check_id").isin("1.1", "1.2"), "verified-pass").otherwise("out-of-scope"))
    return grading.evidence(graded, _catalogue(spark), rows).groupBy("crawl_id", "check_id").agg(F.count("*").alias("observations"))


# ---- comparisons, tables of checks, sites

_PART = """
WITH c AS (SELECT p_partkey::VARCHAR AS check_id, p_name AS title, p_size % 5 AS phase, p_size % 3 = 0 AS gate, p_size % 2 = 0 AS universal, p_partkey % 4 <> 0 AS there, CASE p_partkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'in-progress' END AS s FROM part),
j AS (SELECT *, CASE WHEN there THEN s ELSE 'not-started' END AS status, CASE WHEN there THEN 'yes' WHEN universal THEN 'yes' ELSE 'review' END AS applicability FROM c)
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    checks = parts.selectExpr("string(p_partkey) as id", "p_name as title", "int(p_size % 5) as phase", "p_size % 3 = 0 as launch_gate", "p_size % 2 = 0 as universal")
    states = parts.where("p_partkey % 4 <> 0").selectExpr("string(p_partkey) as check_id", "case p_partkey % 3 when 0 then 'passed' when 1 then 'failed' else 'in-progress' end as status", "'yes' as applicability")
    return compare.joined_checks(checks, states)


@query(_PART + """
SELECT count(*) FILTER (WHERE applicability = 'yes') AS active, count(*) FILTER (WHERE applicability = 'yes' AND status = 'passed') AS passed, count(*) FILTER (WHERE applicability = 'yes' AND status = 'failed') AS failed,
 count(*) FILTER (WHERE applicability = 'yes' AND status = 'in-progress') AS in_progress, count(*) FILTER (WHERE applicability = 'yes' AND status = 'not-started') AS not_started, 0::BIGINT AS skipped, count(*) FILTER (WHERE applicability = 'review') AS review FROM j
""")
def check_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.tiles(_parts(spark, sf_dir))


@query(_PART + "SELECT check_id, title, status FROM j WHERE gate AND phase = 1 AND contains(lower(title), 'a')")
def check_table_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.check_table(_parts(spark, sf_dir), search="A", gates_only=True, phase=1).select("check_id", "title", "status")


@query("""
WITH f AS (SELECT c_nationkey AS phase, count(*) AS active, count(*) FILTER (WHERE c_acctbal >= 0) AS passed FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS phase, count(*) AS active, count(*) FILTER (WHERE s_acctbal >= 0) AS passed FROM supplier GROUP BY 1)
SELECT coalesce(f.phase, b.phase) AS phase, coalesce(f.active, 0) - coalesce(b.active, 0) AS active_delta, coalesce(f.passed, 0) - coalesce(b.passed, 0) AS passed_delta, 0::BIGINT AS failed_delta FROM f FULL JOIN b ON f.phase = b.phase
""")
def phase_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def phases(table: str, letter: str) -> DataFrame:
        rows = read(spark, sf_dir, table).groupBy(F.col(f"{letter}_nationkey").alias("phase")).agg(F.count("*").alias("active"), F.count_if(F.col(f"{letter}_acctbal") >= 0).alias("passed"))
        return rows.selectExpr("phase", "active", "passed", "bigint(0) as failed", "bigint(0) as percent")

    return compare.phase_moves(phases("customer", "c"), phases("supplier", "s")).select("phase", "active_delta", "passed_delta", "failed_delta")


@query("""
WITH a AS (SELECT c_name[10:] AS key, c_mktsegment AS v FROM customer), b AS (SELECT s_name[10:] AS key, CASE WHEN s_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS v FROM supplier)
SELECT coalesce(a.key, b.key) AS key, a.v AS now, b.v AS before FROM a FULL JOIN b ON a.key = b.key WHERE a.v IS DISTINCT FROM b.v
""")
def settings_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = read(spark, sf_dir, "customer").selectExpr("substring(c_name, 10) as key", "c_mktsegment as value")
    before = read(spark, sf_dir, "supplier").selectExpr("substring(s_name, 10) as key", "if(s_nationkey % 2 = 0, 'BUILDING', 'MACHINERY') as value")
    return compare.settings_differ(now, before).select("key", "now", "before")


@query(f"""
SELECT n::VARCHAR AS crawl_id, count(*) AS pages, count(*) FILTER (WHERE k % 5 = 0) AS errors, count(*) FILTER (WHERE k % 3 = 1) AS not_2xx, count(*) FILTER (WHERE k % 4 <> 0) AS html, max(k % 6)::INT AS deepest,
 count(*) FILTER (WHERE k % 2 = 0) AS rendered, count(*) FILTER (WHERE k % 10 = 0) AS failed FROM {C} GROUP BY 1
""")
def crawl_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir).withColumn("crawl_id", F.col("n").cast("string"))
    pages = written(built_pages(
        rows, url=f"concat('{AT}/', k)", html="if(k % 4 = 0, null, '<html>x</html>')", status="case k % 3 when 0 then 200 when 1 then 404 else null end", error="if(k % 5 = 0, 'timeout', null)", depth="k % 6", rendered="k % 2 = 0",
        render_error="if(k % 10 = 0, 'crash', null)",
    ), "pages")
    crawled = compare.crawl_summary(pages).select("crawl_id", "pages", "errors", "not_2xx", "html", "deepest")
    return crawled.join(compare.render_summary(pages).select("crawl_id", "rendered", "failed"), "crawl_id")


@query("""
SELECT count(*) FILTER (WHERE c_custkey % 7 <> 0) AS analyzed, sum(c_custkey % 50) FILTER (WHERE c_custkey % 7 <> 0)::BIGINT AS pages, sum(c_nationkey) FILTER (WHERE c_custkey % 7 <> 0)::BIGINT AS graded, 25 * count(*) FILTER (WHERE c_custkey % 7 <> 0) AS total,
 count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_acctbal >= 0) AS go, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_acctbal < 0) AS hold, count(*) FILTER (WHERE c_custkey % 7 = 0) AS not_analyzed,
 floor(sum(c_nationkey) FILTER (WHERE c_custkey % 7 <> 0) / (25 * count(*) FILTER (WHERE c_custkey % 7 <> 0))::DOUBLE * 100 + 0.5)::INT AS percent FROM customer
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = customers(spark, sf_dir).selectExpr(
        "k % 50 as pages", "if(k % 7 = 0, null, n) as graded", "25 as total", "1 as passed", "0 as failed", "0 as in_progress", "if(bal < 0, 'HOLD', 'GO') as decision"
    )
    return compare.totals(sites).select("analyzed", "pages", "graded", "total", "go", "hold", "not_analyzed", "percent")


@query("SELECT o_orderkey AS audit_id, o_orderdate AS created_at FROM orders WHERE o_custkey = 7")
def audits_of_a_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site's audits: the site is the query's parameter."""
    audits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("site_id"), F.col("o_orderdate").alias("created_at"))
    return compare.audits_of(audits, 7).select("audit_id", "created_at")


@query("""
SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS sites, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS audits,
 (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)) AS observations
""")
def deleted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), "c_acctbal")
    audits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("site_id"))
    observations = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("audit_id"))
    left = compare.without_sites(sites.where("c_acctbal < 0"), sites, audits, observations)
    counts = [t.agg(F.count("*").alias(n)) for t, n in zip(left, ("sites", "audits", "observations"), strict=True)]
    return counts[0].join(counts[1], F.lit(True)).join(counts[2], F.lit(True))  # one row each


# ---- queues and imports


@query("SELECT o_orderkey AS job_id, 1e9::BIGINT + least(30 * 4 ** (o_orderkey % 4), 600)::BIGINT AS due FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 + 1 < 3 AND o_orderpriority <> '5-LOW'")
def queue_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "orders").selectExpr("o_orderkey as job_id", "if(o_orderstatus = 'F', 'failed', 'done') as state", "int(o_orderkey % 4 + 1) as attempts", "o_orderpriority = '5-LOW' as permanent")
    return queue.retries(jobs, F.timestamp_seconds(F.lit(1_000_000_000))).select("job_id", F.unix_seconds("due_at").alias("due"))


@query("""
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 120 > 60) AS abandoned, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey % 3 <> 0) AS lost
""")
def queue_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    jobs = orders.selectExpr("o_orderkey as job_id", "if(o_orderstatus = 'O', 'running', 'queued') as state", "timestamp_seconds(1000000000 - o_orderkey % 120) as renewed_at")
    stale = queue.abandoned(jobs, F.timestamp_seconds(F.lit(1_000_000_000)), 60).agg(F.count("*").alias("abandoned"))
    audits = orders.selectExpr("o_orderkey as audit_id", "case o_orderstatus when 'F' then 'complete' when 'O' then 'queued' else 'running' end as status", "o_orderdate as created_at")
    lost = queue.lost_audits(audits, orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey as audit_id"), F.lit("1997-01-01").cast("timestamp"))
    return stale.join(lost.agg(F.count("*").alias("lost")), F.lit(True))  # one row each


@query("""
WITH l AS (SELECT o_orderkey::VARCHAR AS run, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey::VARCHAR AS run, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders)
SELECT (SELECT count(*) FROM n WHERE run NOT IN (SELECT run FROM l)) AS added, (SELECT count(*) FROM n JOIN l ON l.run = n.run WHERE n.s <> l.s) AS conflicts
""")
def imported_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    log = orders.where("o_orderkey % 2 = 0").selectExpr("'s' as site_id", "string(o_orderkey) as run_id", "o_orderstatus as result")
    staged = orders.selectExpr("'s' as site_id", "string(o_orderkey) as run_id", "if(o_orderkey % 5 = 0, 'X', o_orderstatus) as result")
    added, wrong = records.import_runs(log, staged)
    return added.agg(F.count("*").alias("added")).join(wrong.agg(F.count("*").alias("conflicts")), F.lit(True))  # one row each


@query(f"SELECT crawl_id, CASE WHEN n % 3 = 0 THEN 'shop2' ELSE 'blog' END AS flag FROM {C}")
def flags_not_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = customers(spark, sf_dir).selectExpr("crawl_id", "array('shop', if(n % 3 = 0, 'shop2', 'blog')) as flags")
    return records.unknown_flags(_catalogue(spark), profiles).select("crawl_id", "flag")


# ---- sources: bodies, links, sitemaps, feeds, robots


@query("""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT CASE doc_id % 4 WHEN 0 THEN 'not-stored' WHEN 1 THEN 'ok' WHEN 2 THEN 'corrupt' ELSE 'missing' END AS state, count(*) AS n FROM documents GROUP BY 1
""")
def archive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("body")).withColumn("hash", F.sha2(F.col("body").cast("binary"), 256))
    renders = docs.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("hash")).alias("body_hash"))
    stored = docs.where("doc_id % 4 in (1, 2)").select("hash", F.when(F.col("doc_id") % 4 == 1, F.col("body")).otherwise("changed").alias("body"))
    return store.read_back(renders, stored).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT text) AS fresh FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM conversations WHERE text IS NOT NULL AND turn = 0)")
def bodies_not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    stored = store.blobs(rows.where("turn = 0"), "text")
    return store.put_if_absent(store.blobs(rows, "text"), stored).agg(F.count("*").alias("fresh"))


@query(f"""
SELECT n::VARCHAR AS crawl_id, kind, count(*) AS edges FROM (
 SELECT n, unnest(['anchor', 'anchor', 'canonical', 'hreflang']) AS kind FROM {C} UNION ALL SELECT n, 'pagination' FROM {C} WHERE k % 2 = 0 UNION ALL SELECT n, 'redirect' FROM {C} WHERE k % 3 = 0) GROUP BY 1, 2
""")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir).withColumn("crawl_id", F.col("n").cast("string"))
    html = (
        "concat('<html><head><link rel=\"canonical\" href=\"/c\"><link rel=\"alternate\" hreflang=\"de\" href=\"/de\"></head><body><a href=\"/a\">a</a><a href=\"/b\"', if(k % 2 = 0, ' rel=\"next\"', ''), '>b</a></body></html>')"
    )
    chain = "if(k % 3 = 0, array(named_struct('url', '/', 'status', 301, 'location', '/')), array())"
    pages = built_pages(rows, url=f"concat('{AT}/', k)", html=html, chain=f"cast({chain} as array<struct<url:string,status:int,location:string>>)")
    return store.page_links(pages).groupBy("crawl_id", "kind").agg(F.count("*").alias("edges"))


@query(f"SELECT crawl_id, CASE WHEN n % 4 = 0 THEN 1 ELSE 2 END AS urls, CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS news, CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END AS videos, n % 4 = 0 AS cut FROM {C}")
def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (
        "concat('<?xml version=\"1.0\"?><urlset xmlns:news=\"n\" xmlns:video=\"v\"><url><loc>https://a.b/', k, '</loc>', if(n % 4 = 1, '<news:news><news:title>T</news:title></news:news>', ''), "
        "if(n % 4 = 2, '<video:video><video:title>V</video:title></video:video>', ''), '</url><url><loc>https://a.b/x</loc>', if(n % 4 = 0, '', '</url></urlset>'))"
    )
    out = sitemaps.parsed(customers(spark, sf_dir).selectExpr("crawl_id", f"{body} as body"))
    return out.selectExpr("crawl_id", "size(urls) as urls", "size(news) as news", "size(video) as videos", "cut")


@query("SELECT p_partkey::VARCHAR AS id, round(p_retailprice, 2) AS price, CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'SEK' END AS currency, CASE WHEN p_size % 3 = 0 THEN 'in stock' ELSE 'out of stock' END AS availability FROM part")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "part").selectExpr(
        "string(p_partkey) as id", f"concat('{AT}/', p_partkey) as link", "concat(format_string('%.2f', p_retailprice), ' ', if(p_size % 2 = 0, 'EUR', 'SEK')) as price", "if(p_size % 3 = 0, 'In_Stock', ' out_of_stock ') as availability",
        "string(null) as gtin", "p_brand as brand",
    )
    return feeds.items(raw).select("id", "price", "currency", "availability")


@query("""
SELECT p_partkey::VARCHAR AS id, (CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END)::INT AS problems FROM part
""")
def feed_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "part").selectExpr(
        "string(p_partkey) as id", f"if(p_size % 4 = 0, 'example.com', concat('{AT}/', p_partkey)) as link", "if(p_size % 5 = 0, '9,50', '9.50 EUR') as price", "if(p_size % 7 = 0, ' ', 'in stock') as availability", "string(null) as gtin", "string(null) as brand"
    )
    return feeds.checked(raw).select("id", F.size("problems").alias("problems"))


@query(f"SELECT crawl_id, CASE WHEN n % 6 = 0 THEN false WHEN n % 6 IN (1, 2) THEN true ELSE k % 2 = 0 END AS allowed, CASE WHEN n % 6 IN (0, 1, 2) THEN NULL ELSE n % 5 + 0.5 END AS delay FROM {C}")
def robots_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n % 6: 0 a server error, 1 not found, 2 no answer, else a text."""
    text = "concat('User-agent: *\\nCrawl-delay: ', n % 5, '.5\\nDisallow: /', if(k % 2 = 0, 'x', 'p'), '\\n')"
    rows = customers(spark, sf_dir).selectExpr("crawl_id", "case n % 6 when 0 then 503 when 1 then 404 when 2 then null else 200 end as status", f"{text} as text", f"array('{AT}/p/1') as urls")
    held = rows.withColumn("held", R.effective(F.col("status"), F.col("text")))
    return held.select("crawl_id", F.element_at(R.allowed_each(F.col("held"), "Anybot", F.col("urls")), 1).alias("allowed"), F.get(R.groups(F.col("held")), F.lit(0))["delay"].alias("delay"))


# ---- scalars


@query("SELECT l_returnflag AS flag, count(*) FILTER (WHERE gap > 0.5) AS far, round(max(gap), 9) AS most FROM (SELECT l_returnflag, coalesce(abs(l_tax - l_discount) / nullif(greatest(l_tax, l_discount), 0), 0) AS gap FROM lineitem) GROUP BY 1")
def scalar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), S.figure_gap(F.col("l_tax"), F.col("l_discount")).alias("gap"))
    return rows.groupBy("flag").agg(F.count_if(F.col("gap") > 0.5).alias("far"), F.round(F.max("gap"), 9).alias("most"))


@query("""
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'v' || s_suppkey WHEN 1 THEN 'clip' || s_suppkey WHEN 2 THEN 'abc' ELSE NULL END AS media, CASE s_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS covers,
 CASE s_suppkey % 3 WHEN 0 THEN 38.0 WHEN 1 THEN 0.0 ELSE NULL END AS hours FROM supplier
""")
def scalar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("s_suppkey"), F.col("s_nationkey") % 4
    url = F.when(key % 4 == 0, F.concat(F.lit("https://v.net/watch?x=1&v=v"), key, F.lit("#t"))).when(key % 4 == 1, F.concat(F.lit("https://v.net/embed/clip"), key, F.lit("/?a=b"))).when(key % 4 == 2, "https://v.net/abc").otherwise("https:")
    named = F.when(kind == 0, "sc-domain:Example.com").when(kind == 1, "https://example.com/shop").when(kind == 2, "https://www.example.com/").otherwise("example.com")
    date = F.when(key % 3 == 0, " 2026-01-01 ").when(key % 3 == 1, "2026-01-01T10:00:00+02:00").otherwise("2026-01-01T10:00:00")
    span = S.publication_span(date)
    hours = F.round((F.unix_seconds(span["latest"]) - F.unix_seconds(span["earliest"]) + F.when(key % 3 == 0, 1).otherwise(0)) / 3600) - F.when(key % 3 == 0, 12).otherwise(0)
    return read(spark, sf_dir, "supplier").select(key.alias("id"), S.media_id(url).alias("media"), S.property_covers(named, F.lit("https://www.example.com")).alias("covers"), hours.alias("hours"))


@query("""
SELECT p_size AS size, count(*) AS n, least(count(*), 25) + CASE WHEN count(*) > 25 THEN 1 ELSE 0 END AS listed, CASE WHEN count(*) > 25 THEN '… ' || (count(*) - 25) || ' more' END AS last,
 floor(count(*) FILTER (WHERE p_retailprice > 1000) / count(*)::DOUBLE * 100 + 0.5)::INT AS percent FROM part GROUP BY 1
""")
def scalar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"), F.collect_list(F.col("p_name")).alias("names"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"))
    kept = S.bounded_list(F.col("names"))
    return rows.select("size", "n", F.size(kept).cast("long").alias("listed"), F.when(F.col("n") > 25, F.element_at(kept, -1)).alias("last"), S.percent(F.col("dear"), F.col("n")).alias("percent"))


@query("SELECT max_by(v, (a, b)) AS last, min_by(v, (a, b)) AS first FROM (SELECT (l_linenumber || '.' || l_quantity::INT) AS v, l_linenumber AS a, l_quantity::INT AS b FROM lineitem)")
def scalar_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws(".", "l_linenumber", F.col("l_quantity").cast("int")).alias("v")).withColumn("key", S.id_key(F.col("v")))
    return rows.agg(F.max_by("v", "key").alias("last"), F.min_by("v", "key").alias("first"))


@query("""
SELECT c_custkey AS k, c_nationkey % 4 > 1 AS said, CASE WHEN c_acctbal >= 1 THEN floor(c_acctbal)::BIGINT ELSE -1 END AS at, CASE c_nationkey % 3 WHEN 0 THEN 'planning' WHEN 1 THEN 'live' ELSE 'preflight' END AS class,
 CASE c_nationkey % 3 WHEN 0 THEN c_custkey % 2 = 0 WHEN 1 THEN false ELSE c_custkey % 2 = 1 END AS fits FROM customer
""")
def scalar_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    text = F.when(n % 4 == 0, " TBD ").when(n % 4 == 1, None).when(n % 4 == 2, "n/a yet").otherwise("yes")
    kind = readiness.evidence_class(F.when(n % 3 == 0, 0).when(n % 3 == 1, 5).otherwise(2))
    env = F.when(F.col("c_custkey") % 2 == 0, "planning").otherwise("pre-production")
    at = readiness.instant(F.timestamp_seconds(F.floor("c_acctbal")))
    rows = read(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("k"), readiness.filled(text).alias("said"), F.coalesce(F.unix_seconds(at), F.lit(-1)).alias("at"), kind.alias("class"), readiness.environment_fits(kind, env).alias("fits"))


@query(r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://example.org/x' WHEN 1 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a/b' WHEN 2 THEN NULL ELSE 'https://other.net/' END AS target,
 regexp_extract(url, '^https?://([^/?#]+)', 1) = 'therin.example.net' AS own, regexp_extract(url, '([^./]+\.[a-z]+)(/|\?|#|$)', 1) AS domain FROM pages
""")
def scalar_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    href = F.when(key % 4 == 0, " https://EXAMPLE.org:443/x ").when(key % 4 == 1, "/a/./c/../b").when(key % 4 == 2, "#top").otherwise("//other.net")
    base = F.when(key % 4 == 3, "https://a.b/").otherwise(F.col("url"))
    rows = read(spark, sf_dir, "pages")
    return rows.select("page_id", U.read_against(href, base).alias("target"), U.of_site(F.col("url"), F.lit("http://therin.example.net")).alias("own"), U.registrable(U.host(F.col("url"))).alias("domain"))


@query("""
WITH t AS (SELECT s_suppkey::VARCHAR AS source_id, s_nationkey AS n, 'topic ' || s_nationkey || ' tea ' || (s_suppkey % 3 + 100) AS topic FROM supplier),
q AS (SELECT c_custkey::VARCHAR AS check_id, 'tea topic ' || c_nationkey AS topic, c_nationkey AS n FROM customer)
SELECT check_id, max(source_id) AS source_id, 1.0::DOUBLE AS overlap FROM q JOIN t ON q.n = t.n GROUP BY 1
""")
def sources_of_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a topic stand in those of the source, so that the largest id decides."""
    checks = read(spark, sf_dir, "customer").selectExpr("string(c_custkey) as check_id", "concat('tea topic ', c_nationkey) as topic")
    known = read(spark, sf_dir, "supplier").selectExpr("string(s_suppkey) as source_id", "concat('topic ', s_nationkey, ' tea ', s_suppkey % 3 + 100) as topic")
    return compare.best_sources(checks, known, least=1.0).select("check_id", "source_id", "overlap")
