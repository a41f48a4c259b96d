"""Grading, readiness, reviews, cutover, comparison."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.plans import compare, grading, readiness

NOW = datetime(2026, 3, 1)
DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def checks(spark):
    def row(i, phase=1, gate=True, automation="automated", universal=True, flags=(), detectors=("d1",)):
        return ("v", i, i, phase, gate, automation, universal, list(flags), list(detectors), "P0")

    rows = [
        row("1.1"), row("1.2", automation="assisted"), row("1.3", automation="attested"), row("1.4", detectors=["d1", "absent"]), row("1.5", universal=False, flags=["shop"]),
        row("5.1", phase=5, detectors=["d2"]), row("2.1", phase=2, gate=False, detectors=["d1", "d2"]),
    ]
    return spark.createDataFrame(rows, schemas.CHECKS)


def observations(spark, rows):
    return spark.createDataFrame([(c, p, "site", None, o, "", None) for c, p, o in rows], schemas.OBSERVATIONS)


BASES = [
    ("pass", [("d1", "pass"), ("d2", "pass")], {"1.1": "verified-pass", "1.2": "awaiting-confirmation", "1.3": "attested-only", "1.4": "detectors-missing", "5.1": "verified-pass"}),
    ("fail", [("d1", "fail"), ("d1", "pass"), ("d2", "warn")], {"1.1": "verified-fail", "1.2": "verified-fail", "2.1": "verified-fail", "5.1": "held-by-warning"}),
    ("error", [("d1", "error"), ("d1", "fail")], {"1.1": "probe-error", "5.1": "no-observation", "2.1": "no-observation"}),
    ("nothing", [("d1", "not-applicable"), ("d2", "pass")], {"1.1": "nothing-to-verify", "2.1": "verified-pass"}),
    ("silent", [], {"1.1": "no-observation", "1.4": "detectors-missing"}),
]


def test_every_basis(spark, checks):
    rows = [(c, p, o) for c, obs, _ in BASES for p, o in obs]
    sites = spark.createDataFrame([(c, ["shop"]) for c, _, _ in BASES] + [("other", ["blog"]), ("undecided", [])], "crawl_id string, flags array<string>")
    graded = grading.grade(checks, sites, observations(spark, rows), ["d1", "d2"]).collect()
    got = {(r.crawl_id, r.check_id): r for r in graded}
    for crawl, _, expected in BASES:
        assert {k: got[crawl, k].basis for k in expected} == expected, crawl
    assert got["other", "1.5"].basis == "out-of-scope" and "shop" in got["other", "1.5"].applicability_rationale and got["undecided", "1.5"].basis == "scope-undecided"
    assert got["fail", "1.1"].failing_detectors == ["d1"] and (got["fail", "1.1"].fails, got["fail", "1.1"].passes) == (1, 1)
    assert got["pass", "1.1"].status == "passed" and got["fail", "1.1"].status == "failed" and len(got) == 7 * 7


def test_matrix_orphans_guard(spark, checks):
    matrix = {r.check_id: r for r in grading.probe_matrix(checks, ["d1", "d2", "d3"]).collect()}
    assert matrix["1.1"].coverable and not matrix["1.3"].coverable and matrix["1.4"].missing == ["absent"]
    assert [r.probe_id for r in grading.orphans(checks, ["d1", "d2", "d3"]).collect()] == ["d3"]
    out = grading.guard(observations(spark, [("a", "robots-txt", "fail"), ("a", "broken-links", "warn"), ("b", "http-status", "fail")])).collect()
    assert {(r.crawl_id, r.passed, r.warnings, tuple(r.concerns)) for r in out} == {("a", False, 1, ("robots",)), ("b", True, 0, ())}


def states(spark, rows):
    names = "crawl_id check_id applicability applicability_rationale status coverage basis evidence evidence_ref attestation_expires_at".split()
    return spark.createDataFrame([tuple({"crawl_id": "s", "coverage": "verified", "applicability": "yes", **r}.get(n) for n in names) for r in rows], schemas.CHECK_STATES)


def test_readiness_and_progress(spark, checks):
    at = spark.createDataFrame([("s", NOW)], "crawl_id string, assessed_at timestamp")
    rows = [
        {"check_id": "1.1", "status": "passed"}, {"check_id": "1.2", "status": "passed", "coverage": "attested", "attestation_expires_at": NOW - DAY}, {"check_id": "1.3", "status": "skipped"},
        {"check_id": "1.4", "status": "failed"}, {"check_id": "1.5", "applicability": "no", "status": "not-started"}, {"check_id": "5.1", "status": "passed", "coverage": "attested", "attestation_expires_at": NOW + DAY},
    ]
    r = readiness.launch_readiness(checks, states(spark, rows), at).first()
    assert (r.gates_outstanding, r.gates_failed, r.decisions_outstanding, r.attestations_lapsed, r.decision) == (3, 1, 0, 1, "HOLD")
    assert r.violations == ["1.3", "1.5"] and r.excluded_without_rationale == 1 and r.skipped_gates == 1
    phases = {p.phase: p for p in readiness.progress(checks, states(spark, rows), at).collect()}
    assert (phases[1].active, phases[1].passed, phases[1].in_progress, phases[1].percent) == (4, 1, 1, 25) and phases[5].percent == 100 and phases[2].not_started == 1
    assert readiness.overall_percent(readiness.progress(checks, states(spark, rows), at)).first().percent == 33
    good = [{"check_id": c, "status": "passed"} for c in ("1.1", "1.2", "1.3", "1.4", "5.1")] + [{"check_id": "1.5", "applicability": "no", "applicability_rationale": "no shop", "status": "not-started"}]
    assert readiness.launch_readiness(checks, states(spark, good), at).first().decision == "GO"


def run(**fields):
    return {
        "site_id": "site", "run_id": "r", "check_id": "1.1", "release_id": "rel", "scope_revision": "1", "criteria_revision": "v", "origin": "https://ex.com", "environment": "pre-production", "tested_at": NOW - 3 * DAY, "tester": "t",
        "result": "passed", "evidence": "e", "reviewed_by": "b", "reviewed_at": NOW - 2 * DAY, "next_review_at": NOW + DAY, "event_trigger": None, **fields,
    }


REVIEWS = [
    ("current", [run()]), ("ambiguous", [run(), run(run_id="r2")]), ("invalid", [run(), run(tested_at=NOW - 9 * DAY)]), ("invalid", [run(tester=" TBD ")]), ("overdue", [run(next_review_at=NOW - DAY)]), ("reopened", [run(result="reopened", event_trigger="x")]),
    ("failed", [run(result="failed")]), ("reconcile", [run(evidence="other")]), ("review-required", [run(environment="production")]), ("review-required", [run(origin="https://old.com")]), ("review-required", []), ("unfinished", None),
]


def releases(spark, crawls, **more):
    row = {
        "site_id": None, "release_id": "rel", "scope_revision": "1", "origin": "https://ex.com", "assessed_at": NOW, "criteria": {}, "version": "v", "scope_approver": "a", "scope_approved_at": NOW - 9 * DAY, "scope_approval_evidence": "e",
        "decision_owner": "o", "cutover": None, "decision": None, **more,
    }
    ddl = (
        "crawl_id string, site_id string, release_id string, scope_revision string, origin string, assessed_at timestamp, criteria map<string,string>, version string, scope_approver string, scope_approved_at timestamp, scope_approval_evidence string, "
        "decision_owner string, cutover struct<authorizer:string,decision_reference:string,authorized_at:timestamp,cutover_at:timestamp,release_id:string,scope_revision:string,origin:string,assessment:string>, decision string"
    )
    return spark.createDataFrame([(c, c, *list(row.values())[1:]) for c in crawls], ddl)


def logged(spark, by_site):
    names = [c.split()[0] for c in schemas.REVIEW_RUNS.split(", ")]
    return spark.createDataFrame([tuple({**r, "site_id": s}[n] for n in names) for s, rows in by_site.items() for r in rows], schemas.REVIEW_RUNS)


def test_reviews(spark, checks):
    one = checks.where("id = '1.1'")
    by_site = {str(i): [run(result="in-progress")] if rows is None else rows for i, (_, rows) in enumerate(REVIEWS)}
    known = states(spark, [{"crawl_id": str(i), "check_id": "1.1", "status": "passed" if rows is not None else "in-progress", "evidence": "e"} for i, (_, rows) in enumerate(REVIEWS)])
    out = readiness.read_reviews(one, known, logged(spark, by_site), releases(spark, by_site)).collect()
    assert {r.crawl_id: r.review_state for r in out} == {str(i): s for i, (s, _) in enumerate(REVIEWS)}


def test_cutover(spark, checks):
    two = checks.where("id in ('1.1', '5.1')")
    cut = {"authorizer": "a", "decision_reference": "d", "authorized_at": NOW - 8 * DAY, "cutover_at": NOW - 7 * DAY, "release_id": "rel", "scope_revision": "1", "origin": "https://ex.com", "assessment": readiness.READY}
    live = run(run_id="r5", check_id="5.1", environment="production")
    known = states(spark, [{"check_id": c, "status": "passed", "evidence": "e"} for c in ("1.1", "5.1")])

    def read(runs, **more):
        return readiness.cutover_readiness(two, known, logged(spark, {"s": runs}), releases(spark, ["s"], **more)).first()

    r = read([run(), live], cutover=cut, decision="GO")
    assert (r.cutover, r.final, r.launch_decision, r.record_valid) == (readiness.READY, "GO", "agrees", True)
    r = read([run(), live], decision="GO")
    assert (r.cutover, r.final, r.launch_decision, r.live_incomplete) == (readiness.READY, "HOLD", "conflict", 1)
    r = read([live], cutover=cut, scope_approver="n/a")
    assert (r.cutover, r.pre_incomplete, r.scope_errors, r.launch_decision) == ("HOLD", 1, 1, "none")


def test_attested_rows_outrank_machine_ones(spark):
    machine = states(spark, [{"check_id": "1.1", "status": "failed", "basis": "verified-fail"}, {"check_id": "1.5", "status": "failed", "basis": "verified-fail"}, {"check_id": "2.1", "status": "passed"}])
    attested = states(spark, [{"check_id": c, "status": "passed", "coverage": "attested"} for c in ("1.1", "1.5", "3.1")])
    out = {r.check_id: r.status for r in readiness.merge_attested(machine, attested).collect()}
    assert out == {"1.1": "passed", "1.5": "failed", "2.1": "passed", "3.1": "passed"}


def test_comparison(spark):
    now = spark.createDataFrame([("s", "1", "passed", "b"), ("s", "2", "failed", None), ("s", "3", "passed", None)], "site string, check_id string, status string, basis string")
    before = spark.createDataFrame([("s", "1", "passed", "b"), ("s", "2", "passed", None), ("s", "4", "passed", None)], "site string, check_id string, status string, basis string")
    assert {(r.check_id, r.kind) for r in compare.verdict_moves(now, before).collect()} == {("2", "moved"), ("3", "new"), ("4", "dropped")}
    audits = spark.createDataFrame([(1, 1, "complete", NOW, False), (2, 1, "complete", NOW + DAY, True), (3, 1, "open", NOW + DAY, False)], "audit_id int, site_id int, status string, finished_at timestamp, current boolean")
    assert [r.audit_id for r in compare.latest_complete(audits).collect()] == [1]


def test_violations(spark):
    bad = states(spark, [{"check_id": "1", "applicability": "no"}, {"check_id": "2", "coverage": "attested"}, {"check_id": "2"}])
    pages = spark.createDataFrame([("c", "u"), ("c", "u")], "crawl_id string, url string")
    obs = spark.createDataFrame([("c", "p", "page", None, "pass", "", None)], schemas.OBSERVATIONS)
    out = {(r.rule, r.key) for r in compare.violations(bad, obs, pages).collect()}
    assert out == {("excluded_needs_rationale", "s/1"), ("attestation_needs_expiry", "s/2"), ("state_is_unique", "s/2"), ("page_is_unique", "c/u"), ("page_scope_needs_page", "c/p")}


def test_gate_history(spark, checks):
    graded = spark.createDataFrame([("s", "1.1", "failed"), ("s", "2.1", "failed")], "crawl_id string, check_id string, status string")
    before = spark.createDataFrame([("s", "1.1", "passed"), ("s", "2.1", "passed")], "crawl_id string, check_id string, status string")
    r = grading.gate_history(checks, before, graded, before.where(F.lit(False)).select("crawl_id", "check_id")).first()
    assert (r.passed_before, r.failing_now, r.reopened) == (["1.1"], ["1.1"], [])


def test_check_table(spark, checks):
    known = states(spark, [{"check_id": "1.1", "status": "passed"}, {"check_id": "1.5", "applicability": "no", "applicability_rationale": "x", "status": "not-started"}]).drop("crawl_id")
    joined = compare.joined_checks(checks, known)
    t = compare.tiles(joined).first()
    assert (t.active, t.passed, t.not_started, t.review) == (6, 1, 5, 0)
    assert {r.check_id for r in compare.check_table(joined, gates_only=True, automation="automated", status="not-started").collect()} == {"1.4", "1.5", "5.1"}
    assert [r.check_id for r in compare.check_table(joined, search="2.1").collect()] == ["2.1"]


def test_best_sources(spark):
    topics = spark.createDataFrame([("1", "Robots meta tag"), ("2", "Nothing alike here")], "check_id string, topic string")
    sources = spark.createDataFrame([("a", "The robots meta tag"), ("b", "robots.txt"), ("c", "meta")], "source_id string, topic string")
    assert [(r.check_id, r.source_id, r.overlap) for r in compare.best_sources(topics, sources).collect()] == [("1", "a", 1.0)]


def test_best_sources_compares_each_topic_once(spark):
    import itertools
    import re

    words = "tea cup green black milk".split()
    told = [" ".join(c) for n in (1, 2, 3, 4) for c in itertools.combinations(words, n)]
    checks = [(str(i), t) for i, t in enumerate(told)] + [("again", told[7]), ("none", "..."), ("nothing", "coffee")]
    sources = [(f"s{i:02}", " ".join(reversed(t.split()))) for i, t in enumerate(told[3:])] + [("s99", told[9]), ("s00", "!")]
    split = lambda t: set(re.findall(r"\w+", t))
    for least in (1.0, 0.6, 0.34):
        wanted = {}
        for c, t in checks:
            ranked = [(len(split(t) & split(u)) / len(split(t)), -len(split(u)), s) for s, u in sources if split(t) and len(split(t) & split(u)) / len(split(t)) >= least and split(t) & split(u)]
            if ranked:
                wanted[c] = max(ranked)[::2][::-1]
        found = compare.best_sources(spark.createDataFrame(checks, "check_id string, topic string"), spark.createDataFrame(sources, "source_id string, topic string"), least)
        assert {r.check_id: (r.source_id, r.overlap) for r in found.collect()} == wanted


def test_best_sources_of_alike_topics_stay_few(spark):
    """400 million pairs of 20,000 checks and sources, but 25 topics."""
    checks = spark.range(20000).selectExpr("string(id) as check_id", "concat('tea topic ', id % 25) as topic")
    sources = spark.range(20000).selectExpr("string(id) as source_id", "concat('topic ', id % 25, ' tea ', id % 3 + 100) as topic")
    found = compare.best_sources(checks, sources, 1.0)
    assert found.agg({"overlap": "min"}).first()[0] == 1.0 and found.count() == 20000
    assert found.where("int(source_id) % 25 <> int(check_id) % 25").count() == 0
