"""Roll-ups of check states: launch readiness, progress, reviews, cutover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

READY = "READY FOR CUTOVER"


def filled(value: Column) -> Column:
    """Whether a text says anything."""
    plain = F.lower(F.trim(F.regexp_replace(value, " ", " ")))
    return F.coalesce(~plain.isin("", "tbd", "n/a"), F.lit(False))


def instant(value: Column) -> Column:
    """A time; null if it isn't after the epoch."""
    return F.when(value > F.lit("1970-01-01 00:00:00").cast("timestamp"), value)


def state_of(checks: DataFrame, states: DataFrame, sites: DataFrame) -> DataFrame:
    """Every check of every site with its recorded state, or the state of none.

    ``sites``: crawl_id, assessed_at.  An attested state that has lapsed by then is
    in progress, of unknown coverage."""
    every = checks.select(F.col("id").alias("check_id"), "phase", "launch_gate", "universal").join(sites.select("crawl_id", "assessed_at"), F.lit(True))
    known = states.withColumn("recorded", F.lit(True))
    out = every.join(known, ["crawl_id", "check_id"], "left")
    lapsed = (
        F.col("assessed_at").isNotNull() & (F.col("coverage") == "attested") & (F.col("attestation_expires_at").isNull() | (F.col("attestation_expires_at") <= F.col("assessed_at")))
    )
    return (
        out.withColumn("applicability", F.coalesce("applicability", F.when(F.col("universal"), "yes").otherwise("review")))
        .withColumn("was", F.coalesce("status", F.lit("not-started")))
        .withColumn("lapsed", F.coalesce(lapsed, F.lit(False)))
        .withColumn("status", F.when(F.col("lapsed") & (F.col("was") == "passed"), "in-progress").otherwise(F.col("was")))
        .withColumn("coverage", F.when(F.col("lapsed"), "unknown").otherwise(F.coalesce("coverage", F.lit("unknown"))))
    )


def launch_readiness(checks: DataFrame, states: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site: the decision and what stands against it."""
    rows = state_of(checks, states, sites)
    gate = F.col("launch_gate") & (F.col("applicability") == "yes")
    excluded = (F.col("applicability") == "no") & (F.coalesce("applicability_rationale", F.lit("")) == "")
    skipped = gate & (F.col("status") == "skipped")
    sums = rows.groupBy("crawl_id").agg(
        F.count_if(gate & (F.col("status") != "passed")).alias("gates_outstanding"), F.count_if(gate & (F.col("status") == "failed")).alias("gates_failed"),
        F.count_if(F.col("launch_gate") & (F.col("applicability") == "review")).alias("decisions_outstanding"),
        F.count_if(gate & (F.col("was") == "passed") & (F.col("status") != "passed")).alias("attestations_lapsed"),
        F.count_if(excluded).alias("excluded_without_rationale"), F.count_if(skipped).alias("skipped_gates"),
        F.array_sort(F.collect_set(F.when(excluded | skipped, F.col("check_id")))).alias("violations"),
    )
    go = (F.col("gates_outstanding") == 0) & (F.col("gates_failed") == 0) & (F.col("decisions_outstanding") == 0)
    return sums.withColumn("decision", F.when(go, "GO").otherwise("HOLD"))


def progress(checks: DataFrame, states: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site and phase: counts over checks in scope, and percent passed."""
    rows = state_of(checks, states, sites)
    active = F.col("applicability") == "yes"
    names = {"not-started": "not_started", "in-progress": "in_progress", "passed": "passed", "failed": "failed", "skipped": "skipped"}
    sums = rows.groupBy("crawl_id", "phase").agg(
        F.count_if(active).alias("active"), *[F.count_if(active & (F.col("status") == s)).alias(n) for s, n in names.items()], F.count_if(F.col("applicability") == "review").alias("scope_review")
    )
    # halves round up
    return sums.withColumn("percent", F.when(F.col("active") == 0, 0).otherwise(F.floor(F.col("passed") / F.col("active") * 100 + 0.5)).cast("int"))


def overall_percent(phases: DataFrame) -> DataFrame:
    """Percent of all phases, weighted by their checks in scope."""
    weight = F.sum("active")
    return phases.groupBy("crawl_id").agg(F.when(weight > 0, F.floor(F.sum(F.col("percent") * F.col("active")) / weight + 0.5)).otherwise(0).cast("int").alias("percent"))


def evidence_class(phase: Column) -> Column:
    return F.when(phase == 0, "planning").when(phase == 5, "live").otherwise("preflight")


def environment_fits(kind: Column, environment: Column) -> Column:
    return F.when(kind == "planning", environment == "planning").when(kind == "live", environment == "production").otherwise(environment == "pre-production")


def run_problem(known_checks: Column, assessed_at: Column) -> Column:
    """What is wrong with a review run; null if nothing is.  ``known_checks``: an array."""
    required = ["run_id", "check_id", "release_id", "scope_revision", "criteria_revision", "origin", "tester", "evidence", "reviewed_by"]
    tested, reviewed, following, assessed = (instant(c) for c in (F.col("tested_at"), F.col("reviewed_at"), F.col("next_review_at"), assessed_at))
    late = F.col("next_review_at").isNotNull() & (following.isNull() | (following <= tested))
    problems = [F.when(~filled(F.col(c)), f"no {c}") for c in required] + [
        F.when(F.col("run_id").rlike("[*?~]"), "its id could stand for several runs"),
        F.when(~F.array_contains(known_checks, F.col("check_id")), "it is of a check that the catalogue lacks"),
        F.when(~F.coalesce(F.col("environment").isin("planning", "pre-production", "production"), F.lit(False)), "its environment is none of the three"),
        F.when(~F.coalesce(F.col("result").isin("not-started", "in-progress", "passed", "failed", "skipped", "reopened"), F.lit(False)), "its result is none of the six"),
        F.when(tested.isNull(), "when it was tested can't be read"),
        F.when(reviewed.isNull() | (reviewed < tested), "it was not reviewed, or sooner than tested"),
        F.when(assessed.isNull() | (reviewed > assessed), "its review lies in the assessment's future"),
        F.when(late, "it falls due before it was tested"),
        F.when((F.col("result") == "passed") & following.isNull() & ~filled(F.col("event_trigger")), "it passed for good: neither a date nor an event ends that"),
        F.when((F.col("result") == "reopened") & ~filled(F.col("event_trigger")), "nothing is said to have reopened it"),
    ]
    return F.coalesce(*problems)


def read_reviews(checks: DataFrame, states: DataFrame, runs: DataFrame, releases: DataFrame) -> DataFrame:
    """One row per site and check: how its newest run in the release's context reads.

    ``releases``: crawl_id, site_id, release_id, scope_revision, origin, assessed_at,
    criteria map<check, revision>, version.  Ties of the newest time are ambiguous."""
    ids = F.array_sort(F.collect_set("id"))
    known = checks.agg(ids.alias("known"))
    own = states.select("crawl_id", "check_id", "status", "evidence", "evidence_ref")
    repeated = F.count("*").over(Window.partitionBy("site_id", "run_id")) > 1
    all_runs = runs.withColumn("repeated", repeated).withColumnRenamed("origin", "run_origin").withColumnRenamed("release_id", "run_release").withColumnRenamed("scope_revision", "run_scope")
    rows = checks.select(F.col("id").alias("check_id"), "phase").join(releases, F.lit(True)).join(F.broadcast(known), F.lit(True))
    met = rows.join(all_runs, ["site_id", "check_id"], "left")
    renamed = met.withColumn("problem", F.when(F.col("run_id").isNotNull(), _problem_of(met)))
    fits = (
        filled(F.col("release_id")) & (F.col("run_release") == F.col("release_id")) & filled(F.col("scope_revision")) & (F.col("run_scope") == F.col("scope_revision"))
        & filled(F.col("origin")) & (F.col("run_origin") == F.col("origin")) & (F.col("criteria_revision") == F.coalesce(F.col("criteria")[F.col("check_id")], F.col("version")))
        & environment_fits(evidence_class(F.col("phase")), F.col("environment"))
    )
    at = F.when(F.coalesce(fits, F.lit(False)), instant(F.col("tested_at")))
    newest = renamed.withColumn("at", at).withColumn("newest", F.max("at").over(Window.partitionBy("crawl_id", "check_id")))
    sums = newest.groupBy("crawl_id", "check_id", "phase").agg(
        F.count_if(F.col("at") == F.col("newest")).alias("latest"), F.bool_or(F.col("run_id").isNotNull() & (F.col("repeated") | F.col("problem").isNotNull())).alias("broken"),
        F.max_by(F.struct("run_id", "result", "tested_at", "next_review_at", F.col("evidence").alias("said"), "assessed_at"), "at").alias("run"),
    )
    out = sums.join(own, ["crawl_id", "check_id"], "left")
    cites = (F.col("run.said") == F.col("evidence")) | (filled(F.col("evidence_ref")) & (F.col("run.said") == F.col("evidence_ref")))
    state = (
        F.when(F.col("latest") == 0, F.when(F.col("status") == "passed", "review-required").otherwise("not-reviewed"))
        .when(F.col("latest") > 1, "ambiguous").when(F.col("broken"), "invalid").when(F.col("run.result") == "reopened", "reopened").when(F.col("run.result") == "failed", "failed")
        .when(instant(F.col("run.next_review_at")) < instant(F.col("run.assessed_at")), "overdue")
        .when(~F.coalesce((F.col("status") == F.col("run.result")) & cites, F.lit(False)), "reconcile").when(F.col("run.result") == "passed", "current").otherwise("unfinished")
    )
    return out.select("crawl_id", "check_id", state.alias("review_state"), F.when(F.col("latest") == 1, F.col("run.run_id")).alias("run_id"), F.when(F.col("latest") == 1, F.col("run.tested_at")).alias("tested_at"))


def _problem_of(rows: DataFrame) -> Column:
    """run_problem over joined columns, whose run_* names stand for the run's own."""
    problem = run_problem(F.col("known"), F.col("assessed_at"))
    del rows
    return problem


def cutover_readiness(checks: DataFrame, states: DataFrame, runs: DataFrame, releases: DataFrame) -> DataFrame:
    """One row per release: whether it may cut over, and whether it is final.

    ``releases`` also has scope_approver, scope_approved_at, scope_approval_evidence,
    decision_owner, cutover struct<authorizer, decision_reference, authorized_at,
    cutover_at, release_id, scope_revision, origin, assessment> and decision."""
    sites = releases.select("crawl_id", "assessed_at")
    launch = launch_readiness(checks, states, sites)
    reviews = read_reviews(checks, states, runs, releases)
    ids = checks.agg(F.array_sort(F.collect_set("id")).alias("known"))
    repeated = F.count("*").over(Window.partitionBy("site_id", "run_id")) > 1
    logged = runs.withColumn("repeated", repeated).join(releases.select("crawl_id", "site_id", "assessed_at"), "site_id").join(F.broadcast(ids), F.lit(True))
    errors = logged.groupBy("crawl_id").agg(F.count_if(F.col("repeated") | run_problem(F.col("known"), F.col("assessed_at")).isNotNull()).alias("input_errors"))
    assessed, approved = instant(F.col("assessed_at")), instant(F.col("scope_approved_at"))
    scope = [
        ~filled(F.col("release_id")), ~filled(F.col("scope_revision")), ~(filled(F.col("origin")) & F.col("origin").rlike(r"^https://[^\s/]+$")), ~filled(F.col("scope_approver")),
        approved.isNull() | assessed.isNull() | (approved > assessed), ~filled(F.col("scope_approval_evidence")), ~filled(F.col("decision_owner")), assessed.isNull(),
    ]
    problems = sum((F.coalesce(p, F.lit(True)).cast("int") for p in scope), F.lit(0))
    gates = state_of(checks, states, sites).where("launch_gate").join(reviews.select("crawl_id", "check_id", "review_state", "tested_at"), ["crawl_id", "check_id"], "left")
    gates = gates.join(releases.select("crawl_id", F.col("cutover.cutover_at").alias("cutover_at")), "crawl_id")
    live = evidence_class(F.col("phase")) == "live"
    early = live & (instant(F.col("cutover_at")).isNull() | (F.coalesce(instant(F.col("tested_at")), F.lit(0).cast("timestamp")) < F.col("cutover_at")))
    incomplete = (F.coalesce("review_state", F.lit("not-reviewed")) != "current") | early
    on = F.col("applicability") == "yes"
    sums = gates.groupBy("crawl_id").agg(
        F.count_if((F.col("applicability") == "no") & ~filled(F.col("applicability_rationale"))).alias("unexplained"),
        F.count_if(on & ~live & (F.col("status") != "passed")).alias("pre_outstanding"), F.count_if(on & live & (F.col("status") != "passed")).alias("live_outstanding"),
        F.count_if(on & ~live & incomplete).alias("pre_incomplete"), F.count_if(on & live & incomplete).alias("live_incomplete"),
    )
    c = "cutover."
    valid = (
        filled(F.col(c + "authorizer")) & filled(F.col(c + "decision_reference")) & (approved <= instant(F.col(c + "authorized_at"))) & (instant(F.col(c + "authorized_at")) <= instant(F.col(c + "cutover_at")))
        & (instant(F.col(c + "cutover_at")) <= assessed) & (F.col(c + "release_id") == F.col("release_id")) & (F.col(c + "scope_revision") == F.col("scope_revision"))
        & (F.col(c + "origin") == F.col("origin")) & (F.col(c + "assessment") == READY)
    )
    out = (
        releases.select("crawl_id", problems.alias("problems"), F.coalesce(valid, F.lit(False)).alias("record_valid"), "decision")
        .withColumnRenamed("decision", "recorded")
        .join(launch, "crawl_id").join(sums, "crawl_id", "left").join(errors, "crawl_id", "left").fillna(0)
        .withColumn("scope_errors", F.col("problems") + F.col("unexplained"))
    )
    ready = F.expr("input_errors = 0 and scope_errors = 0 and decisions_outstanding = 0 and pre_outstanding = 0 and pre_incomplete = 0")
    final = F.expr("gates_outstanding = 0 and live_incomplete = 0 and record_valid")
    out = out.withColumn("cutover", F.when(ready, READY).otherwise("HOLD")).withColumn("final", F.when(ready & final, "GO").otherwise("HOLD"))
    told = F.when(F.col("recorded").isNull(), "none").when(F.col("recorded") != "GO", "recorded").when(F.col("final") == "GO", "agrees").otherwise("conflict")
    return out.select(
        "crawl_id", "cutover", "final", "input_errors", "scope_errors", "pre_outstanding", "live_outstanding", "pre_incomplete", "live_incomplete", "record_valid", told.alias("launch_decision")
    )


def record_attestations(given: DataFrame, checks: DataFrame, states: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history to append, states with those attested replaced, refused ones with their problem).

    ``given``: crawl_id, check_id, attested_by, statement, expires_at, status, applicability,
    applicability_rationale.  Of several for one check, that which lasts longest counts."""
    scope = F.coalesce("applicability", F.lit("yes"))
    problem = (
        F.when(F.col("known").isNull(), "the catalogue has no such check").when(F.col("expires_at").isNull(), "its end can't be read").when(F.col("expires_at") <= now, "it has ended already")
        .when((scope == "no") & (F.trim(F.coalesce("applicability_rationale", F.lit(""))) == ""), "out of scope without a reason")
    )
    known = checks.select(F.col("id").alias("check_id"), F.lit(True).alias("known")).distinct()
    judged = given.join(known, "check_id", "left").withColumn("problem", problem).withColumn("applicability", scope).drop("known")
    good = judged.where("problem is null").drop("problem")
    last = good.groupBy("crawl_id", "check_id").agg(F.max_by(F.struct(*[c for c in good.columns if c not in ("crawl_id", "check_id")]), F.struct("expires_at", "status")).alias("a"))
    own = [c for c in states.columns if c not in ("crawl_id", "check_id")]
    told = {"status": "a.status", "applicability": "a.applicability", "applicability_rationale": "a.applicability_rationale", "attestation_expires_at": "a.expires_at"}
    fresh = last.select("crawl_id", "check_id", *[F.col(told[c]).alias(c) if c in told else (F.lit("attested") if c == "coverage" else F.lit(None)).cast(states.schema[c].dataType).alias(c) for c in own])
    kept = states.join(last.select("crawl_id", "check_id"), ["crawl_id", "check_id"], "left_anti").select("crawl_id", "check_id", *own)
    return good, kept.unionByName(fresh), judged.where("problem is not null")


def merge_attested(machine: DataFrame, attested: DataFrame) -> DataFrame:
    """Check states where attestations outrank machine verdicts, but for the gates on
    which a fresh machine failure stands."""
    stands = F.col("check_id").isin("1.5", "4.2", "4.5", "4.7") & (F.col("m.basis") == "verified-fail")
    columns = [c for c in machine.columns if c not in ("crawl_id", "check_id")]
    m = machine.select("crawl_id", "check_id", F.struct(*columns).alias("m"))
    a = attested.select("crawl_id", "check_id", F.struct(*[F.col(c) if c in attested.columns else F.lit(None).alias(c) for c in columns]).alias("a"))
    both = m.join(a, ["crawl_id", "check_id"], "full")
    chosen = F.when(F.col("a").isNull() | F.coalesce(stands, F.lit(False)), F.col("m")).otherwise(F.col("a"))
    return both.select("crawl_id", "check_id", chosen.alias("s")).select("crawl_id", "check_id", "s.*")
