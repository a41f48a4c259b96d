"""Queries that run record detectors over many crawls made of the driver's tables,
each with the SQL that its outcomes must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.operators.audit import Audit
from lodestar.operators.site_detectors import AFTER, SITE
from lodestar.queries import query, read
from lodestar.sources.scratch import written

_SITE_COLUMNS = dict(f.split(" ", 1) for f in (
    "origin string;environment string;flags array<string>;robots_txt string;robots_status int;robots_error string;production_origin string;settings string;release_id string;"
    "protocol struct<alpn:string,tls_version:string,error:string>;rdap struct<domain:string,registrar:string,expires_at:string,fetched_at:timestamp,statuses:array<string>,error:string>;"
    "ai_policy map<string,string>"
).split(";"))
NOW = "2000-01-01 00:00:00"


def crawls(spark: SparkSession, rows: DataFrame, **columns: F.Column) -> Audit:
    """An audit of crawls without pages; ``rows`` has crawl_id."""
    given = {n: F.lit(None).cast(t) for n, t in _SITE_COLUMNS.items()} | {"flags": F.array().cast("array<string>"), "origin": F.lit("https://example.com")} | columns
    sites = rows.select("crawl_id", F.lit(NOW).cast("timestamp").alias("crawled_at"), *[c.alias(n) for n, c in given.items()])
    return Audit(spark, sites, spark.createDataFrame([], schemas.PAGES))


def held(rows: DataFrame, section: str, **columns: F.Column) -> DataFrame:
    """A section's records: those without an owner or due are held."""
    names = [f.strip().split(" ", 1) for f in _top_level(schemas.INPUTS[section])]
    owner = columns.pop("owner", F.lit("me"))
    due = columns.pop("next_review_at", F.lit(None).cast("timestamp"))
    return rows.select(
        "crawl_id", owner.alias("owner"), F.lit(NOW).cast("timestamp").alias("recorded_at"), due.alias("next_review_at"),
        *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in names],
    )


def _top_level(ddl: str) -> list[str]:
    depth, parts, word = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(word)
            word = ""
        else:
            word += c
    return [*parts, word]


def outcomes(probe: str, audit: Audit) -> DataFrame:
    return SITE[probe](audit).select("crawl_id", "outcome")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").withColumn("crawl_id", F.col("c_custkey").cast("string"))


@query("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1),
g AS (SELECT o_custkey, coalesce(abs(o_totalprice - b) / nullif(greatest(o_totalprice, b), 0), 0) AS gap, o_orderkey % 2 = 0 AS told FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_custkey::VARCHAR AS crawl_id, CASE WHEN count(*) FILTER (WHERE gap > 0.1 AND NOT told) > 0 THEN 'fail' WHEN count(*) FILTER (WHERE gap > 0.05) > 0 THEN 'warn' WHEN o_custkey % 5 = 0 THEN 'warn' ELSE 'pass' END AS outcome FROM g GROUP BY o_custkey
""")
def record_analytics_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("b"))
    pairs = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    pair = F.struct(F.lit("m").alias("metric"), F.col("o_totalprice").alias("a"), F.col("b").alias("b"), F.when(F.col("o_orderkey") % 2 == 0, "known").alias("explanation"))
    rows = written(pairs.groupBy("o_custkey").agg(F.collect_list(pair).alias("reported")).withColumn("crawl_id", F.col("o_custkey").cast("string")), "pairs")
    audit = crawls(spark, rows)
    audit.inputs["analytics"] = held(rows, "analytics", reported=F.col("reported"), owner=F.when(F.col("o_custkey") % 5 == 0, " ").otherwise("me"))
    return outcomes("analytics-reconciliation", audit)


@query("""
SELECT p_brand AS crawl_id, CASE WHEN count(*) FILTER (WHERE (p_retailprice * 4 > 4000 AND NOT p_size % 3 = 0) OR (p_retailprice / 2 > 500 AND NOT p_size % 3 = 1) OR p_size / 190.0 > 0.25) > 0 THEN 'fail'
 WHEN count(*) FILTER (WHERE p_size % 7 = 0) > 0 THEN 'warn' ELSE 'pass' END AS outcome FROM (SELECT p_brand || p_type AS p_brand, p_retailprice, p_size FROM part) GROUP BY 1
""")
def record_field_cwv_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("p_size") % 3 == 0, F.array(F.struct(F.lit("lcp").alias("metric"), F.lit("o").alias("owner")))).when(F.col("p_size") % 3 == 1, F.array(F.struct(F.lit("inp").alias("metric"), F.lit("o").alias("owner"))))
    one = F.struct(
        F.lit("crux").alias("source"), F.col("p_name").alias("target"), F.lit("phone").alias("form_factor"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") * 4).otherwise(F.when(F.col("p_retailprice") * 4 > 4000, F.col("p_retailprice") * 4)).alias("lcp_ms"),
        (F.col("p_retailprice") / 2).alias("inp_ms"), (F.col("p_size") / 190).alias("cls"), action.alias("actions"),
    )
    rows = written(read(spark, sf_dir, "part").groupBy(F.concat("p_brand", "p_type").alias("crawl_id")).agg(F.collect_list(one).alias("populations")), "vitals")
    audit = crawls(spark, rows)
    audit.inputs["crux"] = held(rows, "crux", populations=F.col("populations"))
    return outcomes("field-cwv-monitor", audit)


@query("""
SELECT user_id::VARCHAR AS crawl_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND event_id % 5 = 0 AND user_id % 3 = 0) / count(*)::DOUBLE > 0.01 THEN 'fail' WHEN user_id % 4 = 0 AND count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'fail'
 WHEN count(*) FILTER (WHERE event_id % 3 = 0) / count(*)::DOUBLE > 0.25 THEN 'warn' ELSE 'pass' END AS outcome FROM events GROUP BY user_id
""")
def record_log_file_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.struct(
        F.col("ts").cast("timestamp").alias("at"), F.lit("GET").alias("method"), F.concat(F.when(F.col("user_id") % 4 == 0, "/").otherwise("/open/"), "event_type").alias("path"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0) & (F.col("user_id") % 3 == 0), 500).otherwise(200).alias("status"),
        F.lit("Googlebot").alias("user_agent"), (F.col("event_id") % 3 == 0).alias("parameterised"),
    )
    events = read(spark, sf_dir, "events").withColumn("crawl_id", F.col("user_id").cast("string"))
    rows = written(events.select("crawl_id").distinct(), "users")
    audit = crawls(spark, rows, robots_txt=F.lit("User-agent: *\nDisallow: /view"))
    audit.inputs["server_logs"] = held(rows, "server_logs")
    audit.rows["server_logs.hits"] = events.select("crawl_id", hit.alias("hit")).select("crawl_id", "hit.*")
    return outcomes("log-file-analysis", audit)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 2 = 0) * 60 AS before, count(*) FILTER (WHERE event_id % 2 = 1) * 60 AS after FROM events GROUP BY 1, 2),
f AS (SELECT user_id, event_type, before >= 100 AND after < before * 0.7 AS falls, event_type = 'view' AS decided FROM c), p AS (SELECT user_id, count(DISTINCT event_id % 2) AS periods FROM events GROUP BY 1)
SELECT f.user_id::VARCHAR AS crawl_id, CASE WHEN any_value(periods) < 2 THEN 'not-applicable' WHEN count(*) FILTER (WHERE falls AND NOT decided) > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM f JOIN p ON p.user_id = f.user_id GROUP BY 1
""")
def record_content_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.when(F.col("event_id") % 2 == 0, "2026-01-01 to 2026-01-31").otherwise("2026-02-01 to 2026-02-28")
    row = F.struct(F.concat(F.lit("https://example.com/"), "event_type").alias("page"), F.lit(None).cast("string").alias("query"), F.lit(60.0).alias("clicks"), F.lit(1.0).alias("impressions"), period.alias("period"))
    events = read(spark, sf_dir, "events").withColumn("crawl_id", F.col("user_id").cast("string"))
    rows = written(events.select("crawl_id").distinct(), "users")
    audit = crawls(spark, rows)
    audit.inputs["search_console"] = held(rows, "search_console")
    audit.rows["search_console.performance"] = events.select("crawl_id", F.col("event_id").alias("place"), row.alias("row")).select("crawl_id", "place", "row.*")
    decision = F.array(F.struct(F.lit("https://example.com/view").alias("url"), F.lit("rewrite").alias("decision")))
    audit.inputs["content_decisions"] = held(rows, "content_decisions", entries=decision)
    return outcomes("content-decay", audit)


@query("""
SELECT c_custkey::VARCHAR AS crawl_id, CASE WHEN c_nationkey % 3 = 0 THEN 'pass' WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'fail' WHEN c_nationkey % 2 = 0 THEN 'warn' ELSE 'pass' END AS outcome FROM customer
""")
def record_backlink_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    audit = crawls(spark, rows)
    audit.inputs["disavow"] = held(
        rows, "disavow", submitted=F.col("c_nationkey") % 3 != 0, reasons=F.when(F.col("c_acctbal") >= 0, "spam"), attempts=F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise("mailed"),
        next_review_at=F.when(F.col("c_nationkey") % 2 == 0, F.lit("1999-01-01").cast("timestamp")),
    )
    return outcomes("backlink-monitor", audit)


@query("""
SELECT c_custkey::VARCHAR AS crawl_id, CASE WHEN c_nationkey % 4 < 3 OR c_acctbal < 0 THEN 'fail' WHEN c_mktsegment = 'BUILDING' THEN 'warn' ELSE 'pass' END AS outcome FROM customer
""")
def record_ci_seo_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("noindex", "Canonical", "robots", "critical-link")])
    audit = crawls(spark, rows)
    audit.inputs["ci_guard"] = held(rows, "ci_guard", caught=F.slice(kinds, 1, (F.col("c_nationkey") % 4 + 1).cast("int")), clean_passed=F.col("c_acctbal") >= 0, owner=F.when(F.col("c_mktsegment") != "BUILDING", "me"))
    return outcomes("ci-seo-guards", audit)


@query("""
SELECT o_custkey::VARCHAR AS crawl_id, CASE WHEN count(*) FILTER (WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'P') > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM orders GROUP BY 1
""")
def record_monitoring_incident_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", "o").alias("owner"), F.when(F.col("o_orderstatus") == "P", "").otherwise("fixed").alias("remediation"))
    rows = written(read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("crawl_id")).agg(F.collect_list(one).alias("entries")), "incidents")
    audit = crawls(spark, rows)
    audit.inputs["incidents"] = held(rows, "incidents", entries=F.col("entries"))
    return outcomes("monitoring-incident-sla", audit)


@query("""
SELECT o_custkey::VARCHAR AS crawl_id, CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice < 200000) > 0 THEN 'fail'
 WHEN count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') > 0 THEN 'warn' ELSE 'pass' END AS outcome FROM orders GROUP BY 1
""")
def record_security_dependency_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("low").alias("severity"), F.when(F.col("o_totalprice") >= 200000, "o").otherwise("").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("fixed_at"),
    )
    rows = written(read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("crawl_id")).agg(F.collect_list(one).alias("entries")), "vulnerabilities")
    audit = crawls(spark, rows)
    audit.inputs["vulnerabilities"] = held(rows, "vulnerabilities", entries=F.col("entries"))
    return outcomes("security-dependency-maintenance", audit)


@query("""
WITH d AS (SELECT user_id, event_id % 10 AS u, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT user_id::VARCHAR AS crawl_id, CASE WHEN user_id % 11 = 0 THEN 'fail' WHEN max(n) > 5 THEN 'fail' ELSE 'warn' END AS outcome FROM d GROUP BY user_id
""")
def record_indexnow_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("user_id") % 11 == 0, "https://other.com/").otherwise("https://example.com/")
    one = F.struct(F.concat(host, F.col("event_id") % 10).alias("url"), F.col("ts").cast("timestamp").alias("sent_at"), F.lit(200).alias("status"))
    events = read(spark, sf_dir, "events").withColumn("crawl_id", F.col("user_id").cast("string"))
    rows = written(events.select("crawl_id").distinct(), "users")
    audit = crawls(spark, rows)
    audit.inputs["index_now"] = held(rows, "index_now", key=F.lit("k"))
    audit.rows["index_now.log"] = events.select("crawl_id", one.alias("one")).select("crawl_id", "one.*")
    return outcomes("indexnow-integration", audit)


@query("""
SELECT s_suppkey::VARCHAR AS crawl_id, CASE WHEN s_nationkey % 4 = 3 THEN 'fail' WHEN s_suppkey % 3 = 0 THEN 'fail' WHEN s_suppkey % 3 = 1 THEN 'warn' ELSE 'pass' END AS outcome FROM supplier
""")
def record_gsc_property_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").withColumn("crawl_id", F.col("s_suppkey").cast("string"))
    kind = F.col("s_nationkey") % 4
    name = F.when(kind == 0, "sc-domain:example.com").when(kind == 1, "https://www.example.com").when(kind == 2, "https://www.example.com/").otherwise("sc-domain:other.com")
    owners = F.slice(F.array(F.lit("a@x"), F.lit("B@x "), F.lit("b@x")), 1, F.when(F.col("s_suppkey") % 3 == 2, 3).otherwise(F.col("s_suppkey") % 3).cast("int"))
    audit = crawls(spark, rows, origin=F.lit("https://www.example.com"))
    audit.inputs["search_console"] = held(rows, "search_console", properties=F.array(F.struct(name.alias("property"), owners.alias("owners"))))
    return outcomes("gsc-property-ownership", audit)


@query("""
WITH RECURSIVE m AS (SELECT c_nationkey AS n, c_custkey AS s, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1 WHEN c_custkey % 11 = 0 THEN c_custkey ELSE NULL END AS t FROM customer)
SELECT n::VARCHAR AS crawl_id, CASE WHEN count(*) FILTER (WHERE t IS NOT NULL AND (t = s OR t IN (SELECT x.s FROM m x WHERE x.n = m.n AND x.t IS NOT NULL) OR t IN (SELECT x.s FROM m x WHERE x.n = m.n))) > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM m WHERE t IS NOT NULL GROUP BY n
""")
def record_migration_map_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    goal = F.when(key % 7 == 0, key + 1).when(key % 11 == 0, key)
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("crawl_id"), key.alias("s"), goal.alias("t")).where("t is not null")
    one = F.struct(F.concat(F.lit("/"), "s").alias("from"), F.lit(None).cast("int").alias("expect"), F.concat(F.lit("/"), "t").alias("to"))
    maps = written(rows.groupBy("crawl_id").agg(F.collect_list(one).alias("entries")), "maps")
    audit = crawls(spark, maps)
    audit.inputs["redirect_map"] = held(maps, "redirect_map", kind=F.lit("cleanup"), entries=F.col("entries"))
    return outcomes("migration-map-builder", audit)


_AFTER = """
WITH o AS (SELECT o_custkey AS c, o_orderpriority AS p, 'https://example.com/' || (o_orderkey % 4) || '/x' AS page, o_orderdate < DATE '1998-06-01' AS old, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2, 3, 4),
m AS (SELECT n.c, n.p, n.page, b.s = 'F' AS was_pass, CASE n.s WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'warn' END AS now FROM o n JOIN o b ON n.c = b.c AND n.p = b.p AND n.page = b.page AND b.old AND NOT n.old),
k AS (SELECT c, bool_or(old) AS known FROM o GROUP BY 1)
"""


def _two_audits(spark: SparkSession, sf_dir: str) -> tuple[Audit, DataFrame]:
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("crawl_id"), F.col("o_orderpriority").alias("probe_id"), F.concat(F.lit("https://example.com/"), F.col("o_orderkey") % 4, F.lit("/x")).alias("page_url"),
        (F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp")).alias("old"), "o_orderstatus", "o_orderkey",
    )
    last = written(orders.groupBy("crawl_id", "probe_id", "page_url", "old").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s")), "halves")
    outcome = F.when(F.col("s") == "F", "pass").when(F.col("s") == "O", "fail").otherwise("warn").alias("outcome")
    audit = crawls(spark, last.select("crawl_id").distinct())
    audit.previous_probes = last.where("old").select("crawl_id", "probe_id", "page_url", outcome)
    return audit, last.where("not old").select("crawl_id", "probe_id", F.lit("page").alias("scope"), "page_url", outcome, F.lit("").alias("summary"), F.lit(None).cast("string").alias("data"))


@query(_AFTER + """SELECT k.c::VARCHAR AS crawl_id, CASE WHEN NOT known THEN 'not-applicable' WHEN count(*) FILTER (WHERE was_pass AND now = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM k LEFT JOIN m ON m.c = k.c GROUP BY k.c, known""")
def after_quarterly_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AFTER["quarterly-regression-crawl"](*_two_audits(spark, sf_dir)).select("crawl_id", "outcome")


@query(_AFTER + """
, g AS (SELECT c, p, count(*) AS n, count(*) FILTER (WHERE now = 'fail') AS w FROM m WHERE was_pass GROUP BY 1, 2)
SELECT k.c::VARCHAR AS crawl_id, CASE WHEN NOT known THEN 'not-applicable' WHEN count(*) FILTER (WHERE n >= 2 AND w * 2 >= n) > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM k LEFT JOIN g ON g.c = k.c GROUP BY k.c, known
""")
def after_template_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AFTER["conditional-template-monitor"](*_two_audits(spark, sf_dir)).select("crawl_id", "outcome")



# ---- scalars and the queue


@query("""
SELECT count(*) FILTER (WHERE lane = 'a.com') AS plain, count(*) FILTER (WHERE lane = 'a.com:8443') AS ported, sum(wait)::BIGINT AS waits, max(ref) AS ref
FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'a.com' WHEN 1 THEN 'a.com:8443' WHEN 2 THEN 'a.com' ELSE 'b.org' END AS lane, least(30000 * 4 ** (o_orderkey % 5), 600000) AS wait, 'audit:' || o_orderkey || '#1.1' AS ref FROM orders)
""")
def scalar_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions import scalars as S

    key = F.col("o_orderkey")
    url = F.when(key % 4 == 0, "https://www.a.com:443/x").when(key % 4 == 1, "https://A.com:8443/").when(key % 4 == 2, "http://u@a.com/y").otherwise("http://b.org")
    rows = read(spark, sf_dir, "orders").select(S.audit_lane(url).alias("lane"), S.backoff_ms(key % 5 + 1).alias("wait"), S.evidence_reference(key.cast("string"), F.lit("1.1")).alias("ref"))
    return rows.agg(F.count_if(F.col("lane") == "a.com").alias("plain"), F.count_if(F.col("lane") == "a.com:8443").alias("ported"), F.sum("wait").alias("waits"), F.max("ref").alias("ref"))


@query("""
SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units, length(CASE WHEN length(text) > 500 THEN text[:500] || '…' ELSE text END) AS kept FROM documents
""")
def scalar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions import scalars as S

    return read(spark, sf_dir, "documents").select("doc_id", S.utf16_length(F.col("text")).alias("units"), F.length(S.bounded(F.col("text"))).cast("long").alias("kept"))


@query("""
SELECT CASE p_partkey % 3 WHEN 0 THEN 'lcp' WHEN 1 THEN 'inp' ELSE 'cls' END AS metric,
       CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_retailprice * 3 <= 2500 THEN 'good' WHEN p_retailprice * 3 <= 4000 THEN 'needs-improvement' ELSE 'poor' END
            WHEN 1 THEN CASE WHEN p_retailprice / 5 <= 200 THEN 'good' WHEN p_retailprice / 5 <= 500 THEN 'needs-improvement' ELSE 'poor' END
            ELSE CASE WHEN p_size / 100.0 <= 0.1 THEN 'good' WHEN p_size / 100.0 <= 0.25 THEN 'needs-improvement' ELSE 'poor' END END AS grade, count(*) AS n FROM part GROUP BY 1, 2
""")
def scalar_field_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions import scalars as S

    kind = F.col("p_partkey") % 3
    metric = F.when(kind == 0, "lcp").when(kind == 1, "inp").otherwise("cls")
    value = F.when(kind == 0, F.col("p_retailprice") * 3).when(kind == 1, F.col("p_retailprice") / 5).otherwise(F.col("p_size") / 100)
    return read(spark, sf_dir, "part").select(metric.alias("metric"), S.field_grade(metric, value).alias("grade")).groupBy("metric", "grade").agg(F.count("*").alias("n"))


@query("""
WITH j AS (SELECT o_orderkey AS job_id, o_custkey % 200 AS lane, o_totalprice AS priority, o_orderkey AS seq, CASE WHEN o_orderkey % 997 = 0 THEN 'running' ELSE 'queued' END AS state, o_orderdate <= TIMESTAMP '1999-01-01' AS due FROM orders),
f AS (SELECT lane, arg_min(job_id, (-priority, seq)) AS job_id, max(priority) AS priority FROM j WHERE state = 'queued' AND due AND lane NOT IN (SELECT lane FROM j WHERE state = 'running') GROUP BY 1)
SELECT job_id, lane FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, job_id) AS turn FROM f) WHERE turn <= 40 - (SELECT count(*) FROM j WHERE state = 'running')
""")
def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.queue import next_jobs

    jobs = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 200).alias("lane"), F.col("o_totalprice").alias("priority"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 997 == 0, "running").otherwise("queued").alias("state"), F.col("o_orderdate").cast("timestamp").alias("due_at"), F.lit(True).alias("durable"),
    )
    return next_jobs(jobs, F.lit("1999-01-01 00:00:00").cast("timestamp"), 40).select("job_id", "lane")
