"""Small scalar functions and queue queries."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.plans import queue

NOW = datetime(2026, 3, 1)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalars(spark):
    r = one(
        spark, a=S.half_up(F.lit(-0.5)), b=S.percent(F.lit(1), F.lit(8)), c=S.percent(F.lit(0), F.lit(0)), d=S.utf16_length(F.lit("a😀")), e=S.audit_lane(F.lit("https://www.Ex.com:8443/x")), f=S.media_id(F.lit("https://y.com/embed/abc?x=1")),
        g=S.media_id(F.lit("https://y.com/watch?v=q1")), h=S.property_covers(F.lit("sc-domain:ex.com"), F.lit("https://www.ex.com")), i=S.property_covers(F.lit("https://ex.com/shop"), F.lit("https://ex.com")), j=S.property_covers(F.lit("ex.com"), F.lit("https://ex.com")),
        k=S.bounded(F.lit("x" * 501)), m=S.bounded_list(F.sequence(F.lit(1), F.lit(30)).cast("array<string>")), n=S.publication_span(F.lit("2026-02-30")), o=S.publication_span(F.lit("2026-02-28")), p=S.publication_span(F.lit("2026-02-28T10:00")), q=S.figure_gap(F.lit(90.0), F.lit(100.0)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (0, 13, 0, 3, "ex.com:8443", "abc", "q1", True, False, None)
    assert len(r.k) == 501 and r.m[-1] == "… 5 more" and len(r.m) == 26 and r.n is None and r.p is None and abs(r.q - 0.1) < 1e-12
    assert r.o.latest - r.o.earliest == timedelta(days=1, hours=25, minutes=59, seconds=59, microseconds=999000)
    ids = spark.createDataFrame([("1.10",), ("1.2",), ("0.9",)], "i string").orderBy(S.id_key(F.col("i"))).collect()
    assert [x.i for x in ids] == ["0.9", "1.2", "1.10"]


def test_queue(spark):
    names = "job_id lane priority seq state due_at durable attempts permanent renewed_at"
    rows = [
        (1, "a", 0, 1, "queued", None, True, 0, None, None), (2, "a", 5, 2, "queued", None, True, 0, None, None), (3, "b", 1, 3, "queued", NOW + timedelta(1), True, 0, None, None), (4, "c", 9, 4, "queued", None, True, 0, None, None),
        (5, "c", 0, 5, "running", None, True, 1, None, NOW - timedelta(hours=1)), (6, "d", 0, 6, "queued", None, False, 0, None, None), (7, "e", 0, 7, "failed", None, True, 2, False, None), (8, "e", 0, 8, "failed", None, True, 3, False, None), (9, "f", 1, 9, "queued", None, True, 0, None, None),
    ]
    jobs = spark.createDataFrame(rows, "job_id int, lane string, priority int, seq int, state string, due_at timestamp, durable boolean, attempts int, permanent boolean, renewed_at timestamp")
    assert len(names.split()) == len(jobs.columns)
    now = F.lit(NOW)
    assert sorted(r.job_id for r in queue.next_jobs(jobs, now, 3).collect()) == [2, 9] and [r.job_id for r in queue.next_jobs(jobs, now, 2).collect()] == [2]
    assert [r.job_id for r in queue.abandoned(jobs, now, 60).collect()] == [5]
    assert [(r.job_id, r.due_at) for r in queue.retries(jobs, now).collect()] == [(7, NOW + timedelta(seconds=120))]
    audits = spark.createDataFrame([(1, "running", NOW - timedelta(1)), (2, "running", NOW - timedelta(1)), (3, "complete", NOW - timedelta(1)), (4, "queued", NOW)], "audit_id int, status string, created_at timestamp")
    assert [r.audit_id for r in queue.lost_audits(audits, audits.where("audit_id = 2"), now).collect()] == [1]
