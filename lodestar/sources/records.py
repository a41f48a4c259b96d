"""Catalogues of checks, Lighthouse reports and person-supplied records."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas


def _load(path: Path) -> Any:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise ValueError(f"{path}: reading YAML needs a YAML library; give JSON instead") from missing
    return yaml.safe_load(text)


def problems_of(check: dict[str, Any]) -> list[str]:
    """What is wrong with a catalogue entry."""
    found = [f"{f} is missing" for f in ("id", "phase", "automation") if check.get(f) in (None, "")]
    if check.get("automation") not in ("automated", "assisted", "attested"):
        found.append(f"automation {check.get('automation')!r} is unknown")
    if not isinstance(check.get("phase"), int) or not 0 <= check["phase"] <= 7:
        found.append("phase is not one of 0 to 7")
    scope = check.get("applicability") or {}
    if not scope.get("universal") and not scope.get("any"):
        found.append("neither universal nor bound to a flag")
    return found


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of a folder of phase files (read by the driver: about a hundred
    entries), or an error that lists all that is wrong."""
    files = sorted(p for p in Path(folder).iterdir() if p.stem.startswith("phase-"))
    checks = [c for p in files for c in _load(p)]
    wrong = [f"{c.get('id', '?')}: {p}" for c in checks for p in problems_of(c)]
    ids = [c.get("id") for c in checks]
    wrong += [f"{i}: repeated" for i in sorted({i for i in ids if ids.count(i) > 1}, key=str)]
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = [
        (
            Path(folder).name, c["id"], c.get("task"), c["phase"], bool(c.get("launchGate")), c["automation"], bool((c.get("applicability") or {}).get("universal")),
            list((c.get("applicability") or {}).get("any") or []), list(c.get("detectors") or []), c.get("priority"),
        )
        for c in checks
    ]
    return spark.createDataFrame(rows, schemas.CHECKS)


def unknown_flags(checks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Flags of profiles that no check of the catalogue names."""
    return profiles.select("crawl_id", F.explode("flags").alias("flag")).join(checks.select(F.explode("flags").alias("flag")), "flag", "left_anti")


def lighthouse_reports(spark: SparkSession, path: str) -> DataFrame:
    """(url, test_profile, fetched_at, metrics, lcp_element) of report files."""
    node = "details struct<items:array<struct<items:array<struct<node:struct<snippet:string>>>>>>"
    audit = f"struct<numericValue:double,{node.replace(' struct', ':struct')}>"
    schema = (
        "finalDisplayedUrl string, requestedUrl string, fetchTime timestamp, configSettings struct<formFactor:string>, "
        f"audits struct<`largest-contentful-paint`:{audit},`cumulative-layout-shift`:{audit},`total-blocking-time`:{audit},`largest-contentful-paint-element`:{audit}>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    snippet = "try_element_at(try_element_at(audits.`largest-contentful-paint-element`.details.items, 1).items, 1).node.snippet"

    def attribute(name: str) -> str:
        return f"nullif(regexp_extract({snippet}, '(?i)\\\\b{name}=\"([^\"]*)\"', 1), '')"

    return raw.selectExpr(
        "coalesce(finalDisplayedUrl, requestedUrl) as url", "configSettings.formFactor as test_profile", "fetchTime as fetched_at",
        "map_filter(map('lcp', audits.`largest-contentful-paint`.numericValue, 'cls', audits.`cumulative-layout-shift`.numericValue, 'tbt', audits.`total-blocking-time`.numericValue), (k, v) -> v is not null) as metrics",
        f"if({snippet} is null, null, named_struct('tag', lower(regexp_extract({snippet}, '^<([a-zA-Z0-9]+)', 1)), 'src', {attribute('src')}, 'loading', {attribute('loading')}, 'fetch_priority', {attribute('fetchpriority')})) as lcp_element",
    )


def record(spark: SparkSession, section: str, path: str) -> DataFrame:
    """A person-supplied section from JSON files, strictly typed: a row that does not
    fit its schema is an error."""
    return spark.read.schema(f"{schemas.HELD}, {schemas.INPUTS[section]}").option("mode", "FAILFAST").json(path)


def unanswered(rows: DataFrame) -> DataFrame:
    """Records without owner or time."""
    return rows.where("trim(coalesce(owner, '')) = '' or recorded_at is null")


def import_runs(log: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts) of review runs: an identical run is skipped, one of a
    known id that differs is a conflict, and any conflict means nothing is appended."""
    same = staged.exceptAll(log)
    conflicts = same.join(log.select("site_id", "run_id"), ["site_id", "run_id"], "left_semi")
    twice = same.groupBy("site_id", "run_id").count().where("count > 1").select("site_id", "run_id")
    wrong = conflicts.select("site_id", "run_id").union(twice).distinct()
    return same.join(wrong, ["site_id", "run_id"], "left_anti"), wrong
