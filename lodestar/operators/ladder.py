"""Detectors as ordered ladders: the first rung whose condition holds decides.

A rung is (outcome, condition, summary): the condition is a SQL expression, the
summary text in which ``{expression}`` stands for a SQL value.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rung = tuple[str, str, str]
NA, PASS, WARN, FAIL, ERROR = "not-applicable", "pass", "warn", "fail", "error"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def said(text: str) -> str:
    """SQL of a summary."""
    parts = re.split(r"\{([^{}]*)\}", text)
    pieces = [f"coalesce(string({p}), '')" if i % 2 else _quoted(p) for i, p in enumerate(parts) if p]
    return f"concat({', '.join(pieces)})" if pieces else "''"


def verdict(rungs: Sequence[Rung]) -> Column:
    """A struct (outcome, summary); if no rung holds, an error."""
    whens = " ".join(f"when coalesce({when}, false) then named_struct('outcome', '{outcome}', 'summary', {said(text)})" for outcome, when, text in rungs)
    return F.expr(f"case {whens} else named_struct('outcome', 'error', 'summary', 'no rung decided') end")


def observed(rows: DataFrame, probe: str, rungs: Sequence[Rung], scope: str = "site", url: str = "string(null)", data: str = "string(null)") -> DataFrame:
    """One observation per row, which must have crawl_id."""
    return rows.select(
        "crawl_id", F.lit(probe).alias("probe_id"), F.lit(scope).alias("scope"), F.expr(url).alias("page_url"), verdict(rungs).alias("v"), F.expr(data).alias("data")
    ).select("crawl_id", "probe_id", "scope", "page_url", "v.outcome", "v.summary", "data")
