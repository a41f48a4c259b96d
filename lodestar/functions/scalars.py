"""Small scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(value + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """Part of whole in percent, halves up; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(half_up(part / whole * 100)).cast("int")


def figure_gap(a: Column, b: Column) -> Column:
    """How far two figures are apart, as a share of the larger; 0 if both are 0."""
    return F.coalesce(F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0)), F.lit(0.0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as browsers count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def audit_lane(url: Column) -> Column:
    """Host without www, and the port where it isn't the scheme's own: audits of one lane
    run one after another."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"(?i)^https?://(?:[^/@?#]*@)?[^/:?#]+:(\d+)", 1)
    own = F.when(F.lower(url).startswith("https:"), "443").otherwise("80")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.when((port != "") & (port != own), F.concat(F.lit(":"), port)).otherwise(""))


def backoff_ms(attempt: Column, base: int = 30_000, factor: int = 4, most: int = 600_000) -> Column:
    """How long to wait before the attempt after this one."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(most)).cast("long")


def id_key(check_id: Column) -> Column:
    """A dotted id as numbers, so that 1.2 comes before 1.10."""
    return F.transform(F.split(check_id, r"\."), lambda p: p.cast("int"))


def evidence_reference(audit_id: Column, check_id: Column) -> Column:
    return F.concat(F.lit("audit:"), audit_id, F.lit("#"), check_id)


def bounded(text: Column, most: int = 500) -> Column:
    """A text of at most so many characters, with a mark where it is cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def bounded_list(values: Column, most: int = 25) -> Column:
    """A list of at most so many values, with how many were cut as its last."""
    cut = F.concat(F.slice(values, 1, most), F.array(F.concat(F.lit("… "), (F.size(values) - most).cast("string"), F.lit(" more"))))
    return F.when(F.size(values) > most, cut).otherwise(values)


def media_id(url: Column) -> Column:
    """A player's video: its v parameter, or the last segment of its path."""
    asked = F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit(""))
    return F.coalesce(asked, F.nullif(F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"/([^/]+)/?$", 1), F.lit("")))


def publication_span(value: Column) -> Column:
    """Struct (earliest, latest) of a W3C date: a date alone spans all time zones; null
    if it is no date or lacks a zone."""
    text = F.trim(value)
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    timed = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    early = F.when(day, F.concat(text, F.lit("T00:00:00+14:00"))).when(timed, text).try_cast("timestamp")
    late = F.when(day, F.concat(text, F.lit("T23:59:59.999-12:00"))).when(timed, text).try_cast("timestamp")
    return F.when(early.isNotNull() & late.isNotNull(), F.struct(early.alias("earliest"), late.alias("latest")))


def field_grade(metric: Column, p75: Column) -> Column:
    """good, needs-improvement or poor, of a field metric's 75th percentile."""
    good = F.when(metric == "lcp", 2500.0).when(metric == "inp", 200.0).when(metric == "cls", 0.1)
    poor = F.when(metric == "lcp", 4000.0).when(metric == "inp", 500.0).when(metric == "cls", 0.25)
    return F.when(p75 <= good, "good").when(p75 <= poor, "needs-improvement").when(p75 > poor, "poor")


def property_covers(property_: Column, origin: Column) -> Column:
    """Whether a search property covers an origin: a domain and all below it, or a URL
    prefix; null if it can't be read."""
    host = F.lower(F.regexp_extract(origin, r"(?i)^https?://([^/:?#]+)", 1))
    domain = F.lower(F.regexp_replace(property_, "^sc-domain:", ""))
    prefix = F.concat(F.regexp_replace(F.lower(property_), "/+$", ""), F.lit("/"))
    whole = F.concat(F.regexp_replace(F.lower(origin), "/+$", ""), F.lit("/"))
    return F.when(property_.startswith("sc-domain:"), (host == domain) | host.endswith(F.concat(F.lit("."), domain))).when(property_.rlike("(?i)^https?://"), whole.startswith(prefix))
