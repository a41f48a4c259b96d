"""Language tags as search engines read them in hreflang."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: fixed values: codes that others have replaced
WITHDRAWN = {"iw": "he", "in": "id", "ji": "yi", "mo": "ro", "sh": "sr"}


@dataclass(frozen=True)
class Codes:
    """ISO 639-1 languages and ISO 3166-1 regions."""

    languages: frozenset[str]
    regions: frozenset[str]


def codes(spark: SparkSession) -> Codes:
    """The codes that the Java runtime knows."""
    locale = spark._jvm.java.util.Locale
    return Codes(frozenset(locale.getISOLanguages()) - set(WITHDRAWN), frozenset(locale.getISOCountries()))


def problem(tag: str, known: Codes) -> str:
    """Empty if the tag is supported; else ``invalid: ...`` or ``unsupported: ...``."""
    parts = tag.strip().replace("_", "-").split("-")
    language, rest = parts[0].lower(), parts[1:]
    if "_" in tag:
        return "invalid: subtags are parted by hyphens"
    if language in WITHDRAWN:
        return f"invalid: {language} is withdrawn, {WITHDRAWN[language]} replaces it"
    if language not in known.languages:
        return f"invalid: {language} is no language"
    if rest and re.fullmatch("[A-Za-z]{4}", rest[0]):
        rest = rest[1:]
    if not rest:
        return ""
    region = rest[0].upper()
    if len(rest) > 1:
        return "invalid: too many subtags"
    if re.fullmatch(r"\d{3}", region):
        return f"unsupported: {region} is an area code"
    return "" if region in known.regions else f"invalid: {region} is no region"


def tag_problem(tag: Column, known: Codes) -> Column:
    def run(tags: pd.Series) -> pd.Series:
        return tags.map(lambda t: None if t is None else problem(t, known))

    return F.pandas_udf(run, "string")(tag)
