"""URL filters: host and path rules, and a weighted vocabulary by Aho-Corasick.

The longest rule that fits decides.  Where none does, the URL is searched for
terms: one strict term, or distinct soft terms whose weights sum to the limit
(no weight reaches it alone), block it.  A term counts only between boundaries: neither side may be a letter
or digit.  Matching is on the URL with A-Z lower-cased.

Nulls and odd rows: a null URL, or one without ``://``, has an empty host and
path, fits no rule, and is allowed unless its text holds terms.  Rows are judged
one by one, so that ties, repeated rows, very long URLs and extra columns (carried in
``row``) change nothing; an empty table gives no rows.  Terms and rules go to every
task in parts of at most ``MOST_ENTRIES`` entries: all URLs are looked at with one
part after the other, and what is found adds up.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import kept
from lodestar.llm.streams import with_row
from lodestar.llm.url_words import LIMIT, SOFT, STRICT

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_ENTRIES = 1_000_000


def _lower(text: str) -> str:
    return text.translate(_AZ)


_AZ = {c: c + 32 for c in range(0x41, 0x5B)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:stop].partition("/")
    return _lower(host), slash + path


class Judge:
    def __init__(self, strict: tuple[str, ...], soft: tuple[tuple[str, int], ...], rules: tuple[tuple[str, str, str], ...]) -> None:
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(_lower(host), []).append((path, verdict))
        for of_host in self.rules.values():  # the longest first; of one path, blocking
            of_host.sort(key=lambda x: (-len(x[0]), x[1] != "block"))
        self.terms = ahocorasick.Automaton()
        for term, weight in [*soft, *((t, 0) for t in strict)]:  # weight 0: strict
            self.terms.add_word(_lower(term), (len(term), _lower(term), weight))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        at = 0
        while host:
            for prefix, verdict in self.rules.get(host[at:], ()):
                if path.startswith(prefix):
                    name = host[at:] + prefix
                    if best is None or len(name) > best[0]:
                        best = len(name), name, verdict
                    break
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return (best[1], best[2]) if best else (None, None)

    def terms_of(self, url: str) -> tuple[list[str], list[str], int]:
        """Distinct strict and soft terms, and the soft ones' weight."""
        strict, soft = set(), {}
        for end, (size, term, weight) in self.terms.iter(url) if len(self.terms) else ():
            before, after = end - size, end + 1
            if (before >= 0 and url[before].isalnum()) or (after < len(url) and url[after].isalnum()):
                continue
            if weight:
                soft[term] = weight
            else:
                strict.add(term)
        return sorted(strict), sorted(soft), sum(soft.values())

    def __call__(self, url: str | None, rule: str | None, said: str | None, strict: list[str], soft: list[str], weight: int) -> tuple:
        """What is found with these terms and rules, added to what was found before."""
        host, path = parts(url)
        own, verdict = self.rule(host, path)
        if own is not None and (rule is None or len(own) > len(rule) or (len(own) == len(rule) and verdict == "block")):
            rule, said = own, verdict
        more_strict, more_soft, more = self.terms_of(_lower(url or ""))
        return host, path, rule, said, sorted({*strict, *more_strict}), sorted({*soft, *more_soft}), weight + more


@functools.cache
def judge(*with_: tuple) -> Judge:
    return Judge(*with_)


_FIELDS = "url string, host string, path string, rule string, said string, strict_terms array<string>, soft_terms array<string>, soft_weight long"


def _judged(*with_: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = judge(*with_)
        for batch in batches:
            before = [batch.column(name).to_pylist() for name in ("url", "rule", "said", "strict_terms", "soft_terms", "soft_weight")]
            columns = list(zip(*map(one, *before), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("url"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["row", "url", "host", "path", "rule", "said", "strict_terms", "soft_terms", "soft_weight"],
            )

    return run


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    strict: tuple[str, ...] = STRICT,
    soft: dict[str, int] = SOFT,
    limit: int = LIMIT,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    most: int = MOST_ENTRIES,
) -> DataFrame:
    """One row per row of ``pages``: ``row`` (its other columns), host, path, rule,
    verdict, and the terms found."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != url_col]
    none = F.array().cast("array<string>")
    rows = pages.select(
        F.struct(*rest).alias("row"), F.col(f"`{url_col}`").cast("string").alias("url"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("said"), none.alias("strict_terms"), none.alias("soft_terms"), F.lit(0).cast("long").alias("soft_weight"),
    )
    strict, soft_items, rules = tuple(dict.fromkeys(map(_lower, strict))), tuple({_lower(t): w for t, w in soft.items()}.items()), tuple(rules)
    for at in range(0, max(1, len(strict), len(soft_items), len(rules)), most):
        if at:
            rows = kept(rows, "urls-judged")  # so that one part of the terms is in memory at a time
        run = _judged(strict[at : at + most], soft_items[at : at + most], rules[at : at + most])
        rows = rows.mapInArrow(run, with_row(rows, _FIELDS))
    unwanted = (F.size("strict_terms") > 0) | (F.col("soft_weight") >= limit)
    verdict = F.coalesce("said", F.when(unwanted, "block").otherwise("allow"))
    return rows.select("row", "host", "path", "rule", verdict.alias("verdict"), "strict_terms", "soft_terms", "soft_weight")
