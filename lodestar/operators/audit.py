"""The tables of one or many crawls, and the facts that detectors share."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas

_TABLES = {
    "sitemaps": schemas.SITEMAPS, "sitemap_urls": schemas.SITEMAP_URLS, "sitemap_news": schemas.SITEMAP_NEWS, "sitemap_video": schemas.SITEMAP_VIDEO,
    "auxiliary": schemas.AUXILIARY, "blocked": schemas.URLS, "not_reached": schemas.URLS, "seeds": schemas.URLS,
    "previous_pages": schemas.PREVIOUS_PAGES, "previous_probes": schemas.PREVIOUS_PROBES, "gates": schemas.GATES,
}
NETLOC = r"regexp_extract({}, '^[a-z]+://(?:[^/@?#]*@)?([^/?#]*)', 1)"
#: the noindex test of page directives, either word
NOINDEX_OR_NONE = "(?i)\\\\bnoindex\\\\b|\\\\bnone\\\\b"
NOINDEX = "(?i)\\\\bnoindex\\\\b"
_SHORT = {"fetch": "f", "extracted": "x", "rendered": "r", "rendered_mobile": "m"}
_OF_PAGE = (
    "x is not null as is_html",
    "x is not null and f.status = 200 as html_200",
    f"rlike(coalesce(x.meta_robots, ''), '{NOINDEX}') as meta_noindex",
    f"rlike(coalesce(x.meta_robots, ''), '{NOINDEX_OR_NONE}') or rlike(coalesce(f.headers['x-robots-tag'], ''), '{NOINDEX_OR_NONE}') as kept_out",
    f"rlike(concat(coalesce(x.meta_robots, ''), ' ', coalesce(f.headers['x-robots-tag'], '')), '{NOINDEX}') as any_noindex",
    "regexp_extract(normalized_url, '^https?://[^/?#]*([^?#]*)', 1) as path",
    "size(f.redirect_chain) as hops",
    "coalesce(try_element_at(f.redirect_chain, 1).status, f.status) as first_status",
)
#: as many crawls may be sent to every executor
FEW_CRAWLS = 1000


def same_site(url: str) -> str:
    """SQL: whether a serialised URL is of the site's host and port."""
    return f"{NETLOC.format(url)} = site_netloc"


@dataclass
class Audit:
    """Crawls by ``crawl_id``: one row per site, pages, and what else is known."""

    spark: SparkSession
    sites: DataFrame
    pages: DataFrame
    sitemaps: DataFrame | None = None
    sitemap_urls: DataFrame | None = None
    sitemap_news: DataFrame | None = None
    sitemap_video: DataFrame | None = None
    auxiliary: DataFrame | None = None
    blocked: DataFrame | None = None
    not_reached: DataFrame | None = None
    seeds: DataFrame | None = None
    previous_pages: DataFrame | None = None
    previous_probes: DataFrame | None = None
    gates: DataFrame | None = None
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    #: long lists of sections (``schemas.LONG``) as tables of rows with crawl_id, which no
    #: task has to hold whole
    rows: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in _TABLES and getattr(self, f.name) is None:
                setattr(self, f.name, self.spark.createDataFrame([], _TABLES[f.name]))

    def given(self, section: str) -> DataFrame:
        """A person-supplied record, one row per crawl that has it."""
        have = self.inputs.get(section)
        return have if have is not None else self.spark.createDataFrame([], f"{schemas.HELD}, {schemas.INPUTS[section]}")

    @cached_property
    def many(self) -> bool:
        """Whether there are more crawls than a driver should hand out."""
        return self.sites.limit(FEW_CRAWLS + 1).count() > FEW_CRAWLS

    def met(self, rows: DataFrame) -> DataFrame:
        """``rows``, never broadcast where crawls are many.  Spark takes a few columns of a
        wide table for so small a part of its (compressed) file that it would send all
        crawls' pages by the driver.  Few crawls are left to it: dealt out by crawl, all
        their pages would be few tasks'."""
        return rows.hint("merge") if self.many else rows

    @cached_property
    def site_facts(self) -> DataFrame:
        return self.met(self.sites.withColumn("site_netloc", F.expr(NETLOC.format("lower(origin)"))))

    @cached_property
    def facts(self) -> DataFrame:
        """Pages with their site's facts and what most detectors ask of a page."""
        site = self.site_facts.select("crawl_id", "origin", "site_netloc", "flags", "robots_txt", "crawled_at")
        joined = self.met(self.pages).join(site, "crawl_id").withColumnsRenamed(_SHORT)
        return self.met(joined.selectExpr("*", *_OF_PAGE))

    @cached_property
    def own_facts(self) -> DataFrame:
        """``facts`` without the site's, for detectors that ask nothing of it: pages are not joined."""
        return self.pages.withColumnsRenamed(_SHORT).selectExpr("*", *_OF_PAGE)

    @cached_property
    def edges(self) -> DataFrame:
        """Internal and external links: (crawl_id, from_url, to_url, target, internal, ...)."""
        return (
            self.facts.where("is_html")
            .selectExpr("crawl_id", "normalized_url as from_url", "html_200 as from_200", "site_netloc", "posexplode(x.links) as (at, link)")
            .selectExpr("crawl_id", "from_url", "from_200", "at", "link.*", f"{same_site('link.url')} as internal")
        )

    @cached_property
    def alternates(self) -> DataFrame:
        """hreflang annotations of pages answered with 200."""
        return self.facts.where("html_200").selectExpr(
            "crawl_id", "normalized_url as page", "x.canonical_target as canonical", "f.final_url as final_url", "x.lang as lang", "meta_noindex", "site_netloc", "explode(x.hreflang) as alt"
        )
