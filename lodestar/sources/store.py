"""Sinks: pages by crawl, bodies by content, and bodies read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blobs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(hash, path, body): every distinct body once, named by its SHA-256."""
    hashed = bodies.where(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("hash"), F.col(body).alias("body")).dropDuplicates(["hash"])
    return hashed.select("hash", F.concat_ws("/", F.lit("sha256"), F.substring("hash", 1, 2), F.substring("hash", 3, 62)).alias("path"), "body")


def put_if_absent(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Bodies that the store does not hold."""
    return new.join(stored.select("hash"), "hash", "left_anti")


def read_back(renders: DataFrame, stored: DataFrame) -> DataFrame:
    """Renders with their body and whether it is ok, not-stored, missing or corrupt."""
    met = renders.join(stored.select(F.col("hash").alias("body_hash"), "body"), "body_hash", "left")
    state = (
        F.when(F.col("body_hash").isNull(), "not-stored").when(F.col("body").isNull(), "missing").when(F.sha2(F.col("body").cast("binary"), 256) != F.col("body_hash"), "corrupt").otherwise("ok")
    )
    return met.withColumn("state", state)


def page_links(pages: DataFrame) -> DataFrame:
    """The link graph: anchors, canonicals, alternates and redirects as edges."""
    own = "crawl_id, normalized_url as from_url"
    anchors = pages.selectExpr(*own.split(", "), "explode(extracted.links) as l").selectExpr("crawl_id", "from_url", "l.url as to_url", "l.target as to_normalized_url", "'anchor' as kind", "l.anchor_text as anchor_text", "l.rel as rel", "l.nofollow as nofollow")
    canonicals = pages.where("extracted.canonical is not null").selectExpr(*own.split(", "), "extracted.canonical", "extracted.canonical_target", "'canonical'", "string(null)", "string(null)", "false")
    alternates = pages.selectExpr(*own.split(", "), "explode(extracted.hreflang) as a").selectExpr("crawl_id", "from_url", "a.url", "a.target", "'hreflang'", "a.hreflang", "string(null)", "false")
    paging = anchors.where("rlike(coalesce(rel, ''), '(?i)\\\\b(next|prev)\\\\b')").withColumn("kind", F.lit("pagination"))
    moved = pages.where("size(fetch.redirect_chain) > 0").selectExpr(*own.split(", "), "fetch.final_url", "fetch.final_url", "'redirect'", "string(null)", "string(null)", "false")
    return anchors.union(canonicals).union(alternates).union(paging).union(moved)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").partitionBy("crawl_id").parquet(path)


def host_variants(origins: DataFrame) -> DataFrame:
    """(crawl_id, url): the other schemes and www forms of sites' hosts; none for
    addresses, localhost and single labels."""
    rows = origins.selectExpr("crawl_id", "lower(regexp_extract(origin, '^(https?)://', 1)) as scheme", "lower(regexp_extract(origin, '^https?://([^/?#]+)', 1)) as host")
    named = rows.where("contains(host, '.') and not rlike(host, '^[0-9.]+(:[0-9]+)?$|^\\\\[') and not startswith(host, 'localhost')").selectExpr("*", "regexp_replace(host, '^www[.]', '') as apex")
    every = named.selectExpr("crawl_id", "scheme", "host", "explode(array(named_struct('s', 'http', 'h', apex), named_struct('s', 'http', 'h', concat('www.', apex)), named_struct('s', 'https', 'h', apex), named_struct('s', 'https', 'h', concat('www.', apex)))) as v")
    return every.where("v.s <> scheme or v.h <> host").selectExpr("crawl_id", "concat(v.s, '://', v.h, '/') as url")


def sampled_external(links: DataFrame, per_host: int = 3, limit: int = 30) -> DataFrame:
    """External targets to check: up to three per host, hosts in turn.  The limits are
    the feature: a crawl asks other sites for little."""
    from pyspark.sql.window import Window

    ranked = links.select("crawl_id", "host", "target").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("crawl_id", "host").orderBy("target"))).where(F.col("rank") <= per_host)
    turn = Window.partitionBy("crawl_id").orderBy("rank", "host")
    return ranked.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit).drop("rank")


def frontier(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): what a walk over known edges (source, target) reaches from the
    seeds, breadth first, each URL at its least depth."""
    reached = seeds.select("url", F.lit(0).alias("depth")).distinct()
    edge = reached
    for level in range(1, depth + 1):
        step = edges.join(edge.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        edge = step.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        reached = reached.union(edge)
    return reached
