"""Merchant feeds: RSS with g: elements, or tab-separated with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = ("id", "link", "price", "availability", "gtin", "brand")
_REQUIRED = _FIELDS[:4]


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Raw items (all text) of an RSS feed, by Spark's XML reader."""
    schema = ", ".join(f"`{f if f == 'link' else 'g:' + f}` string" for f in _FIELDS)
    raw = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "false").schema(schema).load(path)
    return raw.select(*[F.col(f"`{f if f == 'link' else 'g:' + f}`").alias(f) for f in _FIELDS])


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw items of a tab-separated feed; a header without a required field is refused."""
    raw = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).option("quote", "").csv(path)
    named = {c.strip().lower().removeprefix("g:"): c for c in raw.columns}
    if missing := [f for f in _REQUIRED if f not in named]:
        raise ValueError(f"TSV header is missing {', '.join(missing)}")
    return raw.select(*[(F.nullif(F.trim(F.col(f"`{named[f]}`")), F.lit("")) if f in named else F.lit(None).cast("string")).alias(f) for f in _FIELDS])


_PRICE = r"^(\d+(?:\.\d+)?)\s+([A-Z]{3})$"


def checked(raw: DataFrame) -> DataFrame:
    """Raw items with ``problems`` (an array of what is wrong with each)."""
    repeated = raw.where("id is not null").groupBy("id").agg(F.count("*").alias("times")).where("times > 1").withColumnRenamed("id", "twin")
    rows = raw.join(repeated, F.col("id") == F.col("twin"), "left")
    problems = [F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f"{f} is required")) for f in _REQUIRED] + [
        F.when((F.trim("price") != "") & ~F.trim("price").rlike(_PRICE), F.concat(F.lit("price is not a number and a currency: "), "price")),
        F.when((F.trim("link") != "") & ~F.col("link").rlike("(?i)^https?://[^/]"), F.lit("link is not an absolute http(s) URL")),
        F.when(F.col("times").isNotNull(), F.lit("id is repeated")),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*problems))).drop("twin", "times")


def items(raw: DataFrame) -> DataFrame:
    """Items of a feed that has no problems; any problem refuses the whole feed."""
    rows = checked(raw)
    bad = rows.where(F.size("problems") > 0).select(F.concat_ws(": ", F.coalesce("id", F.lit("?")), F.array_join("problems", ", ")).alias("p")).limit(10).collect()
    if bad:
        raise ValueError("; ".join(r.p for r in bad))
    price = F.trim("price")
    return rows.select(
        "id", "link", F.regexp_extract(price, _PRICE, 1).cast("double").alias("price"), F.regexp_extract(price, _PRICE, 2).alias("currency"),
        F.regexp_replace(F.lower(F.trim("availability")), "_", " ").alias("availability"), "gtin", "brand",
    )
