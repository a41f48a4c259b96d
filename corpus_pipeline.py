"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept:
toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut from texts, documents that hold benchmark items go, and the rest
is mixed to target weights.  All but the last return the columns of documents.

Rows without doc_id are judged by their texts, those alike as one document that comes
after all others.  Of rows that share a doc_id, near-dedup keeps one, the least by its
columns.  A null text is kept as a text without words; a text all of whose words are
repeated stays as an empty text.  Very long texts are whole rows of a task in all
stages.  Extra columns, whatever they are called or hold, are carried along but by the
last stage.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from lodestar.llm.op02_toxicity import toxicity, train
from lodestar.llm.op05_minhash import near_duplicates
from lodestar.llm.op06_mix import mix
from lodestar.llm.op09_substrings import substring_dedup
from lodestar.llm.op10_decontaminate import leaks
from lodestar.llm.store import kept


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).where("predicted = 0").select("row.*")


def _key(docs: DataFrame) -> Column:
    """What a stage knows a row by: its doc_id, or a number far above usual ones that
    hangs on the text, so that rows without doc_id are judged by their texts."""
    own = F.xxhash64("text", F.lit("no id")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, MapType | VariantType)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(_key(docs).alias("key"), F.struct(*map(F.col, _columns(docs))).alias("row"))
    texts = rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    first = kept(near_duplicates(texts).where("doc_id = class_id").select(F.col("doc_id").alias("key")).distinct(), "first-of-class")
    # the same join at any size: texts are dealt by key
    stay = rows.join(first.hint("merge"), "key", "left_semi")
    # of rows with one key the least by its columns; those that have no order, as JSON
    order = [F.col(f"row.`{f.name}`") if _orderable(f.dataType) else F.to_json(F.struct(F.col(f"row.`{f.name}`"))) for f in docs.schema]
    return stay.groupBy("key").agg(F.min_by("row", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])).alias("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(_key(docs).alias("key"), F.struct(*map(F.col, _columns(docs))).alias("row"))
    found = leaks(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    holds = kept(found.select(F.col("doc_id").alias("key")).distinct(), "leaking")
    return rows.join(holds, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, with_pieces=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: SQL can neither learn the toxicity model nor draw the mix
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
