"""Access logs in the combined format, without addresses, users, referrers or queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a log line is words: in brackets, in quotes (with escapes), or up to the next blank
_WORDS = r'\[[^\]]*\]|"(?:\\.|[^"\\])*"|\S+'
_AT, _REQUEST, _STATUS, _BYTES, _AGENT = 3, 4, 5, 6, 8
_SIZES = (_BYTES + 1, _AGENT + 1)  # common and combined format


def _inner(word: Column) -> Column:
    return word.substr(F.lit(2), F.length(word) - 2)


def parsed(line: Column) -> Column:
    """A struct (at, method, path, status, user_agent, parameterised); null if the
    line is not of the common or combined format.  The line is cut into words once."""

    def hit(words: Column) -> Column:
        request = F.split(_inner(F.get(words, F.lit(_REQUEST))), " ")
        target = F.get(request, F.lit(1))
        at = F.try_to_timestamp(F.initcap(_inner(F.get(words, F.lit(_AT)))), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
        shown = F.substring_index(target, "#", 1)
        place = F.substring_index(shown, "?", 1)
        beyond = F.substring_index(place, "://", -1)  # of a target with its host
        slash = F.locate("/", beyond)
        path = F.when(~place.contains("://") | place.startswith("/"), place).when(slash > 0, F.substr(beyond, slash)).otherwise("")
        agent = F.regexp_replace(_inner(F.coalesce(F.get(words, F.lit(_AGENT)), F.lit('""'))), r"\\(.)", "$1")
        kept = F.struct(
            at.alias("at"), F.get(request, F.lit(0)).alias("method"), F.when(path == "", "/").otherwise(path).alias("path"), F.get(words, F.lit(_STATUS)).cast("int").alias("status"),
            agent.alias("user_agent"), (F.length(shown) > F.length(place) + 1).alias("parameterised"),
        )
        sound = (
            F.size(words).isin(*_SIZES) & F.get(words, F.lit(_AT)).startswith("[") & F.get(words, F.lit(_REQUEST)).startswith('"') & F.get(words, F.lit(_STATUS)).rlike("^[0-9]{3}$") & F.get(words, F.lit(_BYTES)).rlike("^([0-9]+|-)$")
            & F.size(request).between(2, 3) & F.get(request, F.lit(0)).rlike("^[A-Z]+$") & (target != "") & F.coalesce(F.get(words, F.lit(_AGENT)).startswith('"'), F.lit(True))
        )
        return F.when((F.size(words) > _BYTES) & sound & at.isNotNull(), kept)

    return F.get(F.transform(F.array(F.regexp_extract_all(line, F.lit(_WORDS), F.lit(0))), hit), F.lit(0))


def read_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Hits of a table (or stream) of log lines; lines that don't parse have ``hit`` null
    and blank ones are left out."""
    return lines.where(F.trim(column) != "").select(parsed(F.col(column)).alias("hit"))


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark.read.text(path))


def hits(parsed_lines: DataFrame) -> DataFrame:
    return parsed_lines.where("hit is not null").select("hit.*")


def skipped(parsed_lines: DataFrame) -> int:
    return parsed_lines.where("hit is null").count()


def crawler_rates(rows: DataFrame) -> DataFrame:
    """Per day: crawler hits, server errors and hits with parameters."""
    return rows.where("rlike(user_agent, '(?i)googlebot|bingbot')").groupBy(F.to_date("at").alias("day")).agg(
        F.count("*").alias("hits"), F.count_if(F.col("status").between(500, 599)).alias("errors"), F.count_if("parameterised").alias("parameterised")
    )
