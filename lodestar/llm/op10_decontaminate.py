"""Benchmark decontamination, with DataFrame functions only.

A window of a document is similar to an item (weighted Jaccard similarity of their
shingles of five lower-cased words, weight: how often one stands) only if at least
that share of the item's shingles stand in it.  Documents' shingles therefore first
meet the items' own, as rows of hashes and places only; where enough of them stand
within an item's size, every window of that size there is looked at, wherever the
item's words stand in it.  (This loses no pair: it is a bound, not an index.)

Distinct windows are fingerprinted by SimHash and looked up in a multi-index of the
items' fingerprints: 64 bits are cut into ``BLOCKS`` blocks, and any two that are
within ``RADIUS`` = ``BLOCKS`` - 2 bits agree on two blocks at least, so that a join
on (size, pair of blocks, their bits) finds all of them.  Windows of similarity 0.8
are 9.7 bits apart on average, and those further apart than the radius mostly agree
on two blocks too, as bits that differ share blocks; of unrelated pairs about one in
25 does.  What is found is compared exactly.

Nulls, ties and odd rows: null texts have no words; an item of fewer than five
words has one shingle of all its words, and is met with windows of as many; an
item without words meets nothing.  A window that would leave the document begins
or ends where it does.  Rows of one doc_id (or item_id; null is one too) are one, with
the best of their windows; of equally similar ones, the first.  A very long text is
one row of word hashes in a task.  Extra columns are not looked at.  Empty tables
give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import kept

SHINGLE = 5
BLOCKS = 12
RADIUS = BLOCKS - 2  # any two fingerprints within it agree on two blocks
THRESHOLD = 0.8
MOST_BROADCAST = 1_000_000  # rows of two or three numbers; more are joined by a shuffle
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Hashes of the lower-cased words."""
    said = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    return F.transform(said, lambda w: F.xxhash64(w))


def shingles(of: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` of the words; none if there are fewer."""
    starts = F.sequence(F.lit(0), F.size(of) - width)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(width)]))
    return F.when(F.size(of) >= width, runs).otherwise(F.array().cast("array<long>"))


def simhash(of: Column) -> Column:
    """64 bits, each by the majority of the shingles' bits."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(of, F.lit(0), lambda total, h: total + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda print_, b: print_.bitwiseOR(bit(b)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""

    def times(x: Column, of: Column) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, x: total + F.least(times(x, a), times(x, b)))
    return F.when(a == b, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def block_pairs(print_: Column) -> Column:
    """(number, value) of each pair of blocks of bits of a fingerprint."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    value = [F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in itertools.pairwise(edges)]
    pairs = itertools.combinations(range(BLOCKS), 2)
    return F.array(*[F.struct(F.lit(i).alias("number"), (value[a] * 64 + value[b]).alias("value")) for i, (a, b) in enumerate(pairs)])


def _sized(df: DataFrame) -> DataFrame:
    """``df``, broadcast only if it has few rows, else to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df.hint("merge")


def _hits(texts: DataFrame, own: DataFrame, widths: list[int]) -> DataFrame:
    """(a, b, doc_id, n, width, at): where an item of n words and a document share a shingle."""
    most = max(widths)
    runs = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(most)])
    each = texts.select("a", "b", "doc_id", F.posexplode(runs).alias("at", "run"))
    run = [F.col(f"run.w{k}") for k in range(most)]
    of_width = [F.struct(F.lit(w).alias("width"), F.when(run[w - 1].isNotNull(), F.xxhash64(*run[:w])).alias("shingle")) for w in widths]
    if len(widths) == 1:
        each = each.select("a", "b", "doc_id", "at", of_width[0].alias("one")).select("a", "b", "doc_id", "at", "one.*")
    else:
        each = each.select("a", "b", "doc_id", "at", F.inline(F.array(*of_width)))
    return each.where("shingle is not null").join(_sized(own), ["width", "shingle"]).select("a", "b", "doc_id", "n", "width", "at")


def _starts(hits: DataFrame, threshold: float) -> DataFrame:
    """(a, b, doc_id, n, width, start) of every window that holds as many shared
    shingles as a similar one must."""
    held = hits.groupBy("a", "b", "n", "width").agg(F.any_value("doc_id").alias("doc_id"), F.sort_array(F.collect_list("at")).alias("at"))
    held = held.withColumn("reach", F.col("n") - F.col("width"))
    held = held.withColumn("need", F.ceil((F.col("reach") + 1) * threshold - 1e-9).cast("int"))
    # the last shared shingle of such a window has the need-th before it within reach
    ends = F.filter("at", lambda p, i: (i + 1 >= F.col("need")) & (F.get("at", F.greatest(i - F.col("need") + 1, F.lit(0))) >= p - F.col("reach")))
    held = held.withColumn("ends", ends).where(F.size("ends") > 0)
    after = F.transform("ends", lambda p, i: F.greatest(p - F.col("reach"), F.coalesce(F.get("ends", i - 1) + 1, p - F.col("reach"))))
    runs = F.transform("ends", lambda p, i: F.sequence(F.get("after", i), p))
    return held.withColumn("after", after).select("a", "b", "doc_id", "n", "width", F.explode(F.flatten(runs)).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity) of every document
    and item of which a window is similar."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    items = items.withColumn("width", F.least("n", F.lit(SHINGLE))).withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), "words"))
    items = kept(items, "items")
    # at most five widths: that of all items but those of fewer words
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]
    if not widths:
        none = docs.sparkSession.createDataFrame([], "first_word int, n_words int, hamming int, similarity double")
        return docs.select("doc_id").limit(0).join(benchmark.select("item_id").limit(0)).join(none)

    def shingled(df: DataFrame, column: str) -> DataFrame:
        sized = F.when(F.col("width") == widths[-1], shingles(F.col(column), widths[-1]))
        for width in widths[:-1]:
            sized = sized.when(F.col("width") == width, shingles(F.col(column), width))
        return df.withColumn("set", sized)

    # rows that share a doc_id, or have none, are told apart by their texts
    print_of = [F.xxhash64(F.lit(salt), "doc_id", F.col("doc_id").isNull(), "text").alias(name) for salt, name in enumerate("ab")]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", *print_of)
    known = kept(shingled(items, "words").select("item_id", "item", "n", "width", "set").withColumn("print", simhash(F.col("set"))), "item-prints")
    own = known.select("n", "width", F.explode("set").alias("shingle")).distinct()
    hits = _hits(texts.select("a", "b", "doc_id", words(F.col("text")).alias("words")), own, widths)
    starts = kept(_starts(hits, threshold), "window-starts")

    some = starts.select("a", "b").distinct()
    held = texts.join(_sized(some), ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("a", "b", words(F.col("text")).alias("words"))
    first = F.greatest(F.col("start"), F.lit(0))
    under = F.slice("words", first + 1, F.col("start") + F.col("n") - first)
    each = starts.join(held.hint("merge"), ["a", "b"]).select("doc_id", "n", "width", first.alias("first_word"), under.alias("window"))
    content = F.struct("n", F.xxhash64("window").alias("a"), F.xxhash64(F.lit(1), F.col("window")).alias("b"))
    windows = kept(each.where(F.size("window") >= F.col("width")).withColumn("content", content).drop("n"), "windows")
    distinct = windows.groupBy("content").agg(F.any_value("window").alias("window"), F.any_value("width").alias("width"))
    seen = kept(shingled(distinct, "window").select("content", "set").withColumn("print", simhash(F.col("set"))), "prints")

    ours = seen.select("content", "print", F.inline(block_pairs(F.col("print")))).withColumn("n", F.col("content.n"))
    theirs = known.select("item", F.col("n"), F.col("print").alias("item_print"), F.inline(block_pairs(F.col("print")))).distinct()
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("hamming")
    close = ours.join(_sized(theirs), ["n", "number", "value"]).select("content", "item", hamming).distinct()
    sets = known.select("item", "item_id", F.col("set").alias("item_set")).dropDuplicates(["item"])
    checked = (
        close.join(seen.select("content", "set"), "content")
        .join(sets, "item")
        .withColumn("similarity", similarity(F.col("set"), F.col("item_set")))
        .where(F.col("similarity") >= threshold)
        .select("content", "item_id", "hamming", "similarity")
    )
    placed = windows.select("content", "doc_id", "first_word").join(checked, "content")
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "first_word", F.col("content.n").alias("n_words"), "hamming")).alias("best")
    return placed.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.first_word", "best.n_words", "best.hamming", (-F.col("best.less")).alias("similarity")
    )
