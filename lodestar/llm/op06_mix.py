"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, documents in a fixed order; the stream is
packed into blocks of ``block`` words.  Sources weigh 5, 2, 1, repeating, in the
order of their names; targets share all words by weight, and a source whose share
exceeds three times its size stops there, the excess going to the others.

The mix is a number of output shards of ``shard_slots`` slots, each slot one block.
Every shard's source counts are a multinomial draw by the sources' quotas.  Over
all shards a source's draws miss its quota by about the root of it; that many of
its slots, evenly spaced, are handed over between sources, so that targets are met
and no block is taken more than three times.  The r-th slot of a source is block
``permute(r mod n)`` of its n, under a permutation of its own for each turn
``r div n``.  Blocks meet slots by index, and what a document gives to the mix is
counted from that table (``mixture`` returns it with the words).

Documents' places in the stream come from sums in two steps: within a small hash
bucket of a source, and over the buckets' totals, so that a source that holds
most rows is never in one task; slots' ranks likewise, by runs of shards.  Only
tables of one small row per source (targets, quotas) are summed in one task.

Nulls, ties and odd rows: a null text has size 0, takes nothing and counts for
nothing; a null source is a source, the last by name.  Rows of one doc_id each have
their own place; rows alike in id and text share what they take in either order.
A very long text is many pieces, none longer than a block.  Extra columns are not
looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.store import kept

BLOCK = 64
WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source or a block is taken
SHARD_SLOTS = 4096
SLOTS_AT_ONCE = 8192
CELLS = 4096  # at least, by which numbers meet ranges; and the most sources whose cells are broadcast
ROUNDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def permute(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not rounds), chosen by ``seed``."""

    def swap(at: Column, turn: Column) -> Column:
        other = F.pmod(F.xxhash64(turn, F.lit(1), *seed) - at, n)
        side = F.xxhash64(turn, F.lit(2), F.greatest(at, other), *seed)
        return F.when(side.bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source, source_size, target) per source, of (key, source, size) rows."""
    by_source = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    rising = Window.orderBy(cap / F.col("weight"), "rank")
    before = F.coalesce(F.sum(cap).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = by_source.withColumn("rank", rank).withColumn("weight", weight).withColumn("left", total - before).withColumn("over", rest)
    # a source is full if its cap is no more than its share of what is left by those before it
    full = F.col("source_size") * most * F.col("over") <= F.col("left") * F.col("weight")
    free = F.min(F.when(~full, F.struct((F.col("source_size") * most / F.col("weight")).alias("at"), "rank", "left", "over"))).over(Window.partitionBy())
    share = F.col("free.left") * F.col("weight") / F.col("free.over")
    target = F.when(full | F.col("free").isNull(), cap.cast("double")).otherwise(share.cast("double"))
    return level.withColumn("free", free).select("key", "source", "source_size", target.alias("target"))


def source_key(source: Column) -> Column:
    """The source, or a value of its own for null, that joins can be on."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def plan(sizes: DataFrame, block: int) -> DataFrame:
    """Targets with each source's blocks, its quota of slots, and the slots before it."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    # slots hold a source's mean block, so that a short last block changes nothing
    slots = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * blocks / F.col("source_size") + 0.5), blocks * MOST)).otherwise(0)
    counted = targets(sizes).withColumn("blocks", blocks).withColumn("slots", slots.cast("long"))
    return counted.withColumn("begin", F.sum("slots").over(Window.orderBy("key")) - F.col("slots"))


def _within(number: Column, ranges: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """``rows`` joined to the one of ``ranges`` (begin, slots) that holds ``number``.

    The numbers 0..total-1 are cut into cells and both sides meet by cell.  The
    cells' table has as many rows as cells and ranges; it is broadcast only where
    that is small, else the join is by a shuffle."""
    some = ranges.where("slots > 0")
    count = some.count()
    wide = max(1, -(-total // max(CELLS, 2 * count)))
    cells = some.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / wide), F.floor((F.col("begin") + F.col("slots") - 1) / wide))))
    cells = F.broadcast(cells) if count <= CELLS else cells.hint("merge")
    met = rows.withColumn("number", number).withColumn("cell", F.floor(F.col("number") / wide)).join(cells, "cell")
    return met.where("number >= begin and number < begin + slots").drop("cell")


def _running(counts: DataFrame, of: str, shards: int) -> DataFrame:
    """``counts`` (key, shard, ...) with the sum of column ``of`` over the key's earlier shards,
    within runs of shards and over the runs' totals, so that no window is long."""
    run = max(1, math.isqrt(shards))
    dealt = counts.withColumn("run", F.floor(F.col("shard") / run))
    totals = dealt.groupBy("key", "run").agg(F.sum(of).alias("held"))
    base = totals.select("key", "run", (F.sum("held").over(Window.partitionBy("key").orderBy("run")) - F.col("held")).alias("base"))
    here = F.sum(of).over(Window.partitionBy("key", "run").orderBy("shard")) - F.col(of)
    return dealt.withColumn("here", here).join(base.hint("merge"), ["key", "run"]).withColumn("before", F.col("base") + F.col("here")).drop("run", "base", "here")


def shard_counts(planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, key, n): how many of a shard's slots each source gets, a multinomial
    draw per shard: every slot draws its source by the sources' quotas."""
    spark = planned.sparkSession
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = -(-total // shard_slots)
    parts = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 64)))
    each = spark.range(0, shards, 1, parts).select(
        F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), total - F.col("id") * shard_slots) - 1)).alias("slot")
    )
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit(3), F.col("shard"), F.col("slot")), F.lit(max(1, total)))
    drawn = _within(number, planned.select("key", "begin", "slots"), each, total)
    return drawn.groupBy("shard", "key").agg(F.count("*").alias("n"))


def draw(planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, slot, key, turn, block): the blocks that every output shard takes."""
    spark = planned.sparkSession
    counts = kept(shard_counts(planned, shard_slots, seed), "shard-counts")
    shards = counts.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    drawn = counts.groupBy("key").agg(F.sum("n").alias("drawn"))
    settled = planned.select("key", "blocks", "slots").join(drawn, "key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    over = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))
    first = F.sum(over).over(Window.orderBy("key")) - over
    settled = kept(settled.withColumn("over", over).withColumn("over_first", first), "settled")
    moved = settled.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]

    placed = _running(counts, "n", shards).withColumn("low", F.sum("n").over(Window.partitionBy("shard").orderBy("key")) - F.col("n"))
    placed = placed.join(settled.hint("merge"), "key").withColumn("size", F.sum("n").over(Window.partitionBy("shard")))
    # few rows that become many: dealt out by shard and source first, a large count in parts
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS_AT_ONCE)))
    dealt = kept(placed, "counts-placed").withColumn("part", part).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "key", "part")
    i = F.explode(F.sequence(F.col("part") * SLOTS_AT_ONCE, F.least((F.col("part") + 1) * SLOTS_AT_ONCE, F.col("n")) - 1))
    each = dealt.withColumn("i", i).withColumn("j", F.col("before") + F.col("i"))
    # of a source's drawn slots, those beyond its quota stand evenly spaced
    gone, gone_next = F.expr("j * over div drawn"), F.expr("(j + 1) * over div drawn")
    slot = permute(F.col("low") + F.col("i"), F.col("size"), F.lit(seed), F.col("shard"))
    each = each.select("shard", slot.alias("slot"), "key", "blocks", "j", gone.alias("gone"), (gone_next > gone).alias("moves"), "over_first")
    stay = each.where("not moves").select("shard", "slot", "key", "blocks", (F.col("j") - F.col("gone")).alias("rank"))
    # they go, in a pseudorandom order, to the sources that drew too few
    short = settled.withColumn("lacks", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
    short = short.select("key", "blocks", "drawn", F.col("lacks").alias("slots"), (F.sum("lacks").over(Window.orderBy("key")) - F.col("lacks")).alias("begin"))
    number = permute(F.col("over_first") + F.col("gone"), F.lit(max(1, moved)).cast("long"), F.lit(seed), F.lit(5))
    goes = _within(number, short, each.where("moves").select("shard", "slot", "over_first", "gone"), moved)
    goes = goes.select("shard", "slot", "key", "blocks", (F.col("drawn") + F.col("number") - F.col("begin")).alias("rank"))
    turn = F.floor(F.col("rank") / F.col("blocks"))
    block = permute(F.col("rank") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("key"), turn)
    return stay.unionByName(goes).select("shard", "slot", "key", turn.alias("turn"), block.alias("block"))


def _placed(docs: DataFrame, block: int, seed: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with ``at``, where their words begin in their source's stream; and the plan."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    given = docs.select(F.col("doc_id").alias("doc_id"), source.alias("source"), source_key(source).alias("key"), size.alias("size"), F.xxhash64(text).alias("said"), *([text.alias("text")] if with_text else []))
    sizes = kept(given, "sizes")
    # as many buckets as rows in each, so that neither step has a large part
    buckets = max(1, math.isqrt(sizes.count()))
    planned = kept(plan(sizes, block), "sources")
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "said", F.lit(seed)), F.lit(buckets)))
    totals = dealt.groupBy("key", "bucket").agg(F.sum("size").alias("held"))
    base = F.sum("held").over(Window.partitionBy("key").orderBy("bucket")) - F.col("held")
    bases = totals.withColumn("base", base).join(planned.select("key", "source_size", "target"), "key").drop("held")
    within = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "said").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = dealt.join(bases, ["key", "bucket"]).withColumn("at", at).drop("bucket", "base", "said")
    return kept(placed, "placed"), planned


def _mixture(placed: DataFrame, planned: DataFrame, block: int, shard_slots: int, seed: int, with_text: bool) -> DataFrame:
    draws = draw(planned, shard_slots, seed)
    begins, ends = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)

    def piece(b: Column) -> Column:
        low, high = F.greatest(F.col("at"), b * block), F.least(F.col("at") + F.col("size"), (b + 1) * block)
        first = low - F.col("at")
        said = [F.array_join(F.slice("words", (first + 1).cast("int"), (high - low).cast("int")), " ").alias("text")] if with_text else []
        return F.struct(b.alias("block"), (low - b * block).alias("offset"), first.alias("first_word"), (high - low).alias("n_words"), *said)

    some = placed.where("size > 0")
    if with_text:
        some = some.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
        pieces = some.select("doc_id", "source", "key", "at", F.inline(F.transform(F.sequence(begins, ends), piece)))
    else:
        one = some.select("doc_id", "source", "key", "at", "size", F.explode(F.sequence(begins, ends)).alias("b"))
        pieces = one.select("doc_id", "source", "key", "at", piece(F.col("b")).alias("piece")).select("doc_id", "source", "key", "at", "piece.*")
    # sizes of exploded rows are underestimated, so broadcasts are ruled out
    return draws.join(pieces.hint("merge"), ["key", "block"])


def mixture(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The mix itself: every piece of a document in every slot of every output shard.

    One row per shard, slot and piece of the slot's block: source, block, turn (how
    often the block came before), doc_id, offset (of the piece in its block),
    first_word (in its document), n_words and text (the piece's words, joined by one
    space).  A slot's words are its pieces' in the order of ``offset``."""
    placed, planned = _placed(docs, block, seed, with_text=True)
    out = _mixture(placed, planned, block, shard_slots, seed, with_text=True)
    return out.select("shard", "slot", "source", "block", "turn", "doc_id", "offset", "first_word", "n_words", "text")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0, shard_slots: int = SHARD_SLOTS, with_pieces: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and taken per row of ``docs``; with
    ``with_pieces`` also where in the mix its words stand (shard, slot, offset,
    first_word, n_words; at most 3 for each block that the document touches)."""
    placed, planned = _placed(docs, block, seed, with_text=False)
    found = _mixture(placed, planned, block, shard_slots, seed, with_text=False)
    taken = [F.sum("n_words").alias("taken")]
    if with_pieces:
        taken.append(F.sort_array(F.collect_list(F.struct("shard", "slot", "offset", "first_word", "n_words"))).alias("pieces"))
    sized = placed.join(found.groupBy("key", "at").agg(*taken).withColumn("some", F.lit(True)).hint("merge"), ["key", "at"], "left")
    # rows without words share a place with the row after them
    mine = (F.col("size") > 0) & F.col("some")
    amount = F.when(mine, F.col("taken")).otherwise(0)
    pieces = [F.when(mine, F.col("pieces")).alias("pieces")] if with_pieces else []
    return sized.select("doc_id", "source", "size", "source_size", "target", amount.cast("long").alias("taken"), *pieces)
