"""Near-duplicate documents: DartMinHash signatures, banding, exact comparison.

A document is the weighted set of its five-word shingles (lower-cased words; the
weight is how often a shingle stands).  Its weight axis is cut into unit cells
and the rank axis into doubling cells; every (element, weight cell, rank cell)
holds a Poisson number of darts given by hashes alone, so that documents that
share weight share darts.  Ranks are searched upwards until each of the
signature's coordinates has been hit; a coordinate keeps its earliest dart.
A document costs about k ln k darts however many words it has.

Bands of the signature give candidates.  First every document is compared exactly
with the least document of each band that it shares (weighted Jaccard >= 0.8), which
settles most of a group of near copies in time linear in its size: documents found
to be of one class need not be compared with each other.  Any two that share a band
have its hub in common; where the documents of a hub fall into several classes, those
outside the largest are then compared with all others of the hub, block by block.  Blocks are bounded by documents and by
bytes.

Nulls, ties and odd rows: a text without words is a class of its own.  Rows of
one ``doc_id`` are one document, similar to whatever one of them is similar to.
Rows without ``doc_id`` take the class of their exact copies, else null.  A text
of fewer than five words has one shingle of all of them.  A very long text is hashed
in segments and held whole in one task.  Other columns are not looked at.  An empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.graph import components
from lodestar.llm.store import kept
from lodestar.llm.streams import by_key, lean, parts
from lodestar.llm.textbytes import LOWER_WORD, Texts, chunks, hash_words, mix, run_hash, sequence_sums, shingle_starts, split, texts_of

SHINGLE = 5
BANDS, ROWS = 40, 6  # a pair of similarity 0.8 is missed with probability 5e-6
BLOCK = 1024
BLOCK_BYTES = 16 << 20  # of texts; a longer text is a block of its own
_MOST_TEXTS = 1024  # in a chunk
_FIRST_RANK = 2.0**-6


def elements(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Unit-weight elements of the texts' weighted shingle sets, sorted by text
    and name, and where each text's begin."""
    lower = texts.lowered()
    words = split(lower, LOWER_WORD)
    starts, length, owner = shingle_starts(words.first, SHINGLE)
    names = run_hash(sequence_sums(hash_words(lower, words)), starts, length)
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    copy = np.arange(len(names)) - np.repeat(heads, np.diff(np.append(heads, len(names))))
    names = np.where(copy > 0, mix(names + copy.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), names)
    return names, np.searchsorted(owner, np.arange(len(texts) + 1))


@functools.cache
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a cell of this area."""
    terms, term, total = [], math.exp(-area), 0.0
    for n in range(1, int(20 * area) + 60):
        total += term
        terms.append(min(total, 1.0))
        term *= area / n
    return np.array(terms)


def signatures(names: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash signatures (texts x k, uint64) of unit-weight elements; of a
    text without elements, all ones."""
    n = len(first) - 1
    empty = np.uint64(2**64 - 1)
    best = np.full(n * k, empty)
    owner = np.repeat(np.arange(n), np.diff(first))
    active = np.diff(first) > 0
    cell, high = 0, _FIRST_RANK
    while active.any():
        width = high if cell == 0 else high / 2
        live = active[owner]
        name, who = names[live], owner[live]
        # a wide cell is cut into strips in which Poisson counts are cheap to draw
        for strip in range(max(1, int(width / 64))):
            salt = np.uint64((cell << 32 | strip + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            own = mix(name ^ salt)
            darts = np.searchsorted(_poisson(min(width, 64.0)), (own >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
            hit = np.flatnonzero(darts)
            darts = darts[hit]
            which = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(np.repeat(own[hit], darts) + (which.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
            place = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
            slot = np.repeat(who[hit], darts) * k + place.astype(np.int64)
            free = best[slot] == empty  # what an earlier strip has hit stays
            np.minimum.at(best, slot[free], mix(dart[free]) >> np.uint64(1))  # its rank within the strip
        active &= (best.reshape(n, k) == empty).any(axis=1)
        cell, high = cell + 1, high * 2
    return best.reshape(n, k)


def _sign(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(texts_of(batch.column(1)), most=_MOST_TEXTS):
                names, first = elements(part)
                best = signatures(names, first, bands * rows).reshape(len(part), bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), best.shape[:2]).copy()
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ best[:, :, r])
                count = np.diff(first)
                has = count > 0
                prints = []
                for salt in (0x1234567, 0xABCDEF1):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(names ^ np.uint64(salt)))])
                    prints.append(pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64), mask=~has))
                flat = pa.array(np.ascontiguousarray(key).view(np.int64).reshape(-1))
                offsets = pa.array(np.arange(0, (len(part) + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *prints, pa.array(np.diff(part.offsets)), pa.ListArray.from_arrays(offsets, flat)],
                    names=["id", "p1", "p2", "bytes", "keys"],
                )

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in parts(batches, 2048):
        texts = texts_of(batch.column(1))
        packed = pa.array([squeeze.compress(texts.text(i)) for i in range(len(texts))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "packed"])


def joined(near: np.ndarray) -> np.ndarray:
    """The least index connected with each, given a symmetric matrix of links."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.where(near, label, n).min(axis=1, initial=n)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the element sets have at least this Jaccard similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = flat[order][1:] != flat[order][:-1]
    heads = np.flatnonzero(fresh)
    runs = np.diff(np.append(heads, len(flat)))
    shared = np.repeat(runs > 1, runs)
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)[shared]
    row = who[order][shared]
    common = np.zeros((n, n), dtype=np.float32)  # counts below 2**24 are exact
    total, most = int((runs > 1).sum()), max(256, (1 << 24) // n)
    for low in range(0, total, most):
        wide = min(most, total - low)
        here = (column >= low) & (column < low + wide)
        block = np.zeros((n, wide), dtype=np.float32)
        block[row[here], column[here] - low] = 1
        common += block @ block.T
    common = common.astype(np.float64)
    return (common > 0) & (common >= threshold / (1 + threshold) * (sizes[:, None] + sizes[None, :]) - 1e-9)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, packed) with the elements of the texts instead."""
    expand = zstandard.ZstdDecompressor()
    for batch in parts(batches, 512):
        texts = texts_of(pa.array([expand.decompress(p) for p in batch.column(2).to_pylist()], pa.large_binary()))
        sets: list[bytes] = []
        for _, part in chunks(texts):
            names, first = elements(part)
            sets += [names[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.large_binary())], names=["block", "id", "set"])


def _with_hub(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, id, packed) sorted by block and id in, the first of each block its
    hub; (a, b) out: the documents that are similar to their hub."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        return bool((x[at] == y).sum() >= threshold / (1 + threshold) * (len(x) + len(y)) - 1e-9) and len(y) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hub = None, 0
        own: list[np.ndarray] = []  # one but for rows that share the hub's id
        for batch in _hashed(batches):
            a: list[int] = []
            b: list[int] = []
            for key, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = np.frombuffer(data, np.uint64)
                if key != block:
                    block, hub, own = key, doc, []
                if doc == hub:
                    own += [names] if len(names) else []
                elif any(alike(x, names) for x in own):
                    a.append(doc)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _compare(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, id, packed) sorted by block in; (a, b) out, which connect the
    similar documents of each block as all their links would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, rows in by_key(_hashed(batches), "block"):
            ids = rows.column("id").to_numpy()
            if len(ids) < 2:
                continue
            label = joined(similar([np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()], threshold))
            moved = np.flatnonzero(label != np.arange(len(label)))
            a += ids[moved].tolist()
            b += ids[label[moved]].tolist()
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _blocks(n: Column, size: Column, block: int) -> Column:
    """How many blocks so many documents of so many bytes are dealt into."""
    return F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _left_open(group: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """(block, id): what has still to be compared in hubs' groups (id, hub, bytes) of several classes."""
    known = group.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    sizes = known.groupBy("hub", "class").agg(F.count("*").alias("n"))
    several = sizes.groupBy("hub").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max_by("class", F.struct("n", -F.col("class"))).alias("main"))
    # of a group of two documents, the one pair has been compared
    some = kept(known.join(several.where("classes > 1 and n > 2").select("hub", "main"), "hub").withColumn("apart", F.col("class") != F.col("main")), "open")
    sums = some.groupBy("hub").agg(
        _blocks(F.count("*"), F.sum("bytes"), block).alias("every"), _blocks(F.count_if("apart"), F.sum(F.when(F.col("apart"), F.col("bytes")).otherwise(0)), block).alias("others")
    )
    dealt = some.join(sums, "hub")

    def place(of: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")

    def in_block(i: Column, j: Column) -> Column:
        return F.xxhash64("hub", i, j).alias("block")

    alone = dealt.where("apart").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("every") - 1))).select(in_block(place("others", 1), F.col("j")), "id")
    all_ = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(in_block(F.col("i"), place("every", 2)), "id")
    return alone.union(all_).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, class_id) per row of ``docs``: the least doc_id among all that
    chains of similar documents connect with it."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = kept(plain.mapInArrow(lean(_sign(bands, rows)), "id long, p1 long, p2 long, bytes long, keys array<long>"), "signatures")
    # written, so that the join below has an exchange of its own that can be split
    first = kept(signed.where("p1 is not null and id is not null").groupBy("p1", "p2").agg(F.min("id").alias("first")), "firsts")
    # copies: every row is tied to the first with the same weighted set
    copies = kept(signed.select("id", "p1", "p2").join(first.hint("merge"), ["p1", "p2"], "left").select("id", "first"), "copies")
    lead = signed.join(copies.where("id = first").select("id").distinct(), "id").select("id", "bytes", F.explode("keys").alias("key"))
    hubs = lead.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    met = kept(lead.join(hubs, "key").where("id > hub").groupBy("id", "hub").agg(F.max("bytes").alias("bytes")), "met")
    texts = plain.where("id is not null").mapInArrow(lean(_squeezed), "id long, packed binary")

    def compared(blocks: DataFrame, by: Callable) -> DataFrame:
        # a text is joined alike at any size of the blocks' table
        placed = texts.join(blocks.hint("merge"), "id").select("block", "id", "packed")
        return placed.repartition("block").sortWithinPartitions("block", "id").mapInArrow(lean(by(threshold)), "a long, b long")

    parts_of = met.groupBy("hub").agg(_blocks(F.count("*"), F.sum("bytes"), block).alias("parts"))
    spokes = met.join(parts_of, "hub").select(F.concat_ws(":", "hub", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id")
    middles = parts_of.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.concat_ws(":", "hub", "part").alias("block"), F.col("hub").alias("id"))
    near = kept(components(compared(spokes.union(middles), _with_hub), "a", "b"), "near")
    # any two that share a band have its hub in common
    own = lead.select("id", "bytes").join(parts_of.select(F.col("hub").alias("id")), "id", "left_semi").groupBy("id").agg(F.max("bytes").alias("bytes"))
    group = kept(met.unionByName(own.withColumn("hub", F.col("id"))), "groups")
    links = near.union(compared(_left_open(group, near, block), _compare))
    ties = links.union(copies.where("first is not null and id <> first").select("id", "first"))
    classes = components(ties.toDF("a", "b"), "a", "b")
    named = F.coalesce("component", "first", "id")
    return (
        copies.join(classes.withColumnRenamed("id", "node"), F.coalesce("first", "id") == F.col("node"), "left")
        .select(F.col("id").alias("doc_id"), named.alias("class_id"))
    )
