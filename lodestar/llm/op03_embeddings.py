"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors are scaled to unit length and rounded to 8 bits with a scale of their
own.  Vectors of equal bytes are one class with a multiplicity.  Classes are
dealt into blocks by the nearest of some reference vectors.  Every pair of blocks is
a tile, but for those that no link can lie in: angles are a metric, so that vectors
whose angles to one reference differ by more than the threshold's angle are further
apart than it.  In a tile the product of the codes (whole numbers; exact in float32 up
to 1024 dimensions, beyond that summed in slices) gives every cosine up to a proven error:
with x = s q + e, |e_i| <= s / 2, and y = t p + f likewise,
|x.y - s t q.p| <= |e| |y| + s |q| |f|, norms taken per vector.  Pairs below the
threshold by more than that are out, all others are computed again in double
precision.  A tile gives counts per vector and edges that connect what its
links connect, never the links themselves.

Vectors that are null, zero, or hold null or non-finite components, and rows
without ``vec_id``, link with nothing.  Vectors of different lengths never link.
Rows of one ``vec_id`` are one node of the graph, each with its own links (a
row counts links to rows other than itself).  A very long vector is held whole in a
task, with the others of its tile.  Extra columns are not looked at.  An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.graph import components
from lodestar.llm.op05_minhash import joined
from lodestar.llm.store import kept
from lodestar.llm.streams import by_key, parts

BLOCK = 8192
SUB = 1024  # a tile is worked through in squares of this side
SLICE = 1024  # dimensions whose products of codes are exact in float32: 127**2 * 1024 < 2**24
REFERENCES = 256  # at most; as many as blocks are needed


def _as_bytes(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vector) to (id, bytes); unusable vectors give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * len(lists)
            for i, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
                x = values[end - size : end]
                if size and np.isfinite(x).all() and x.any():
                    out[i] = (x + 0.0).astype(kind).tobytes()  # with one zero only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return run


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for huge and tiny components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (float32 holding whole numbers up to 127), scale, norm of the coded
    part and norm of the rounding error, of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    coded = scale * np.sqrt((codes * codes).sum(axis=1))
    rest = x - scale[:, None] * codes
    return codes.astype(np.float32), scale, coded, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-15


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row cosines in double precision."""
    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    if p.shape[1] <= SLICE:
        return p @ q.T
    return sum((p[:, at : at + SLICE] @ q[:, at : at + SLICE].T).astype(np.float64) for at in range(0, p.shape[1], SLICE))


def tile(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` whose cosine is at least ``threshold``, part
    by part; with ``same`` only those above the diagonal."""
    qa, sa, ca, ea = quantised(unit_rows(a))
    qb, sb, _, eb = (qa, sa, ca, ea) if same else quantised(unit_rows(b))
    for i in range(0, len(a), SUB):
        for j in range(i if same else 0, len(b), SUB):
            product = _product(qa[i : i + SUB], qb[j : j + SUB])
            # |e| |y| with |y| = 1, plus |s q| |f|
            slack = ea[i : i + SUB, None] + ca[i : i + SUB, None] * eb[None, j : j + SUB] + 1e-12
            maybe = product >= ((threshold - slack) / (sa[i : i + SUB, None] * sb[None, j : j + SUB])).astype(np.float32) * np.float32(1 - 1e-6) - 1
            left, right = np.nonzero(maybe)
            left, right = left + i, right + j
            if same:
                up = left < right
                left, right = left[up], right[up]
            for at in range(0, len(left), 1 << 16):
                u, v = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                sure = cosines(a[u], b[v]) >= threshold
                yield u[sure], v[sure]


class Forest:
    """Union-find over 0..n-1 that reports which links joined something new."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            if not len(u):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while True:
                deeper = self.label[self.label]
                if (deeper == self.label).all():
                    break
                self.label = deeper


def _tiles(threshold: float, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tile, diagonal, side, id, copies, vec) sorted by tile in; per vector
    of the tile its links there, and the least vector the tile connects it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "tile"):
            lengths = pc.binary_length(rows.column("vec"))
            for length in pc.unique(lengths).to_pylist():  # vectors of one length only can meet
                yield from one(rows.filter(pc.equal(lengths, length)).combine_chunks(), length)

    def one(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
        side = rows.column("side").to_numpy()
        ids = rows.column("id").to_numpy()
        copies = rows.column("copies").to_numpy()
        vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        same = bool(rows.column("diagonal")[0].as_py())
        order = np.lexsort((ids, side))
        left = order[side[order] == 0]
        right = left if same else order[side[order] == 1]
        if not len(left) or not len(right):
            return
        links = np.zeros(len(ids), dtype=np.int64)
        forest = Forest(len(ids))
        for u, v in tile(vec[left], vec[right], same, threshold):
            u, v = left[u], right[v]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            forest.add(u, v)
        linked = np.flatnonzero(links)
        if len(linked):
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, forest.label[linked], ids[linked])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[linked]), pa.array(links[linked]), pa.array(least[forest.label[linked]])], names=["id", "links", "least"]
            )

    return run


def _near_references(references: list[bytes], kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, copies, vec) with each vector's angles to the references (0 where their
    lengths differ, which says nothing) and the nearest of them."""
    known: dict[int, tuple[list[int], np.ndarray]] = {}
    for number, data in enumerate(references):
        known.setdefault(len(data), ([], []))[0].append(number)
    units = {size: (which, unit_rows(np.stack([np.frombuffer(references[i], kind).astype(np.float64) for i in which]))) for size, (which, _) in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            lengths = pc.binary_length(batch.column(2)).to_numpy()
            angles, nearest = np.zeros((len(lengths), len(references))), np.full(len(lengths), -1, np.int32)
            vectors = batch.column(2).to_pylist()
            for size in np.unique(lengths):
                if int(size) in units:
                    which, unit = units[int(size)]
                    rows = np.flatnonzero(lengths == size)
                    x = unit_rows(np.stack([np.frombuffer(vectors[i], kind).astype(np.float64) for i in rows]))
                    found = np.arccos(np.clip(x @ unit.T, -1, 1))
                    angles[np.ix_(rows, which)] = found
                    nearest[rows] = np.array(which)[found.argmin(axis=1)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * len(references), pa.int32()), pa.array(angles.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), flat], names=["id", "copies", "vec", "nearest", "angles"])

    return run


def in_blocks(classes: DataFrame, block: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Classes with the number of their block; and blocks with the range of their
    vectors' angles to every reference."""
    count = max(1, min(REFERENCES, -(-classes.count() // block)))
    references = [bytes(r.vec) for r in classes.orderBy(F.xxhash64("vec"), "id").limit(count).select("vec").collect()]
    fields = "id long, copies long, vec binary, nearest int, angles array<double>"
    near = kept(classes.select("id", "copies", "vec").mapInArrow(_near_references(references, kind), fields), "vectors-placed")
    many = near.groupBy("nearest").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # one small row per reference
    first = many.withColumn("first", F.sum("parts").over(Window.orderBy("nearest")) - F.col("parts"))
    placed = near.join(F.broadcast(first), "nearest").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("parts"))).cast("long"))
    ends = [f(F.get("angles", F.lit(i))) for f in (F.min, F.max) for i in range(len(references))]
    summed = placed.groupBy("block").agg(F.array(*ends[: len(references)]).alias("low"), F.array(*ends[len(references) :]).alias("high"))
    return placed.drop("angles", "first", "parts"), kept(summed, "blocks")


def tiles_of(blocks: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i <= j: pairs of blocks that a link may lie in."""
    most = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    every = blocks.withColumn("j", F.explode(F.sequence(F.col("block"), F.lit(blocks.agg(F.max("block")).first()[0] or 0))))
    other = blocks.select(F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_j", "high_j"), lambda a, b: F.greatest(a["low"] - b["high_j"], b["low_j"] - a["high"]))
    return every.join(other, "j").where(F.coalesce(F.array_max(gaps), F.lit(0.0)) <= most).select(F.col("block").alias("i"), "j")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) per row of ``vectors``."""
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = kept(plain.mapInArrow(_as_bytes(kind), "id long, vec binary"), "vectors")
    usable = rows.where("vec is not null and id is not null")
    classes = kept(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    placed, blocks = in_blocks(classes, block, kind)
    pairs = kept(tiles_of(blocks, threshold).withColumn("tile", F.concat_ws(":", "i", "j")).withColumn("diagonal", F.col("i") == F.col("j")), "tiles-kept")
    sides = pairs.select("tile", "diagonal", F.lit(0).alias("side"), F.col("i").alias("block")).union(pairs.where("not diagonal").select("tile", "diagonal", F.lit(1), "j"))
    in_tiles = placed.join(sides.hint("merge"), "block").select("tile", "diagonal", "side", "id", "copies", "vec")
    found = kept(in_tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(threshold, kind), "id long, links long, least long"), "tiles")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "id", "left").select("vec", F.col("id").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = kept(rows.join(by_class, "vec", "left").select("id", "first", "n_links"), "vector-links")
    ties = found.select("id", F.col("least").alias("other")).union(each.where("first is not null and id <> first").select("id", "first"))
    graph = components(ties, "id", "other").withColumnRenamed("id", "node")
    return each.join(graph, each.id == F.col("node"), "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
