"""Toxicity: gradient-boosted trees over dense features of the whole text.

A lexicon is learned first: words and beginnings of words that stand much more
often in toxic than in other training texts, weighted by log odds.  Features are
densities of the learned and of a fixed lexicon, how near their words stand to
words of address, capitals, punctuation and marks of obfuscation.  Trees are
grown on features whose lexicon was learned without the row's own part of the
sample; an isotonic curve, fitted to margins of rows their trees had not seen,
turns margins into scores.

Learning takes a sample of at most ``TRAIN_ROWS`` labelled rows (those of the least
hashes), whole texts that stream by the driver: only their distinct terms and their
features are held.  Scoring reads every whole text, and needs about 30 bytes per byte
of the longest text of a task.  Neither labels nor lang, source or doc_id enter a
score (doc_id and text together only choose the sample).

Nulls and odd rows: a null text is empty; an empty text is scored by its (zero)
features.  Rows alike are learned from once.  Several labels of one doc_id count as toxic if one of them is; null
labels are ignored, and a row without doc_id is never learned from (held_out).
With fewer than ``LEAST_CLASS`` rows of either class, scores come from the fixed
lexicon alone.  Other columns are carried in ``row``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.boosting import Trees, grow, isotonic
from lodestar.llm.store import kept
from lodestar.llm.streams import give_back, lean, parts, with_row
from lodestar.llm.textbytes import CHUNK_BYTES, LOWER_WORD, Texts, byte_sums, chunks, mix, span_hash, split, texts_of
from lodestar.llm.toxic_words import INSULTS, SECOND_PERSON

TRAIN_ROWS = 6000
LEAST_CLASS = 8
TERMS = 4000
STEMS = (4, 5, 6, 8)  # bytes of a word's beginning
NEAR = 5  # words
FOLDS = 5
N_FEATURES = 19
_TABLE = 1 << 20
_LOOKS_LIKE = np.arange(256, dtype=np.uint8)
for _mark, _letter in zip(b"@$013457", b"asoieast", strict=True):
    _LOOKS_LIKE[_mark] = _letter


class Lexicon:
    """Weights by term hash; a term is a word or, salted by its length, a beginning."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.table = np.zeros(_TABLE, dtype=bool)
        self.table[(self.hashes & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def of(self, terms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(terms))
        if not len(self.hashes):
            return out
        at = np.flatnonzero(self.table[(terms & np.uint64(_TABLE - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.hashes, terms[at]), len(self.hashes) - 1)
        hit = self.hashes[found] == terms[at]
        out[at[hit]] = self.weights[found[hit]]
        return out


def _words_lexicon(words: list[str]) -> Lexicon:
    texts = texts_of(pa.array(words))
    return Lexicon(span_hash(byte_sums(texts), texts.offsets[:-1], texts.offsets[1:]), np.ones(len(words)))


def _stems(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, term hashes) of words and of each length of beginnings."""
    yield np.arange(len(starts)), span_hash(sums, starts, ends)
    for size in STEMS:
        which = np.flatnonzero(ends - starts > size)
        yield which, mix(span_hash(sums, starts[which], starts[which] + size) ^ np.uint64(size))


def _within(places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the (sorted) places lie in each range."""
    return np.searchsorted(places, ends) - np.searchsorted(places, starts)


def features(texts: Texts, learned: Lexicon) -> np.ndarray:
    """One row of dense features per text."""
    n = len(texts)
    lower = texts.lowered()
    words = split(lower, LOWER_WORD)
    sums = byte_sums(lower)
    owner, count = words.owner(), words.counts()
    size = np.diff(texts.offsets)
    per_word, per_byte = 1 / np.maximum(count, 1), 1 / np.maximum(size, 1)

    def by_text(weights: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights, n)

    weight = np.zeros(len(owner))
    plain = np.empty(0, np.uint64)
    for which, terms in _stems(sums, words.starts, words.ends):
        if len(which) == len(owner) and not len(plain):
            plain = terms
        weight[which] = np.maximum(weight[which], learned.of(terms))
    fixed = _FIXED.of(plain) > 0
    hit = (weight > 0) | fixed
    hits = np.flatnonzero(hit)

    address = np.flatnonzero(_ADDRESS.of(plain) > 0)
    near = np.zeros(len(hits))
    if len(address) and len(hits):
        after = np.searchsorted(address, hits)
        for side in (np.maximum(after - 1, 0), np.minimum(after, len(address) - 1)):
            other = address[side]
            near = np.maximum(near, (np.abs(other - hits) <= NEAR) & (owner[other] == owner[hits]))
    top = np.zeros(n)
    np.maximum.at(top, owner[hits], weight[hits])

    # the same words once marks are read as the letters that they look like
    alike = Texts(_LOOKS_LIKE[lower.data], texts.offsets)
    changed = np.flatnonzero(alike.data != lower.data)
    seen = split(alike, LOWER_WORD)
    marks = _within(changed, seen.starts, seen.ends)
    odd = np.flatnonzero(marks)
    hidden = np.zeros(n)
    mixed = np.zeros(n)
    if len(odd):
        who = seen.owner()[odd]
        letters = seen.ends[odd] - seen.starts[odd] - marks[odd]
        mixed = np.bincount(who, letters > 1, n)
        name = span_hash(byte_sums(alike), seen.starts[odd], seen.ends[odd])
        hidden = np.bincount(who, np.maximum(_FIXED.of(name) > 0, learned.of(name) > 0), n)

    raw = texts.data

    def rate(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), texts.offsets)) * per_byte

    capital = (raw >= 0x41) & (raw <= 0x5A)
    loud = (_within(np.flatnonzero(capital), words.starts, words.ends) == words.ends - words.starts) & (words.ends - words.starts >= 3)
    again = np.zeros(len(raw), dtype=bool)
    if len(raw) > 2:
        again[2:] = (lower.data[2:] == lower.data[1:-1]) & (lower.data[1:-1] == lower.data[:-2]) & LOWER_WORD[lower.data[2:]]
    return np.stack(
        [
            by_text(weight) * per_word,
            by_text(weight > 0) * per_word,
            by_text(weight > 0),
            top,
            by_text(fixed) * per_word,
            by_text(fixed),
            np.bincount(owner[hits], near, n),
            np.bincount(owner[hits], near, n) / np.maximum(np.bincount(owner[hits], minlength=n), 1),
            rate(capital),
            by_text(loud) * per_word,
            rate(raw == 0x21),
            rate(raw == 0x3F),
            rate(np.isin(raw, np.frombuffer(b"#$%&*@^~", np.uint8))),
            rate((raw >= 0x30) & (raw <= 0x39)),
            rate(again),
            mixed * per_word,
            hidden,
            np.log1p(count),
            (size * per_word).clip(0, 50),
        ],
        axis=1,
    )


_FIXED = _words_lexicon(INSULTS)
_ADDRESS = _words_lexicon(SECOND_PERSON)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, texts: Texts) -> np.ndarray:
        x = features(texts, self.lexicon)
        if self.trees is None or self.knots is None:
            return 1 - np.exp(-40 * x[:, 4])
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def _term_rows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs, and for each text the least of its words'
    hashes, which texts that are mostly alike share."""
    whose, which, least = [], [], []
    for at, part in chunks(texts):
        lower = part.lowered()
        words = split(lower, LOWER_WORD)
        sums = byte_sums(lower)
        owner = words.owner()
        low = np.full(len(part), np.uint64(2**64 - 1))
        for number, (index, terms) in enumerate(_stems(sums, words.starts, words.ends)):
            if not number:
                np.minimum.at(low, owner, mix(terms))
            text, term = _distinct(owner[index], terms)
            whose.append(text + at)
            which.append(term)
        least.append(low)
    return np.concatenate(whose), np.concatenate(which), np.concatenate(least)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted by ``b``."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def _learned(names: np.ndarray, index: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int) -> Lexicon:
    """Terms that mark toxic groups; ``index`` and ``toxic``: of each distinct
    pair of group and term, the term and whether the group is toxic."""
    n_toxic, n_clean = max(n_toxic, 1), max(n_clean, 1)
    a = np.bincount(index[toxic], minlength=len(names))
    b = np.bincount(index[~toxic], minlength=len(names))
    share = (a + b) / (n_toxic + n_clean)
    z = (a / n_toxic - b / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    odds = np.log((a + 0.2) / n_toxic) - np.log((b + 0.2) / n_clean)
    good = np.flatnonzero((a >= 3) & (z >= 4) & (odds >= 2))
    good = good[np.lexsort((names[good], -z[good]))][:TERMS]
    return Lexicon(names[good], np.minimum(odds[good], 6.0))


def _some(texts: Texts, which: np.ndarray) -> Texts:
    sizes = np.diff(texts.offsets)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(ends[-1]) + np.repeat(texts.offsets[:-1][which] - ends[:-1], sizes)
    return Texts(texts.data[take], ends)


Sample = Callable[[], Iterator[tuple[np.ndarray, np.ndarray, Texts]]]


def fit(sample: Sample) -> Model:
    """A model of the parts (keys, whether toxic, whole texts) that every call of
    ``sample`` goes through.  Of a text only its distinct terms and its features are
    held, so that memory hangs on the number of rows and of their distinct terms."""
    keys, marks, held = [], [], []
    for key, mark, part in sample():
        keys.append(key)
        marks.append(mark.astype(bool))
        held.append(_term_rows(part))
    toxic = np.concatenate([np.empty(0, bool), *marks])
    if min(toxic.sum(), (~toxic).sum()) < LEAST_CLASS:
        return Model(Lexicon(np.empty(0, np.uint64), np.empty(0)), None, None)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")  # whatever order they came in
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begins = np.cumsum([0, *map(len, keys)])
    whose = np.concatenate([place[w + at] for (w, _, _), at in zip(held, begins, strict=False)])
    term, least = (np.concatenate([h[i] for h in held]) for i in (1, 2))
    toxic, least = toxic[order], least[order]
    # texts that are mostly alike count once, and lie in one fold
    heads, group = np.unique(least, return_inverse=True)
    marked = np.zeros(len(heads), dtype=bool)
    np.logical_or.at(marked, group, toxic)
    fold = (mix(heads) % np.uint64(FOLDS)).astype(np.int64)
    whose, term = _distinct(group[whose], term)
    fresh = np.ones(len(term), dtype=bool)
    fresh[1:] = term[1:] != term[:-1]
    names, index = term[fresh], np.cumsum(fresh) - 1

    def lexicon(without: int) -> Lexicon:
        used = fold != without
        inside = used[whose]
        return _learned(names, index[inside], marked[whose[inside]], int((marked & used).sum()), int((~marked & used).sum()))

    part_of = fold[group]
    its = [lexicon(f) for f in range(FOLDS)]
    x = np.zeros((len(toxic), N_FEATURES))
    where = dict(zip(key[order].tolist(), range(len(order)), strict=True))
    for some, _, part in sample():
        rows = np.array([where[k] for k in some.tolist()])
        for f in np.unique(part_of[rows]):
            mine = np.flatnonzero(part_of[rows] == f)
            x[rows[mine]] = np.concatenate([features(p, its[f]) for _, p in chunks(_some(part, mine))])
    y = toxic.astype(np.float64)
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        rest = part_of != f
        if rest.any() and not rest.all():
            margin[~rest] = grow(x[rest], y[rest]).margin(x[~rest])
    return Model(lexicon(-1), grow(x, y), isotonic(margin, y))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``docs`` (doc_id, text) under ``labels`` (doc_id, toxic): of at most
    ``rows`` labelled rows, those of the least hashes."""
    marked = labels.where("toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    total = marked.count()
    if total > 2 * rows:  # twice as many as are taken, as labels may have no row
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(2 * rows / total * (1 << 30)))
    marked = kept(marked, "labels")
    marked = F.broadcast(marked) if marked.count() <= 4 * rows else marked.hint("merge")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(F.col("doc_id"), text.alias("text")).join(marked, "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text")
    # rows alike count once; the least by their hash, which no order of rows changes
    least = known.select("key").distinct().orderBy("key").limit(rows)
    # `least` has no more than `rows` rows
    found = known.join(F.broadcast(least), "key").groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    taken = kept(found, "labelled-rows")

    def sample() -> Iterator[tuple[np.ndarray, np.ndarray, Texts]]:
        held: list = []
        size = 0
        for row in taken.toLocalIterator():
            held.append(row)
            size += len(row.text)
            if size > CHUNK_BYTES:
                yield part(held)
                held, size = [], 0
        if held:
            yield part(held)

    def part(held: list) -> tuple[np.ndarray, np.ndarray, Texts]:
        return np.array([r.key for r in held], np.int64), np.array([r.toxic for r in held], bool), texts_of(pa.array([r.text for r in held], pa.large_string()))

    model = fit(sample)
    give_back()
    return model


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2048):
            texts = texts_of(batch.column(1))
            score = np.concatenate([np.empty(0), *(model.score(part) for _, part in chunks(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), score and predicted."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lean(_scored(model)), with_row(rows, "score double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
