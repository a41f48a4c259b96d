"""Substring dedup: words under a window that also starts earlier are removed.

Every window of ``width`` words is named by its anchor, the recompression symbol
that any equal window shares (see ``recompression``).  Windows travel with their
anchor's name: a name that stands once needs no further look, and windows under
a repeated name are proposed as equal by a fingerprint.  Words decide: each
proposed window is compared, word by word, with the one before it of its
fingerprint.  Equal windows always share name and fingerprint, so none is missed;
windows that differ in spite of their fingerprints, and all others of those
fingerprints, are looked at again under other hashes, until none is left undecided.

What a chunk of texts repeats within itself is settled before the shuffle, and what
was repeated in an earlier chunk of a task is proposed there, so that a passage which
a third of all texts hold reaches a task about once per input task and not once per
text.  Each window is compared with its predecessor only, so that no text is asked
for its words more than twice per window.

Nulls, ties and odd rows: a null text has no words.  Rows of one ``doc_id`` are
ordered by a hash of their text, and rows alike in both are one document: each
gets its result.  A null ``doc_id`` comes after all others, ordered likewise.  Other
columns are carried in the struct ``row`` and cannot clash.  A very long text is held
whole in one task, its windows looked at in segments.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestar.llm.recompression import anchors
from lodestar.llm.store import kept
from lodestar.llm.streams import by_key, lean, narrow, pack, parts, unpack
from lodestar.llm.textbytes import NON_SPACE, Texts, Words, chunks, hash_words, mix, run_hash, sequence_sums, split, text_hashes, texts_of

WIDTH = 20
PRINT_BITS = 48
BUCKETS = 1024  # of anchors' names, at least; more where the session has many shuffle partitions
_NO_ID = (1 << 63) - 1
_ANCHOR = (6, 8, 8, 4, 1)  # bytes: name, doc_id, text key, start, windows
_REMOVED = (8, 8, 4, 4)  # doc_id, text key, start, windows
_ASKED = (*_REMOVED, 8, 8, 4)  # and where the windows are said to stand before
_SURE, _ASK = 0, 1
_FLUSH = 1 << 18
_OUT_BYTES = 1 << 26
MOST_OPEN = 1 << 20  # fingerprints that are told to all tasks
_HOT = 1 << 17  # repeated windows that a task remembers between chunks
SEGMENT = 1 << 19  # words of one text that are looked at together


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _text_keys(texts: Texts, missing: np.ndarray) -> np.ndarray:
    """What tells rows of one id apart; the top bit tells no id from the greatest."""
    return (text_hashes(texts) >> np.uint64(1)) | (missing.astype(np.uint64) << np.uint64(63))


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(breaks)
    return heads, np.diff(np.append(heads, len(breaks)))


def _other_print(words: bytes, turn: int) -> int:
    """A fingerprint that has nothing in common with the first turn's."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=PRINT_BITS // 8, key=turn.to_bytes(4, "little")).digest(), "little")


def _prints(hashes: np.ndarray, starts: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Fingerprints of windows, of the bits that travel."""
    return run_hash(sequence_sums(hashes), starts, width) & np.uint64((1 << bits) - 1)


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return (name % np.uint64(buckets)).astype(np.int64)


def _document_bucket(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(mix(ids.view(np.uint64) ^ mix(keys)) >> np.uint64(8), buckets)


def _passage(text: bytes, words: Words, at: int, n: int) -> bytes:
    """``n`` words of a text, joined by one space."""
    return b" ".join(text[words.starts[at] : words.ends[at + n - 1]].split())


def _earlier(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, ids2: np.ndarray, keys2: np.ndarray, starts2: np.ndarray) -> np.ndarray:
    """Whether the first place is before the second."""
    return (ids < ids2) | ((ids == ids2) & ((keys < keys2) | ((keys == keys2) & (starts < starts2))))


class _Hot:
    """Windows that chunks of a task repeated, with the first place of each.  Only
    spares the shuffle: forgetting them changes no result."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.prints, self.names, self.keys = (np.empty(0, np.uint64) for _ in range(3))
        self.ids, self.starts = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, prints: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the windows are known, where)."""
        if not len(self.prints):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        which = np.flatnonzero((self.prints[at] == prints) & (self.names[at] == names))
        return which, at[which]

    def add(self, prints: np.ndarray, names: np.ndarray, ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> None:
        if len(self.prints) + len(prints) > _HOT:
            self.clear()
        have = (self.prints, self.names, self.ids, self.keys, self.starts)
        every = [np.concatenate(x) for x in zip(have, (prints, names, ids, keys, starts), strict=True)]
        order = np.lexsort(every[::-1])
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = every[0][order][1:] != every[0][order][:-1]
        self.prints, self.names, self.ids, self.keys, self.starts = (x[order[fresh]] for x in every)


def _windows_by_anchor(width: int, buckets: int, bits: int = PRINT_BITS, turn: int = 0, only: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents in; out come, for a bucket of anchor names, packed windows, and
    with buckets below zero what chunks already know or propose.  After the first
    turn, windows of some fingerprints only, told apart by other ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Hot()
        for batch in batches:
            ids, missing = _ids(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for at, texts in chunks(texts_of(batch.column(1))):
                words = split(texts, NON_SPACE)
                keys, hashes = _text_keys(texts, missing[at : at + len(texts)]), hash_words(texts, words)
                own = ids[at : at + len(texts)]
                data = texts.data.tobytes()
                if len(texts) > 1 or len(hashes) <= SEGMENT:
                    yield from chunk(own, keys, hashes, words.first, 0, data, words, hot)
                    continue
                # windows are what their words are: a long text is taken in segments
                for low in range(0, len(hashes), SEGMENT):
                    part = hashes[low : low + SEGMENT + width - 1]
                    yield from chunk(own, keys, part, np.array([0, len(part)]), low, data, words, hot)

    def chunk(ids: np.ndarray, keys: np.ndarray, hashes: np.ndarray, first: np.ndarray, base: int, data: bytes, words: Words, hot: _Hot) -> Iterator[pa.RecordBatch]:
        starts, names, places = anchors(hashes, first, width)
        if not len(starts):
            return
        doc = np.searchsorted(first, starts, side="right") - 1
        prints = _prints(hashes, starts, width, bits)
        if turn:
            some = np.arange(len(starts)) if only is None else np.flatnonzero(np.isin(prints, only))
            if not len(some):
                return
            starts, names, places, doc = starts[some], names[some], places[some], doc[some]
            prints = np.array([_other_print(_passage(data, words, at, width), turn) for at in (starts + base).tolist()], dtype=np.uint64)
        ranked = np.lexsort((keys, ids))
        changed = np.ones(len(ids), dtype=bool)
        changed[1:] = (ids[ranked][1:] != ids[ranked][:-1]) | (keys[ranked][1:] != keys[ranked][:-1])
        rank = np.empty(len(ids), dtype=np.int64)
        rank[ranked] = np.cumsum(changed) - 1
        begin = starts - first[doc] + base
        when = (rank[doc] << 32) | begin
        order = np.lexsort((when, prints)) if (np.diff(rank) < 0).any() else np.argsort(prints, kind="stable")
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (prints[order][1:] != prints[order][:-1]) | (names[order][1:] != names[order][:-1])
        lead = np.empty(len(order), dtype=np.int64)
        lead[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        gone = when[lead] != when
        clone = (lead != np.arange(len(lead))) & ~gone  # of a repeated row: its twin speaks for it

        out: tuple[list[int], list[bytes]] = ([], [])
        ids64 = ids.view(np.uint64)

        def say(kind: int, *columns: np.ndarray) -> None:
            widths = _REMOVED if kind == _SURE else _ASKED
            out[0].append(-1 - kind)
            out[1].append(pack(*(narrow(c, w) for c, w in zip(columns, widths, strict=True))))

        # what the chunk holds twice is compared here
        sel = np.flatnonzero(gone)
        if len(sel):
            breaks = np.ones(len(sel), dtype=bool)
            breaks[1:] = (np.diff(starts[sel]) != 1) | (doc[sel][1:] != doc[sel][:-1]) | (np.diff(starts[lead[sel]]) != 1) | (doc[lead[sel]][1:] != doc[lead[sel]][:-1])
            heads, n = _runs(breaks)
            g, was = sel[heads], lead[sel[heads]]
            same = np.ones(len(g), dtype=bool)
            for i, (a, b, count) in enumerate(zip((starts[g] + base).tolist(), (starts[was] + base).tolist(), (n + width - 1).tolist(), strict=True)):
                x, y = data[words.starts[a] : words.ends[a + count - 1]], data[words.starts[b] : words.ends[b + count - 1]]
                same[i] = x == y or x.split() == y.split()
            s, o = np.flatnonzero(same), np.flatnonzero(~same)
            if len(s):
                say(_SURE, ids64[doc[g[s]]], keys[doc[g[s]]], begin[g[s]], n[s])
            if len(o):
                say(_ASK, ids64[doc[g[o]]], keys[doc[g[o]]], begin[g[o]], n[o], ids64[doc[was[o]]], keys[doc[was[o]]], begin[was[o]])
        # what earlier chunks of the task repeated is proposed
        rest = ~gone & ~clone
        mine = np.flatnonzero(rest)
        which, at = hot.find(prints[mine], names[mine])
        if len(which):
            w = mine[which]
            later = _earlier(hot.ids[at], hot.keys[at], hot.starts[at], ids[doc[w]], keys[doc[w]], begin[w])
            w, at = w[later], at[later]
            if len(w):
                breaks = np.ones(len(w), dtype=bool)
                breaks[1:] = (
                    (np.diff(starts[w]) != 1) | (doc[w][1:] != doc[w][:-1]) | (hot.ids[at][1:] != hot.ids[at][:-1]) | (hot.keys[at][1:] != hot.keys[at][:-1]) | (np.diff(hot.starts[at]) != 1)
                )
                heads, n = _runs(breaks)
                g, h = w[heads], at[heads]
                say(_ASK, ids64[doc[g]], keys[doc[g]], begin[g], n, hot.ids[h].view(np.uint64), hot.keys[h], hot.starts[h])
                rest[w] = False
        twice = np.zeros(len(starts), dtype=bool)
        twice[lead[gone]] = True
        twice = np.flatnonzero(twice)
        if len(twice):
            hot.add(prints[twice], names[twice], ids[doc[twice]], keys[doc[twice]], begin[twice])

        sel = np.flatnonzero(rest)
        if len(sel):
            breaks = np.ones(len(sel), dtype=bool)
            breaks[1:] = (np.diff(starts[sel]) != 1) | (doc[sel][1:] != doc[sel][:-1]) | (places[sel][1:] != places[sel][:-1]) | (names[sel][1:] != names[sel][:-1])
            heads, n = _runs(breaks)
            g = sel[heads]
            bucket = _bucket(names[g], buckets)
            dealt = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[dealt])) + 1
            edges = np.concatenate([[0], cuts, [len(dealt)]])
            flat = np.concatenate([[0], np.cumsum(n[dealt])])
            spread = np.repeat(heads[dealt] - flat[:-1], n[dealt]) + np.arange(flat[-1])
            marks = narrow(prints[sel][spread], 6)
            bucket, g, n = bucket[dealt], g[dealt], n[dealt]
            columns = [narrow(x, w) for x, w in zip((names[g] >> np.uint64(16), ids64[doc[g]], keys[doc[g]], begin[g], n), _ANCHOR, strict=True)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[0].append(int(bucket[lo]))
                out[1].append(pack(*(c[lo:hi] for c in columns)) + pack(marks[flat[lo] : flat[hi]]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "packed"])

    return run


_FOUND = "bucket int, sure binary, asks binary, shows binary"
_VERIFIED = "bucket int, sure binary, open binary"


def _by_document(buckets: int, names: list[str], found: list[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """A batch of one row per bucket of documents: in each binary column its windows
    of that kind, packed, by the document whose columns begin at the given place."""
    cells: dict[int, list[bytes | None]] = {}
    for at, (base, columns) in enumerate(found):
        if not columns:
            continue
        bucket = _document_bucket(columns[base], columns[base + 1], buckets)
        dealt = np.argsort(bucket, kind="stable")
        heads, sizes = _runs(np.concatenate([[True], np.diff(bucket[dealt]) != 0]))
        planes = [narrow(c[dealt], w) for c, w in zip(columns, _ASKED, strict=False)]
        for h, n in zip(heads.tolist(), sizes.tolist(), strict=True):
            cells.setdefault(int(bucket[dealt[h]]), [None] * len(found))[at] = pack(*(c[h : h + n] for c in planes))
    if cells:
        columns = [pa.array([row[at] for row in cells.values()], pa.binary()) for at in range(len(found))]
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int32()), *columns], names=["bucket", *names])


def _joined(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _repeated(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows sorted by bucket in; out come those known to start earlier too, and
    those proposed, twice: for either document that has to show its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure: list[list[np.ndarray]] = []
        asked: list[list[np.ndarray]] = []
        size = 0
        for bucket, rows in by_key(batches, "bucket"):
            packed = rows.column("packed").to_pylist()
            if bucket < 0:
                kind = -1 - bucket
                found = [unpack(p, _ASKED if kind else _REMOVED)[0] for p in packed]
                (asked if kind else sure).extend(found)
            else:
                found = [x] if (x := later(packed)) else []
                asked += found
            size += sum(len(x[0]) for x in found)
            if size > _FLUSH:
                yield from flush(sure, asked)
                sure, asked, size = [], [], 0
        yield from flush(sure, asked)

    def flush(sure: list, asked: list) -> Iterator[pa.RecordBatch]:
        both = _joined(asked)
        yield from _by_document(buckets, ["sure", "asks", "shows"], [(0, _joined(sure)), (0, both), (4, both)])

    def later(packed: list[bytes]) -> list[np.ndarray] | None:
        groups, marks = [], []
        for p in packed:
            columns, at = unpack(p, _ANCHOR)
            groups.append(columns)
            marks.append(unpack(p, (6,), at)[0][0])
        name, ids, keys, begin, n = (np.concatenate(c) for c in zip(*groups, strict=True))
        mark = np.concatenate(marks)
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        twice = np.zeros(len(name), dtype=bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        g = np.flatnonzero(twice)
        if not len(g):
            return None
        flat = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
        count = n[g].astype(np.int64)
        base = np.concatenate([[0], np.cumsum(count)])
        step = np.arange(base[-1]) - np.repeat(base[:-1], count)
        w = mark[np.repeat(flat[g], count) + step]
        who = np.repeat(g, count)
        start = begin[who] + step.astype(np.uint64)
        signed, key, named = ids.view(np.int64)[who], keys[who], name[who]
        order = np.lexsort((start, key, signed, named, w))
        a, b = order[1:], order[:-1]  # a window, and the one before it of its fingerprint
        follows = (w[a] == w[b]) & (named[a] == named[b])
        elsewhere = (signed[a] != signed[b]) | (key[a] != key[b]) | (start[a] != start[b])
        gone, was = a[follows & elsewhere], b[follows & elsewhere]
        if not len(gone):
            return None
        dealt = np.argsort(gone)
        gone, was = gone[dealt], was[dealt]
        breaks = np.ones(len(gone), dtype=bool)
        breaks[1:] = (np.diff(gone) != 1) | (who[gone][1:] != who[gone][:-1]) | (signed[was][1:] != signed[was][:-1]) | (key[was][1:] != key[was][:-1])
        breaks[1:] |= start[was][1:] != start[was][:-1] + np.uint64(1)
        heads, size = _runs(breaks)
        at, by = gone[heads], was[heads]
        return [ids[who[at]], key[at], start[at], size.astype(np.uint64), ids[who[by]], key[by], start[by]]

    return run


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Proposals of one pair of documents that go on where the last ended, as one.
    Both sides hold all proposals of a pair, and so come to the same ones."""
    order = np.lexsort((columns[2], *(columns[i] for i in (5, 4, 1, 0))))
    columns = [c[order] for c in columns]
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = np.any([columns[i][1:] != columns[i][:-1] for i in (0, 1, 4, 5)], axis=0)
    for at in (2, 6):
        breaks[1:] |= columns[at][1:] != columns[at][:-1] + columns[3][:-1]
    heads, _ = _runs(breaks)
    out = [c[heads] for c in columns]
    out[3] = np.add.reduceat(columns[3], heads)
    return out


def _shown(width: int, pairs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts and what is asked of them, sorted by bucket, in; out come the words of
    proposed windows, dealt so that both sides of a proposal meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        held: list[tuple[int, list[np.ndarray], list[bytes]]] = []
        size = 0
        for _, rows in by_key(batches, "bucket"):
            docs = rows.filter(rows.column("id").is_valid())
            where = {pair: i for i, pair in enumerate(zip(docs.column("id").to_pylist(), docs.column("key").to_pylist(), strict=True))}
            for side, name in enumerate(("asks", "shows")):
                asked = rows.column(name).drop_null().to_pylist()
                if not asked:
                    continue
                columns = _merged(_joined([unpack(p, _ASKED)[0] for p in asked]))
                ids, keys, at = (columns[i] for i in ((4, 5, 6) if side else (0, 1, 2)))
                order = np.lexsort((keys, ids))
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
                for h, m in zip(*(x.tolist() for x in _runs(fresh)), strict=True):
                    mine = order[h : h + m]
                    pair = int(ids.view(np.int64)[mine[0]]), int(keys.view(np.int64)[mine[0]])
                    text = expand.decompress(docs.column("packed")[where[pair]].as_py())
                    words = split(texts_of(pa.array([text], pa.large_binary())), NON_SPACE)
                    said = [_passage(text, words, b, n + width - 1) for b, n in zip(at[mine].tolist(), columns[3][mine].tolist(), strict=True)]
                    held.append((side, [c[mine] for c in columns], said))
                    size += sum(map(len, said)) + 64 * m
                    if size > _OUT_BYTES:
                        yield batch(held, squeeze)
                        held, size = [], 0
        if held:
            yield batch(held, squeeze)

    def batch(held: list, squeeze: zstandard.ZstdCompressor) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes, bytes]] = []
        for side in (0, 1):
            mine = [(c, said) for s, c, said in held if s == side]
            if not mine:
                continue
            columns, said = _joined([c for c, _ in mine]), [x for _, some in mine for x in some]
            q = _bucket(mix(columns[0] ^ mix(columns[1] ^ mix(columns[2]))) >> np.uint64(8), pairs)
            dealt = np.argsort(q, kind="stable")
            for h, n in zip(*(x.tolist() for x in _runs(np.concatenate([[True], np.diff(q[dealt]) != 0]))), strict=True):
                some = dealt[h : h + n]
                body = [said[i] for i in some]
                sizes = np.array([len(x) for x in body])
                packed = pack(*(narrow(c, w) for c, w in zip([*(c[some] for c in columns), sizes], (*_ASKED, 8), strict=True)))
                rows.append((int(q[some[0]]), side, packed, squeeze.compress(b"".join(body))))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "side", "packed", "said"])

    return run


def _compared(width: int, buckets: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Both sides' words, sorted by bucket, in; out come the windows that are the
    same, and as open, with their fingerprints, those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        sure: list[tuple] = []
        open_: list[tuple] = []
        for _, rows in by_key(batches, "bucket"):
            waits: dict[tuple, tuple[int, bytes]] = {}
            for side, p, said in zip(rows.column("side").to_pylist(), rows.column("packed").to_pylist(), rows.column("said").to_pylist(), strict=True):
                columns = unpack(p, (*_ASKED, 8))[0]
                ends = np.concatenate([[0], np.cumsum(columns[7].astype(np.int64))]).tolist()
                body = expand.decompress(said)
                for i, key in enumerate(zip(*(c.tolist() for c in columns[:7]), strict=True)):
                    mine = body[ends[i] : ends[i + 1]]
                    other = waits.get(key)
                    if other is None or other[0] == side:
                        waits[key] = side, mine
                        continue
                    del waits[key]
                    if other[1] == mine:
                        sure.append(key[:4])
                    else:
                        own, far = (mine, other[1]) if side == 0 else (other[1], mine)
                        x, y, prints = own.split(), far.split(), prints_of(own)
                        for k in range(key[3]):
                            same = x[k : k + width] == y[k : k + width]
                            (sure if same else open_).append((*key[:2], key[2] + k, 1, *(() if same else (prints[k],))))
            if len(sure) + len(open_) > _FLUSH:
                yield from flush(sure, open_)
                sure, open_ = [], []
        yield from flush(sure, open_)

    def prints_of(said: bytes) -> list[int]:
        text = texts_of(pa.array([said], pa.large_binary()))
        hashes = hash_words(text, split(text, NON_SPACE))
        return _prints(hashes, np.arange(len(hashes) - width + 1), width, bits).tolist()

    def flush(sure: list[tuple], open_: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = [(0, [np.array(c, dtype=np.uint64) for c in zip(*some, strict=True)]) for some in (sure, open_)]
        yield from _by_document(buckets, ["sure", "open"], found)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open windows, one row each."""
    for batch in batches:
        for p in batch.column(0).to_pylist():
            ids, keys, begin, _, prints = (c.view(np.int64) for c in unpack(p, (*_REMOVED, 8))[0])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, keys, begin, prints)], names=["id", "key", "start", "print"])


def _documents(buckets: int, with_row: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text[, row]) with their bucket and text key, texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in parts(batches, 2048):
            ids, missing = _ids(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            column = texts_of(batch.column(1))
            keys, texts = [], []
            for at, part in chunks(column):
                keys.append(_text_keys(part, missing[at : at + len(part)]))
                texts += [squeeze.compress(part.text(i)) for i in range(len(part))]
            key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_document_bucket(ids, key, buckets).astype(np.int32)),
                    pa.array(texts, pa.binary()),
                    pa.array(ids),
                    pa.array(key.view(np.int64)),
                    *([batch.column(2)] if with_row else []),
                ],
                names=["bucket", "packed", "id", "key", *(["row"] if with_row else [])],
            )

    return run


def _left(text: bytes, gone: list[tuple[int, int]] | None, width: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    if not gone:
        words = text.split()
        return len(words), 0, b" ".join(words)
    words = split(texts_of(pa.array([text], pa.large_binary())), NON_SPACE)
    total = len(words.starts)
    steps = np.zeros(total + 1, dtype=np.int64)
    spans = np.array(gone)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 0] + spans[:, 1] - 1 + width, -1)
    stays = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    kept = [text[a:b] for a, b in zip(words.starts[stays].tolist(), words.ends[stays].tolist(), strict=True)]
    return total, total - len(kept), b" ".join(kept)


def _cut(width: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents and their removed windows, sorted by bucket, in; results out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for _, rows in by_key(batches, "bucket"):
            is_doc = rows.column("id").is_valid().to_numpy()
            windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for p in rows.column("sure").drop_null().to_pylist():
                ids, keys, begin, n = unpack(p, _REMOVED)[0]
                for i, k, b, c in zip(ids.view(np.int64).tolist(), keys.view(np.int64).tolist(), begin.tolist(), n.tolist(), strict=True):
                    windows.setdefault((i, k), []).append((b, c))
            docs = rows.filter(pa.array(is_doc)).combine_chunks()
            out: list[tuple] = []
            size = at = 0
            for packed, i, k in zip(docs.column("packed").to_pylist(), docs.column("id").to_pylist(), docs.column("key").to_pylist(), strict=True):
                text = expand.decompress(packed)
                total, removed, joined = _left(text, windows.get((i, k)), width)
                out.append((total, removed, hashlib.sha256(joined).hexdigest(), (joined if removed else text) if with_text else None))
                size += len(text) if with_text else 0
                if size > _OUT_BYTES:  # a batch of strings holds 2 GB at most
                    yield batch(docs.slice(at, len(out)), out)
                    at, out, size = at + len(out), [], 0
            if out:
                yield batch(docs.slice(at, len(out)), out)

    def batch(docs: pa.Table, out: list[tuple]) -> pa.RecordBatch:
        total, removed, sha, text = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(docs.column("row").chunks),
                pa.array(total, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(sha, pa.string()),
                pa.array(text, pa.binary()).cast(pa.string()),
            ],
            names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    return run


def _removed(plain: DataFrame, width: int, buckets: int, bits: int, turn: int = 0, only: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """(bucket, sure): windows that are removed, by documents' buckets; and (id, key,
    start, print): those left open."""
    parts_ = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = plain.mapInArrow(lean(_windows_by_anchor(width, max(BUCKETS, 8 * parts_), bits, turn, only)), "bucket int, packed binary")
    # chunks' own findings are dealt out at random, windows by their bucket
    dealt = F.when(F.col("bucket") < 0, F.xxhash64("packed")).otherwise(F.col("bucket").cast("long"))
    found = kept(windows.repartition(dealt).sortWithinPartitions("bucket").mapInArrow(lean(_repeated(buckets)), _FOUND), "substrings-found", spent=True)
    texts = plain.mapInArrow(lean(_documents(buckets, with_row=False)), "bucket int, packed binary, id long, key long")
    asked = found.select("bucket", "asks", "shows").where("asks is not null or shows is not null")
    both = texts.unionByName(asked, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    said = both.mapInArrow(lean(_shown(width, max(256, 2 * parts_))), "bucket int, side int, packed binary, said binary")
    verified = kept(said.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_compared(width, buckets, bits)), _VERIFIED), "substrings-verified", spent=True)
    sure = found.select("bucket", "sure").unionByName(verified.select("bucket", "sure")).where("sure is not null")
    return sure, verified.select("open").where("open is not null").mapInArrow(_unpacked, "id long, key long, start long, print long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True, print_bits: int = PRINT_BITS) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of its columns but the text),
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and
    kept_text (the text as it was where nothing is removed, else the kept words
    joined by one space; null without ``with_text``).  Fingerprints of fewer bits only
    make more windows be looked at again."""
    spark = docs.sparkSession
    buckets = max(512, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # of documents
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    removed, left = _removed(plain, width, buckets, print_bits)
    turn = 0
    while not left.isEmpty():  # a window is open only if it is so in every turn
        left = kept(left, "substrings-open")
        prints = [r[0] for r in left.select("print").distinct().limit(MOST_OPEN + 1).collect()]
        # all windows of the open ones' fingerprints; of more than can be told to all tasks, all windows
        only = np.array(sorted(prints), dtype=np.uint64) if len(prints) <= MOST_OPEN else None
        turn += 1
        more, still = _removed(plain, width, buckets, print_bits, turn, only)
        removed = removed.unionByName(more)
        left = left.join(still.select("id", "key", "start"), ["id", "key", "start"], "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*rest).alias("row"))
    row = StructField("row", rows.schema["row"].dataType)
    texts = rows.mapInArrow(lean(_documents(buckets, with_row=True)), StructType([*StructType.fromDDL("bucket int, packed binary, id long, key long"), row]))
    both = texts.unionByName(removed, allowMissingColumns=True)
    return (
        both.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(_cut(width, with_text)), StructType([row, *StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string")]))
    )
