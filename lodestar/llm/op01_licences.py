"""Licence scans with a generalised suffix automaton of licence words.

Phrases and passages are words of one automaton.  A text is streamed through it:
at every word the automaton gives the longest run of words ending there that
some passage holds (matching statistics).  Runs that cannot be lengthened and
are long enough are chained, in the order of both text and passage, into spans
that cover a passage; a label is given where a span covers enough of it.
Phrases are counted wherever the run at a word ends in them.

Only words that continue a pair of words of some passage enter the automaton,
since no run of two or more words has any other pair.

Nulls and odd rows: a null or empty text has no words, no labels, null places
and score 0.  Rows are judged one by one, so repeated rows, ties and further
columns (carried in ``row``) change nothing; an empty table gives no rows.  A very
long text is held whole in one task, its words hashed in segments.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.licence_texts import PASSAGES, PHRASES
from lodestar.llm.streams import with_row
from lodestar.llm.textbytes import LOWER_WORD, Texts, chunks, hash_words, mix, split, texts_of

LEAST_RUN = 3  # words; runs of fewer are not chained
GAP = 12  # words that may stand between chained runs
COVER = 0.75  # of a passage's words
_TABLE = 1 << 20


class SuffixAutomaton:
    """All runs of words of several passages.  ``ends`` of a state are the
    (passage, last word) places of its runs."""

    def __init__(self, passages: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(passages):
            state = 0
            for at, word in enumerate(words):
                state = self._extend(state, word)
                self.ends[state].add((number, at))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _divided(self, parent: int, word: int) -> int:
        """The state of parent's longest run plus ``word``, split off if need be."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        part = self._new(self.length[parent] + 1, self.next[child], self.link[child])
        self.link[child] = part
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = part
            parent = self.link[parent]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._divided(last, word)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        self.link[state] = 0 if last < 0 else self._divided(last, word)
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known run ending at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


@dataclass
class Span:
    label: str
    passage: int
    first: int
    last: int
    covered: int


class Licences:
    def __init__(self, phrases: tuple[tuple[str, str], ...], passages: tuple[tuple[str, str], ...]) -> None:
        texts = [p for p, _ in phrases] + [p for _, p in passages]
        words = [t.split() for t in texts]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.passages = [[self.number[w] for w in ws] for ws in words]
        self.labels = [x for _, x in phrases] + [x for x, _ in passages]
        self.n_phrases = len(phrases)
        self.automaton = SuffixAutomaton(self.passages)
        self.phrase_of = self._outputs()
        # hashes of the words, as texts have them
        names = list(self.number)
        column = texts_of(pa.array(names))
        hashes = hash_words(column, split(column, LOWER_WORD))
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        pairs = {(a, b) for ws in self.passages for a, b in zip(ws[:-1], ws[1:], strict=True)}
        self.pairs = np.zeros(_TABLE, dtype=bool)
        self.pair_names = np.sort(np.array([self._pair(hashes[[a]], hashes[[b]])[0] for a, b in pairs], dtype=np.uint64))
        self.pairs[(self.pair_names & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ b)

    def _outputs(self) -> list[list[tuple[int, int]]]:
        """(phrase, words) that a run in each state may end in."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for phrase in range(self.n_phrases):
            state = 0
            for word in self.passages[phrase]:
                state = self.automaton.next[state][word]
            out[state].append((phrase, len(self.passages[phrase])))
        for state in sorted(range(1, len(out)), key=self.automaton.length.__getitem__):
            out[state] = out[state] + out[self.automaton.link[state]]
        return out

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of words, within a text, of which every pair is a passage's."""
        none = np.empty(0, np.int64)
        if len(hashes) < 2:
            return none, none
        pair = self._pair(hashes[:-1], hashes[1:])
        at = np.flatnonzero(self.pairs[(pair & np.uint64(_TABLE - 1)).astype(np.int64)])
        at = at[self.pair_names[np.minimum(np.searchsorted(self.pair_names, pair[at]), len(self.pair_names) - 1)] == pair[at]]
        inner = first[1:-1]
        at = at[~np.isin(at + 1, inner)]
        if not len(at):
            return none, none
        breaks = np.ones(len(at), dtype=bool)
        breaks[1:] = (np.diff(at) != 1) | np.isin(at[1:], inner)
        heads = np.flatnonzero(breaks)
        tails = np.append(heads[1:], len(at)) - 1
        return at[heads], at[tails] + 2

    def scan(self, texts: Texts) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, list[Span]]]:
        """Words per text; per text the (start, phrase) places and the spans."""
        lower = texts.lowered()
        words = split(lower, LOWER_WORD)
        hashes = hash_words(lower, words)
        begins, ends = self.candidates(hashes, words.first)
        owners = np.searchsorted(words.first, begins, side="right") - 1
        places: dict[int, list[tuple[int, int]]] = {}
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for begin, end, text in zip(begins.tolist(), ends.tolist(), owners.tolist(), strict=True):
            numbers = self.numbers[np.searchsorted(self.hashes, hashes[begin:end])].tolist()
            offset = begin - int(words.first[text])
            previous = (0, 0)
            for at, (state, length) in enumerate([*self.automaton.statistics(numbers), (0, 0)]):
                if previous[1] >= LEAST_RUN and length <= previous[1]:
                    runs.setdefault(text, []).append((offset + at - previous[1], *previous))
                previous = state, length
                for phrase, size in self.phrase_of[state]:
                    if size <= length:
                        places.setdefault(text, []).append((offset + at + 1 - size, phrase))
        return words.counts(), places, {text: self.chained(found) for text, found in runs.items()}

    def chained(self, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Runs (start, state, words), by start, joined where both text and
        passage go on; those that cover enough of a passage."""
        open_: dict[int, tuple[Span, int]] = {}
        done: list[Span] = []
        for start, state, length in runs:
            for passage, end in sorted(self.automaton.ends[state]):
                if passage < self.n_phrases:
                    continue
                begin = end + 1 - length
                have = open_.get(passage)
                if have and begin > have[1] and 0 <= start - have[0].last - 1 <= GAP:
                    span = have[0]
                    span.last, span.covered = start + length - 1, span.covered + length
                    open_[passage] = span, end
                elif not have or start > have[0].last or length > have[0].covered:
                    if have:
                        done.append(have[0])
                    open_[passage] = Span(self.labels[passage], passage, start, start + length - 1, length), end
        done += [span for span, _ in open_.values()]
        return [s for s in done if s.covered >= COVER * len(self.passages[s.passage])]


@functools.cache
def licences(phrases: tuple[tuple[str, str], ...], passages: tuple[tuple[str, str], ...]) -> Licences:
    return Licences(phrases, passages)


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,passage:int,first:long,last:long,coverage:double>>"


def _scan(phrases: tuple, passages: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = licences(phrases, passages)
        kind = pa.list_(pa.struct([("label", pa.string()), ("passage", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
        for batch in batches:
            for at, part in chunks(texts_of(batch.column(1))):
                counts, places, spans = known.scan(part)
                out: list[tuple] = []
                for i in range(len(part)):
                    here, covered = places.get(i, ()), spans.get(i, ())
                    starts = [s for s, _ in here]
                    base = sorted({known.labels[p] for _, p in here})
                    every = sorted({*base, *(s.label for s in covered)})
                    shares = [s.covered / len(known.passages[s.passage]) for s in covered]
                    out.append((
                        len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(every), 1.0 if base else max(shares, default=0.0),
                        [{"label": s.label, "passage": s.passage - known.n_phrases, "first": s.first, "last": s.last, "coverage": c} for s, c in zip(covered, shares, strict=True)],
                    ))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


def licence_scan(
    docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, passages: tuple[tuple[str, str], ...] = PASSAGES
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of its columns but the text),
    n_words, places of the phrases, labels, a score and the covered spans."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(tuple(phrases.items()), tuple(passages)), with_row(rows, _FIELDS))
