"""Licence scans, MinHash near-dedup, substring dedup and decontamination against
plain versions, over awkward tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER_WORD, AZ, classes, jaccard, lower_words, shingles, substring_dedup

from lodestar.llm import op01_licences, op05_minhash, op09_substrings, op10_decontaminate
from lodestar.llm.licence_texts import PHRASES
from lodestar.llm.textbytes import NON_SPACE, chunks, hash_words, split, texts_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, score double"


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    passage, other = words(rng, 70), words(rng, 25)
    base = words(rng, 300, 400)
    texts = [None, "", " \n\t ", "one two", "é" * 50]
    texts += [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(20)]
    texts += [" ".join(words(rng, 30) + passage + words(rng, 30)) for _ in range(8)]
    texts += [" ".join(words(rng, 5) + other + words(rng, 5) + other) for _ in range(4)]
    for k in range(6):  # near copies
        near = list(base)
        for _ in range(k):
            near[rng.randrange(300)] = "edit"
        texts.append("\n".join([" ".join(near[:150]), " ".join(near[150:])]))
    texts += [" ".join(["for"] * 90), " ".join(["for"] * 61), " ".join(["ab", "cd"] * 40), "x" * 3000 + " " + " ".join(words(rng, 3000))]
    texts += [texts[7], texts[7], texts[30]]
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "clash", 1, 0.5) for i, t in docs], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_words_are_those_of_the_patterns(docs):
    texts = texts_of(pa.array([t for _, t in docs]))
    low = texts.lowered()
    from lodestar.llm.textbytes import LOWER_WORD as TABLE

    for table, plain, source in ((NON_SPACE, lambda t: (t or "").split(), texts), (TABLE, lower_words, low)):
        found = split(source, table)
        expected = [plain(t) for _, t in docs]
        assert found.counts().tolist() == [len(w) for w in expected]
        spelled = [source.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]
        assert spelled == [w for ws in expected for w in ws]
        hashes = hash_words(source, found)
        assert len(set(hashes.tolist())) == len(set(spelled))


def test_chunks_cover_all_texts(docs):
    texts = texts_of(pa.array([t for _, t in docs]))
    parts = list(chunks(texts, limit=500, most=7))
    assert [i for at, p in parts for i in range(at, at + len(p))] == list(range(len(docs)))
    assert b"".join(p.data.tobytes() for _, p in parts) == texts.data.tobytes()


def test_substring_dedup(spark, docs):
    out = op09_substrings.substring_dedup(frame(spark, docs)).collect()
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out}
    assert got == substring_dedup(docs)
    texts = dict(docs)
    for r in out:
        if not r.n_removed:
            assert r.kept_text == (texts[r.row.doc_id] or "")


@pytest.mark.parametrize("seed", range(4))
def test_windows_that_are_equal_have_equal_anchors(seed):
    from lodestar.llm.recompression import anchors
    from lodestar.llm.textbytes import run_hash, sequence_sums

    rng = np.random.default_rng(seed)
    first = np.array([0, 400, 400, 700, 1000])
    hashes = rng.integers(0, 3 + 4 * seed, 1000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes[420:600] = hashes[20:200]
    hashes[710:900] = hashes[15:205]
    starts, names, _ = anchors(hashes, first, 20)
    assert len(starts) == sum(n - 19 for n in (400, 300, 300))
    name_of = {}
    for w, n in zip(run_hash(sequence_sums(hashes), starts, 20).tolist(), names.tolist(), strict=True):
        assert name_of.setdefault(w, n) == n


def _proposed(windows):
    for b in op09_substrings._repeated(8)([windows]):
        for r in b.to_pylist():
            for packed, widths in ((r["sure"], op09_substrings._REMOVED), (r["asks"], op09_substrings._ASKED)):
                if packed:
                    ids, _, begin, n = op09_substrings.unpack(packed, widths)[0][:4]
                    yield ids, begin, n


def test_long_texts_are_taken_in_segments(monkeypatch, docs):
    from lodestar.llm import textbytes

    texts = texts_of(pa.array([t for _, t in docs]))
    words = split(texts, NON_SPACE)
    hashes, whole = hash_words(texts, words), textbytes.text_hashes(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["id", "text"])

    def windows():
        rows = [r for b in op09_substrings._windows_by_anchor(20, 8)([batch]) for r in b.to_pylist()]
        rows.sort(key=lambda r: r["bucket"])
        sorted_batch = pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))
        gone = set()
        for ids, begin, n in _proposed(sorted_batch):
            gone |= {(int(i), int(s) + k) for i, s, m in zip(ids, begin, n, strict=True) for k in range(int(m))}
        return gone

    expected = windows()
    monkeypatch.setattr(textbytes, "CHUNK_BYTES", 200)
    monkeypatch.setattr(op09_substrings, "SEGMENT", 64)
    assert (hash_words(texts, words) == hashes).all() and (textbytes.text_hashes(texts) == whole).all()
    monkeypatch.setattr(op09_substrings, "chunks", lambda t: chunks(t, limit=1))
    assert windows() == expected and expected


@pytest.mark.parametrize("bits", [1, 6])
def test_words_decide_where_fingerprints_collide(spark, docs, bits):
    some = docs[:40]
    out = op09_substrings.substring_dedup(frame(spark, some).repartition(6), print_bits=bits).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == substring_dedup(some)


def test_substrings_of_the_greatest_id_and_none(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(2**63 - 1, passage), (None, passage), (None, passage + " x"), (-(2**63), "a " + passage)]
    out = op09_substrings.substring_dedup(frame(spark, rows)).collect()
    got = sorted((r.row.doc_id if r.row.doc_id is not None else 2**64, r.n_words, r.n_removed) for r in out)
    assert got == [(-(2**63), 26, 0), (2**63 - 1, 25, 25), (2**64, 25, 25), (2**64, 26, 25)]


def test_a_tasks_memory_of_repeats_changes_nothing(monkeypatch):
    rng = random.Random(6)
    passage = words(rng, 40)
    rows = [(rng.randrange(10**6), " ".join(words(rng, 10) + passage + words(rng, 10))) for _ in range(60)]
    expected = {i: r for i, r in substring_dedup(rows).items()}

    def removed(hot, limit):
        monkeypatch.setattr(op09_substrings, "_HOT", hot)
        monkeypatch.setattr(op09_substrings, "chunks", lambda t: chunks(t, limit=limit))
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])
        out = [r for b in op09_substrings._windows_by_anchor(20, 8)([batch]) for r in b.to_pylist()]
        volume = sum(len(r["packed"]) for r in out if r["bucket"] >= 0)
        out.sort(key=lambda r: r["bucket"])
        by_id = {}
        sorted_batch = pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))
        for ids, begin, n in _proposed(sorted_batch):
            for i, s, m in zip(ids.tolist(), begin.tolist(), n.tolist(), strict=True):
                by_id.setdefault(i, set()).update(range(s, s + m + 19))
        return by_id, volume

    with_memory, without = removed(1 << 17, 3000), removed(0, 3000)
    assert with_memory[0] == without[0] and with_memory[1] < without[1]
    assert {i: len(x) for i, x in with_memory[0].items()} == {i: r[1] for i, r in expected.items() if r[1]}


def test_rows_of_one_id(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text), (9, text)]
    out = op09_substrings.substring_dedup(frame(spark, rows)).collect()
    assert len(out) == 5
    by = sorted((r.row.doc_id if r.row.doc_id is not None else 99, r.n_words, r.n_removed) for r in out)
    # the twins are one document; whichever of text and its longer form comes first, the other is cut
    assert by[0][2] == by[1][2]
    assert {by[0][2], by[2][2]} == {0, 30} or by[2][2] == 0
    assert by[3] == (9, 30, 30) and by[4] == (99, 30, 30)


def test_near_duplicates(spark, docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    out = op05_minhash.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: r.class_id for r in out} == classes(sets, links)
    assert len(out) == len(docs)


def test_near_duplicates_in_many_blocks(spark):
    rng = random.Random(3)
    base = words(rng, 120, 500)
    rows = []
    for i in range(60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(near)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    out = op05_minhash.near_duplicates(frame(spark, rows), block=8).collect()
    assert {r.doc_id: r.class_id for r in out} == classes(sets, links)


def test_near_copies_of_a_large_group_are_compared_with_their_hub(spark, monkeypatch):
    """Of a group of near copies only those unlike the hub are compared with all others."""
    rng = random.Random(31)
    base = words(rng, 100, 10**5)
    rows = [(0, " ".join(base))]
    for i in range(1, 50):
        near = list(base)
        near[rng.randrange(100)] = f"edit{i}"
        rows.append((i, " ".join(near)))
    chain = list(base)
    for i in range(60, 72):  # each like the one before, the last unlike the hub
        chain = list(chain)
        chain[(i * 8) % 100] = f"step{i}"
        rows.append((i, " ".join(chain)))
    rows += [(80, " ".join(words(rng, 100, 10**5))), (3, " ".join(words(rng, 30, 10**5)))]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    links = [(a, b) for a in sets for b in sets if a < b and any(jaccard(x, y) >= 0.8 for x in sets[a] for y in sets[b])]
    asked = []
    whole = op05_minhash._left_open
    monkeypatch.setattr(op05_minhash, "_left_open", lambda *a: asked.append(whole(*a)) or asked[-1])
    for block in (1024, 8):
        out = op05_minhash.near_duplicates(frame(spark, rows), block=block).collect()
        assert len(out) == len(rows) and {r.doc_id: r.class_id for r in out} == classes(sets, links)
    near = frame(spark, rows[:50])
    assert len({r.class_id for r in op05_minhash.near_duplicates(near).collect()}) == 1
    assert asked[-1].count() == 0  # nothing was left to compare


def test_near_duplicates_of_long_texts(spark, monkeypatch):
    rng = random.Random(32)
    long = words(rng, 60_000, 10**5)
    edited = list(long)
    edited[30_000:30_500] = words(rng, 500, 10**5)
    rows = [(5, " ".join(long)), (7, " ".join(edited)), (6, " ".join(long)), (8, " ".join(words(rng, 60_000, 10**5)))]
    monkeypatch.setattr(op05_minhash, "BLOCK_BYTES", 1000)
    out = {r.doc_id: r.class_id for r in op05_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert out == {5: 5, 6: 5, 7: 5, 8: 8}


def test_recall_of_planted_near_copies(spark):
    """Pairs just above the threshold, by brute force."""
    rng = random.Random(33)
    rows, pairs = [], []
    for k in range(150):
        a = words(rng, 80, 10**6)
        b = list(a)
        for _ in range(rng.choice([1, 1, 2])):
            b[rng.randrange(80)] = f"e{k}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        if jaccard(shingles(" ".join(a)), shingles(" ".join(b))) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
    out = {r.doc_id: r.class_id for r in op05_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert len(pairs) >= 100 and sum(out[a] == out[b] for a, b in pairs) == len(pairs)
    assert sum(out[2 * k] == out[2 * k + 1] for k in range(150)) == len(pairs)


def test_rows_without_id_take_their_copies_class(spark):
    rows = [(3, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k"), (None, None)]
    out = sorted(((r.doc_id, r.class_id) for r in op05_minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert out == sorted([(3, 3), (None, 3), (None, None), (None, None)], key=str)


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    a = words(rng, 500, 10**6)
    b = a[:400] + words(rng, 100, 10**6)
    texts = texts_of(pa.array([" ".join(a), " ".join(b), "lone"]))
    names, first = op05_minhash.elements(texts)
    best = op05_minhash.signatures(names, first, 2000)
    true = jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
    assert abs((best[0] == best[1]).mean() - true) < 0.05
    assert (best != np.uint64(2**64 - 1)).all()


def test_licences(spark):
    rows = [
        (1, None), (2, ""), (3, "Released under the MIT License."), (4, "mit license MIT-License mit, license"), (5, "The Apache License. GNU General  Public\nLicense v3 apache license"),
        (6, "Licensed under CC BY-NC 4.0."), (7, "general public " * 500 + "license"), (8, "the mit licence"), (8, "the mit licence"),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
        (10, "mit"), (11, "licensemit license"),
    ]
    out = op01_licences.licence_scan(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in out:
        w = LOWER_WORD.findall((texts[r.row.doc_id] or "").translate(AZ))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.row.doc_id: r for r in out}
    assert by[6].labels == "cc-by-nc" and by[9].labels == "mit" and by[8].labels == ""
    assert [(s["first"], s["last"]) for s in by[9].spans if s["coverage"] == 1] == [(0, 28)]


def test_matching_statistics():
    rng = random.Random(2)
    passages = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    known = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    automaton = op01_licences.SuffixAutomaton(passages)
    stream = [rng.randrange(5) for _ in range(400)]
    for at, (state, length) in enumerate(automaton.statistics(stream)):
        best = max((n for n in range(at + 2) if n == 0 or tuple(stream[at + 1 - n : at + 1]) in known))
        assert length == best
        if length:
            run = stream[at + 1 - length : at + 1]
            ends = {(k, e) for k, p in enumerate(passages) for e in range(len(p)) if e + 1 >= length and p[e + 1 - length : e + 1] == run}
            assert automaton.ends[state] == ends


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(12, 40), 300))) for i in range(12)] + [(50, "three word item"), (51, None), (52, "")]
    rows = [(i, " ".join(words(rng, 60, 300))) for i in range(15)]
    for i in range(10):
        mine = items[i][1].split()
        if i % 3 == 1:
            mine[-1] = "changed"
        if i % 3 == 2:
            mine[len(mine) // 2] = "changed"
        rows.append((100 + i, " ".join(words(rng, 40, 300) + [w.upper() for w in mine] + words(rng, 10, 300))))
    rows += [(200, items[0][1]), (201, None), (202, "here is a three word item, and more"), (203, " ".join(items[3][1].split()[:-1]))]
    expected = set()
    for d, text in rows:
        w = lower_words((text or "").lower())
        for item, said in items:
            own = lower_words(said)
            if not own or not w:
                continue
            width = min(5, len(own))
            a = shingles(said, width)
            for start in range(-len(own) + 1, len(w)):
                window = w[max(start, 0) : start + len(own)]
                if len(window) >= width and jaccard(a, shingles(" ".join(window), width)) >= 0.8:
                    expected.add((d, item))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = op10_decontaminate.leaks(frame(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected
    assert (200, 0) in expected and (202, 50) in expected and len(expected) >= 8
    first = next(r for r in out if (r.doc_id, r.item_id) == (100, 0))
    assert (first.first_word, first.n_words, first.similarity) == (40, len(items[0][1].split()), 1.0)


def _best_windows(rows, items):
    """The greatest similarity of any window, cut at either end of a text or not, of every row and item."""
    best = {}
    for d, text in rows:
        w = lower_words(text)
        for item, said in items:
            own = lower_words(said)
            width, a = min(5, len(own)), shingles(said)
            windows = (w[max(start, 0) : start + len(own)] for start in range(-len(own) + 1, len(w)))
            sims = [jaccard(a, shingles(" ".join(x), width)) for x in windows if len(x) >= width]
            best[d, item] = max([best.get((d, item), 0.0), *sims])
    return {k: v for k, v in best.items() if v >= 0.8}


def test_decontamination_of_inserted_and_deleted_words(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(n))) for i, n in enumerate([78, 80, 84, 90, 60, 61])]
    rows = []
    for i, said in items:
        for change in range(4):
            mine = said.split()
            mine[1] = mine[-2] = "changed"
            middle = len(mine) // 2
            if change % 2:
                del mine[middle : middle + 2 + change]
            else:
                mine[middle:middle] = words(rng, 4 - change)
            rows.append((10 * i + change, " ".join(words(rng, 20 * (change < 2)) + mine + words(rng, 30))))
    expected = _best_windows(rows, items)
    assert (0, 0) in expected and len(expected) >= 8
    out = op10_decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in out} == expected


def test_decontamination_keeps_windows_that_differ(spark):
    rng = random.Random(12)
    items, rows = [], []
    for k in range(12):  # templated: the beginning of one item stands later in another of equal length
        said = [f"t{k}x{i}" for i in range(20)]
        items += [(2 * k, " ".join(said)), (2 * k + 1, " ".join([f"u{k}x{i}" for i in range(10)] + said[:10]))]
        rows.append((k, " ".join(said + words(rng, 20))))
        leak, clean = " ".join(said + words(rng, 5)), " ".join(said[:6] + words(rng, 30))
        some = [leak, clean] if k % 2 else [clean, leak]
        rows += [(100 + k, t) for t in some] + [(None, t) for t in some]
    expected = _best_windows(rows, items)
    assert len([k for k in expected if k[0] is None]) == 12 and len(expected) == 36
    out = op10_decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in out} == expected


def test_block_pairs_select_and_find(spark):
    """Unrelated fingerprints rarely meet; similar ones nearly always, those within the radius always."""
    rng = random.Random(13)
    F = op10_decontaminate.F
    rows, near = [], []
    for k in range(400):
        said = words(rng, 60, 10**6)
        edited = list(said)
        for _ in range(rng.randrange(1, 3)):
            edited[rng.randrange(60)] = f"edit{k}"
        rows.append((2 * k, " ".join(said)))
        rows.append((2 * k + 1, " ".join(edited)))
        if jaccard(shingles(" ".join(said)), shingles(" ".join(edited))) >= 0.8:
            near.append((2 * k, 2 * k + 1))
    df = spark.createDataFrame(rows, "k long, text string").select("k", op10_decontaminate.words(F.col("text")).alias("w"))
    df = df.select("k", op10_decontaminate.simhash(op10_decontaminate.shingles(F.col("w"))).alias("print"))
    keys = {r.k: ({(x.number, x.value) for x in r.pairs}, r.print & (2**64 - 1)) for r in df.select("k", "print", op10_decontaminate.block_pairs(F.col("print")).alias("pairs")).collect()}
    met = [bool(keys[a][0] & keys[b][0]) for a, b in near]
    assert len(near) > 100 and sum(met) / len(met) >= 0.97
    unrelated = [(2 * rng.randrange(400), 2 * rng.randrange(400)) for _ in range(20_000)]
    passed = [bool(keys[a][0] & keys[b][0]) for a, b in unrelated if a != b]
    assert sum(passed) / len(passed) <= 0.05
    for a, b in near + unrelated:
        if bin(keys[a][1] ^ keys[b][1]).count("1") <= op10_decontaminate.RADIUS:
            assert keys[a][0] & keys[b][0]


def test_decontamination_of_long_texts_repeated_rows_and_no_item_id(spark):
    rng = random.Random(14)
    item = " ".join(f"it{k}" for k in range(40))
    long = " ".join([*words(rng, 200_000, 5000), item, *words(rng, 100)])
    rows = [(1, long), (1, long), (2, item), (2, item), (3, " ".join(words(rng, 50)))]
    items = [(None, item), (None, "another one of five words"), (5, item), (5, item)]
    for shuffled in (False, True):
        out = op10_decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(((r.doc_id, r.item_id, r.first_word, r.similarity) for r in out), key=str) == sorted(
            [(1, 5, 200_000, 1.0), (1, None, 200_000, 1.0), (2, 5, 0, 1.0), (2, None, 0, 1.0)], key=str
        )
        op10_decontaminate.MOST_BROADCAST = 0
    op10_decontaminate.MOST_BROADCAST = 1_000_000


@pytest.mark.parametrize("operator", ["licences", "near", "substrings", "leaks", "leaks-none"])
def test_empty_tables(spark, operator):
    none = frame(spark, []) if operator != "leaks-none" else frame(spark, [(1, "a b c d e f")])
    benchmark = spark.createDataFrame([] if operator == "leaks-none" else [(1, "a b c d e f")], "item_id long, text string")
    out = {
        "licences": lambda: op01_licences.licence_scan(none),
        "near": lambda: op05_minhash.near_duplicates(none),
        "substrings": lambda: op09_substrings.substring_dedup(none),
        "leaks": lambda: op10_decontaminate.leaks(none, benchmark),
        "leaks-none": lambda: op10_decontaminate.leaks(none, benchmark),
    }[operator]()
    assert out.collect() == [] and out.columns


def test_substring_dedup_keeps_no_spent_shuffles(spark, docs):
    """They stayed on disk until the driver happened to collect its garbage."""
    import time

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    _, left = op09_substrings._removed(frame(spark, docs).select("doc_id", "text").toDF("id", "text"), 20, 512, 48)
    assert left.isEmpty()
    until = time.time() + 5
    while shuffled() - before and time.time() < until:  # files are deleted in the background
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
