"""Toxicity, embeddings, chats, mixing, WARC, URL filters and the pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import classes

from lodestar.llm import boosting, op02_toxicity, op03_embeddings, op04_chat, op06_mix, op07_warc, op08_urls
from lodestar.llm.graph import components
from lodestar.llm.textbytes import texts_of


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (5000, 5001), (5001, 5000)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = classes({x for e in real for x in e}, real)
    out = components(df, "a", "b").collect()
    assert {r.id: r.component for r in out} == expected and len(out) == len(expected)
    assert components(df.limit(0), "a", "b").collect() == []


def _cos(a, b):
    return float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        x = rng.normal(size=16)
        rows.append((i, x.astype(np.float32).tolist()))
    for i in range(120, 200):  # around a few centres, some beyond the threshold
        x = np.array(rows[i % 5][1]) + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.5])
        rows.append((i, x.astype(np.float32).tolist()))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [0.0] * 16), (203, None), (204, [float("nan")] * 16), (205, [None] * 16), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [])]
    rows += [(209, (np.array(rows[4][1]) * 1e-30).tolist()), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    good = {}
    for i, v in rows:
        x = np.array([np.nan if y is None else y for y in (v or [])], dtype=np.float32).astype(np.float64)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            good[i] = x / np.abs(x).max()
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and _cos(good[a], good[b]) >= 0.9]
    assert len(links) > 100
    expected = classes([i for i, _ in rows if i is not None], links)
    count = {i: sum(i in e for e in links) for i in expected}
    for block in (8192, 32):
        out = op03_embeddings.embedding_links(df, block=block).collect()
        assert len(out) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None} == {i: (count[i], expected[i]) for i in expected}
    assert op03_embeddings.embedding_links(df.limit(0)).collect() == []


def test_tiles_that_hold_no_link_are_skipped(spark):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * 0.15).tolist()) for i in range(300)] + [(900, [1.0, 2.0]), (901, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = [(a, b) for a, x in rows for b, y in rows if a < b and len(x) == len(y) and _cos(np.array(x), np.array(y)) >= 0.9]
    out = {r.vec_id: (r.n_links, r.component_id) for r in op03_embeddings.embedding_links(df, block=20).collect()}
    expected = classes([i for i, _ in rows], links)
    assert out == {i: (sum(i in e for e in links), expected[i]) for i, _ in rows}
    kept_rows = spark.createDataFrame([(i, 1, np.array(v).tobytes()) for i, v in rows], "id long, copies long, vec binary")
    placed, blocks = op03_embeddings.in_blocks(kept_rows, 20, "<f8")
    pairs = {(r.i, r.j) for r in op03_embeddings.tiles_of(blocks, 0.9).collect()}
    n = blocks.count()
    assert len(pairs) < n * (n + 1) / 2 * 0.8
    where = {r.id: r.block for r in placed.collect()}
    assert all((min(where[a], where[b]), max(where[a], where[b])) in pairs for a, b in links)


def test_products_of_many_dimensions_are_exact():
    rng = np.random.default_rng(5)
    p, q = (rng.integers(-127, 128, (3, 5000)).astype(np.float32) for _ in range(2))
    assert (op03_embeddings._product(p, q) == p.astype(np.int64) @ q.astype(np.int64).T).all()
    long = rng.normal(size=(2, 5000))
    three = np.stack([long[0], long[1], long[0] * 2])
    assert [tuple(map(int, x)) for us, vs in op03_embeddings.tile(three, three, True, 0.99) for x in zip(us, vs, strict=True)] == [(0, 2)]


def test_tile_bounds_never_lose_a_pair():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 24)) * rng.choice([1e-6, 1, 1e6], size=(300, 1))
    a[50:100] = a[:50] + rng.normal(size=(50, 24)) * np.abs(a[:50]).max(axis=1, keepdims=True) * 0.2
    whole = op03_embeddings.unit_rows(a) @ op03_embeddings.unit_rows(a).T
    for threshold in (0.5, 0.9, 0.99):
        got = {(int(u), int(v)) for us, vs in op03_embeddings.tile(a, a, True, threshold) for u, v in zip(us, vs, strict=True)}
        u, v = np.nonzero(np.triu(whole >= threshold, 1))
        assert got == set(zip(u.tolist(), v.tolist(), strict=True))


def _toxic_docs(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [f"word{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["you moron", "idiot", f"blarg{rng.choice('abcdef')}{rng.randrange(9)}"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = _toxic_docs(1, 900)
    extra = [(2000, None), (2001, ""), (None, "an idiot"), (2002, "you idiot moron scum " * 2000), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", 9.0) for i, t, _ in rows] + [(i, t, None, None) for i, t in extra], "doc_id long, text string, lang string, score double").repartition(2)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(5, None), (None, 1), (7, rows[7][2])], "doc_id long, toxic int")
    model = op02_toxicity.train(docs.select("doc_id", "text"), labels)
    out = op02_toxicity.toxicity(docs, model).withColumn("held", op02_toxicity.held_out(op02_toxicity.F.col("row.doc_id"))).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: x for i, _, x in rows}
    for r in out:
        if r.row.doc_id is not None:
            assert r.held == (zlib.crc32(str(r.row.doc_id).encode()) % 5 == 0)
    unseen = [r for r in out if r.held and r.row.doc_id in truth]
    right = sum(truth[r.row.doc_id] == r.predicted for r in unseen)
    assert len(unseen) > 100 and right / len(unseen) > 0.95
    assert next(r.predicted for r in out if r.row.doc_id == 2002) == 1 and next(r.predicted for r in out if r.row.doc_id == 2001) == 0


def test_held_out_labels_change_nothing(spark):
    rows = _toxic_docs(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, x ^ flip if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, _, x in rows], "doc_id long, toxic int")
        scores.append(sorted((r.row.doc_id, r.score) for r in op02_toxicity.toxicity(docs, op02_toxicity.train(docs, labels)).collect()))
    assert scores[0] == scores[1]


def test_too_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine words")], "doc_id long, text string")
    model = op02_toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    score = {r.row.doc_id: r.score for r in op02_toxicity.toxicity(docs, model).collect()}
    assert score[1] > 0.5 > score[2]
    assert op02_toxicity.toxicity(docs.limit(0), model).collect() == []


def test_isotonic_rises_and_trees_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x[:, 1] + 0.3 * rng.normal(size=500) > 0.5).astype(float)
    model = boosting.grow(x, y)
    margin = model.margin(x)
    assert ((margin > 0) == y).mean() > 0.93
    xs, ys = boosting.isotonic(margin, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()


ODD_COLUMNS = "`my col` int, `a.b` string, `x:y` double, a_map map<string,int>, row int, id string, packed int, bucket long, kind int, score int, words int, n int, url2 string"


@pytest.mark.parametrize("operator", ["licences", "toxicity", "near", "mix", "mixture", "substrings", "leaks"])
def test_odd_columns(spark, operator):
    from lodestar.llm import op01_licences, op05_minhash, op09_substrings, op10_decontaminate

    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(i, text, "s", 1, "x", 0.5, {"a": 1}, 1, "i", 2, 3, 4, 5, 6, 7, "u") for i in (1, 2)], f"doc_id long, text string, source string, {ODD_COLUMNS}")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, text, {"a": 1})], "item_id long, text string, `my col` map<string,int>")
    out = {
        "licences": lambda: op01_licences.licence_scan(docs),
        "toxicity": lambda: op02_toxicity.toxicity(docs, op02_toxicity.train(docs, labels)),
        "near": lambda: op05_minhash.near_duplicates(docs),
        "mix": lambda: op06_mix.mix(docs),
        "mixture": lambda: op06_mix.mixture(docs),
        "substrings": lambda: op09_substrings.substring_dedup(docs),
        "leaks": lambda: op10_decontaminate.leaks(docs, items),
    }[operator]().collect()
    assert len(out) >= 2
    if "row" in out[0]:
        assert all(r.row["my col"] == 1 and r.row["a.b"] == "x" and r.row["a_map"] == {"a": 1} for r in out)


def test_odd_columns_of_other_tables(spark):
    vectors = spark.createDataFrame([(i, [1.0, 2.0], 1, "x", {"a": 1}, 7, 8) for i in (1, 2)], "vec_id long, embedding array<double>, `my col` int, `a.b` string, a_map map<string,int>, id int, vec int")
    assert [r.component_id for r in op03_embeddings.embedding_links(vectors).collect()] == [1, 1]
    pages = spark.createDataFrame([(i, "http://a/", "x", 1, "x", {"a": 1}, 7) for i in (1, 2)], "page_id long, url string, html string, `my col` int, `a.b` string, a_map map<string,int>, row int")
    assert len(op08_urls.filter_urls(pages).collect()) == 2
    assert sorted(r.refers_to or 0 for r in op07_warc.read_captures(op07_warc.write_warc(pages)).collect()) == [0, 1]
    log = spark.createDataFrame([(1, t, "user", "x", 1, "x", {"a": 1}, 7) for t in (0, 1)], "conv_id long, turn long, role string, text string, `my col` int, `a.b` string, a_map map<string,int>, row int")
    assert [r.n_turns for r in op04_chat.format_chats(log).collect()] == [2]


def _plain_features(text, learned):
    """The dense features of one text, told word by word."""
    raw = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    word = lambda data: [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", data)]
    spans = word(lower)
    words = [lower[a:b] for a, b in spans]
    insults, persons = ({w.encode() for w in ws} for ws in (op02_toxicity.INSULTS, op02_toxicity.SECOND_PERSON))
    weight = [max([learned.get((w, None), 0.0), *(learned.get((w[:n], n), 0.0) for n in op02_toxicity.STEMS if len(w) > n)]) for w in words]
    fixed = [w in insults for w in words]
    hits = [i for i in range(len(words)) if weight[i] > 0 or fixed[i]]
    you = [i for i, w in enumerate(words) if w in persons]
    near = sum(any(abs(i - j) <= op02_toxicity.NEAR for j in you) for i in hits)
    looks = lower.translate(bytes.maketrans(b"@$013457", b"asoieast"))
    odd = [(a, b, sum(lower[i] != looks[i] for i in range(a, b))) for a, b in word(looks)]
    odd = [(a, b, m) for a, b, m in odd if m]
    hidden = sum(looks[a:b] in insults or (looks[a:b], None) in learned for a, b, _ in odd)
    n, size = max(len(words), 1), max(len(raw), 1)
    again = sum(i >= 2 and lower[i] == lower[i - 1] == lower[i - 2] and bool(re.match(rb"[0-9a-z\x80-\xff]", lower[i : i + 1])) for i in range(len(lower)))
    return [
        sum(weight) / n, sum(w > 0 for w in weight) / n, sum(w > 0 for w in weight), max([weight[i] for i in hits], default=0), sum(fixed) / n, sum(fixed), near, near / max(len(hits), 1),
        sum(65 <= c <= 90 for c in raw) / size, sum(b - a >= 3 and all(65 <= c <= 90 for c in raw[a:b]) for a, b in spans) / n, raw.count(b"!") / size, raw.count(b"?") / size,
        sum(c in b"#$%&*@^~" for c in raw) / size, sum(48 <= c <= 57 for c in raw) / size, again / size, sum(b - a - m > 1 for a, b, m in odd) / n, hidden, math.log1p(len(words)), min(len(raw) / n, 50),
    ]


def test_toxicity_features_are_those_of_a_plain_version():
    rng = random.Random(21)
    some = ["you", "idiot", "Id10t", "m0ron", "SHOUT", "blargish", "blarg", "fine", "w@tch", "aaargh", "!!", "??", "$$$", "123", "é", "Tú", "loooser", "DU"]
    texts = [None, "", "!", "you IDIOT", "id1ot", "aaa", *(" ".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(60))]
    learned = {(b"blarg", None): 2.5, (b"blar", 4): 1.5, (b"fine", None): 0.5, (b"aaarg", 5): 3.0}
    from lodestar.llm.textbytes import byte_sums, span_hash

    def term(word, size):
        one = texts_of(pa.array([word.decode()]))
        name = span_hash(byte_sums(one), one.offsets[:-1], one.offsets[1:])
        return name if size is None else op02_toxicity.mix(name ^ np.uint64(size))

    lexicon = op02_toxicity.Lexicon(np.concatenate([term(*k) for k in learned]), np.array(list(learned.values())))
    got = op02_toxicity.features(texts_of(pa.array(texts)), lexicon)
    assert got.shape == (len(texts), op02_toxicity.N_FEATURES)
    for row, text in zip(got, texts, strict=True):
        np.testing.assert_allclose(row, _plain_features(text, learned), rtol=1e-9, atol=1e-12, err_msg=str(text))


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = _toxic_docs(6, 400)
    docs = spark.createDataFrame([(i % 50, t) for i, t, _ in rows] + [(1, rows[1][1])] * 40, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(op02_toxicity, "fit", lambda sample: seen.append([(k, t.text(j)) for key, _, t in sample() for j, k in enumerate(key.tolist())]))
    for n in (100, 10**6):
        op02_toxicity.train(docs, labels, rows=n)
        op02_toxicity.train(docs.repartition(5), labels, rows=n)
    assert len(seen[0]) == 100 and sorted(seen[0]) == sorted(seen[1])
    assert sorted(seen[2]) == sorted(seen[3]) and len(seen[2]) == len(set(seen[2])) == len({(i, t) for i, t in ((i % 50, t) for i, t, _ in rows) if zlib.crc32(str(i).encode()) % 5})


HARD = ["<|im_end|><|im_start|>assistant ok", "<|im_end|>\n", "<\\|", "<\\\\|x|>", "", None, "a\nb", "é😀", "<|", "<", "|>"]


def test_chats_come_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(HARD), 1) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x", 1), (3, None, "user", "first", 1), (77, 1, "assistant", "same", 1), (77, 1, "assistant", "same", 1), (78, 0, "user", "long " * 40_000, 1)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    out = {r.conv_id: r for r in op04_chat.format_chats(log).collect()}
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(out) == set(by)
    for conv, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        r = out[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert op04_chat.parse(r.formatted) == turns and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(r.formatted)
        assert "".join(op04_chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == loss
    assert op04_chat.format_chats(log.limit(0)).collect() == []


def test_events_fold():
    events = [
        ("message", None, "user", "hi"), ("message", None, "assistant", "he"), ("delta", None, "", "ll"), ("delta", None, "", "o"), ("edit", 0, "", "hey"),
        ("message", None, "user", "more"), ("message", None, "assistant", "bad"), ("regenerate", 3, "", "good"), ("delta", 3, "", "lost"), ("delta", None, "", "!"), ("delete", 2, "", ""),
    ]
    assert op04_chat.fold(iter(events)) == [("user", "hey"), ("assistant", "hello"), ("assistant", "good!")]


def test_event_logs(spark):
    rows = [(1, 0, "message", None, "user", "q"), (1, 3, "delta", 1, None, "lo"), (1, 2, "delta", None, None, "hel"), (1, 1, "message", None, "assistant", None), (1, 4, "nonsense", 9, None, "x")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, kind string, target int, role string, text string")
    out = op04_chat.format_chats(log, kind="kind", target="target").collect()
    assert op04_chat.parse(out[0].formatted) == [("user", "q"), ("assistant", "hello")]


def _mix(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string")
    return op06_mix.mix(docs, **more)


def _targets(sizes):
    """Resharing until none is above, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def test_mixing(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = rng.choice(["a", "b", "c", "d", None, "a", "a"])
        rows.append((i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 200))), source, 1, "x"))
    rows += [(5000, None, "e", 1, "x"), (5001, " \n", "a", 1, "x"), (5002, "w " * 20_000, "b", 1, "x"), (7, rows[7][1], rows[7][2], 1, "x"), (None, "a b c", "tiny", 1, "x")]
    out = _mix(spark, rows).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    taken = {s: 0 for s in sizes}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(r.size for r in out) == sum(sizes.values())
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.02 * want[s] + op06_mix.BLOCK, s
    assert sorted(map(str, out)) == sorted(map(str, _mix(spark, rows[::-1]).repartition(3).collect()))
    assert _mix(spark, []).collect() == []


def test_shard_counts_are_multinomial(spark):
    sizes = {"a": 40_000, "b": 9000, "c": 30_000, "d": 1000}
    rows = spark.createDataFrame([(f"={s}", s, n) for s, n in sizes.items()], "key string, source string, size long")
    planned = op06_mix.plan(rows, 4)
    quota = {r.key: r.slots for r in planned.collect()}
    total, m = sum(quota.values()), 100
    counts = [r.asDict() for r in op06_mix.shard_counts(planned, m, seed=3).collect()]
    shards = total // m  # a last one may be short
    for key, q in quota.items():
        p = q / total
        drawn = np.zeros(shards)
        for r in counts:
            if r["key"] == key and r["shard"] < shards:
                drawn[r["shard"]] = r["n"]
        assert abs(drawn.mean() - m * p) < 4 * math.sqrt(m * p * (1 - p) / shards)
        ratio = drawn.var() / (m * p * (1 - p))
        assert abs(ratio - 1) < 5 * math.sqrt(2 / shards), (key, ratio)
    slots = op06_mix.draw(planned, m, seed=3).collect()
    assert sorted((r.shard, r.slot) for r in slots) == [(i // m, i % m) for i in range(total)]
    for key, q in quota.items():
        times = {}
        for r in slots:
            if r.key == key:
                times[r.block] = times.get(r.block, 0) + 1
        n = -(-sizes[key[1:]] // 4)
        assert sum(times.values()) == q and max(times.values()) <= 3 and set(times) <= set(range(n))
        assert max(times.values()) - min(times.get(b, 0) for b in range(n)) <= 1
    # settling the totals leaves the shards' counts close to what was drawn
    kept = {(r["shard"], r["key"]): r["n"] for r in counts}
    for r in slots:
        kept[r.shard, r.key] = kept.get((r.shard, r.key), 0) - 1
    assert sum(map(abs, kept.values())) <= 2 * sum(abs(sum(r["n"] for r in counts if r["key"] == k) - q) for k, q in quota.items())


def test_mixture_is_what_documents_give(spark):
    rng = random.Random(8)
    rows = [(i, " \t".join(f"d{i}w{k}" for k in range(rng.randrange(0, 90))), rng.choice("aab"), 1, "x") for i in range(120)] + [(None, None, None, 1, "x"), (3, "same id", "a", 1, "x"), (500, "long " * 5000, "c", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string")
    out = op06_mix.mixture(docs, block=16, shard_slots=64).collect()
    texts = {}
    for i, t, _, _, _ in rows:
        texts.setdefault(i, []).append((t or "").split())
    slots, given = {}, {}
    for r in out:
        assert any(" ".join(w[r.first_word : r.first_word + r.n_words]) == r.text for w in texts[r.doc_id]), r
        slots.setdefault((r.shard, r.slot), []).append(r)
        given[r.doc_id] = given.get(r.doc_id, 0) + r.n_words
    for pieces in slots.values():
        pieces.sort(key=lambda r: r.offset)
        assert len({(r.source, r.block, r.turn) for r in pieces}) == 1 and pieces[0].offset == 0
        assert all(a.offset + a.n_words == b.offset for a, b in zip(pieces, pieces[1:]))
        assert pieces[-1].offset + pieces[-1].n_words <= 16
    digest = op06_mix.mix(docs, block=16, shard_slots=64, with_pieces=True).collect()
    taken = {}
    for r in digest:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        assert r.taken == sum(p.n_words for p in r.pieces or [])
    assert {k: v for k, v in taken.items() if v} == given


def test_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(op06_mix.permute(op06_mix.F.col("id"), op06_mix.F.lit(n), op06_mix.F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def test_warc(spark):
    pages = [(4, "http://a/b?c", "<p>é</p>"), (2, "http://a/x", "<p>é</p>"), (3, None, None), (9, "http://e", ""), (5, "http://q%0A\n", "one"), (6, "u", "x" * 300_000), (2, "http://again", "<p>é</p>"), (None, "n", "one")]
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages], "page_id long, url string, html string, number string").repartition(3)
    out = op07_warc.read_captures(op07_warc.write_warc(df, size=1000)).collect()
    assert len(out) == len(pages)
    for r in out:
        html = next((h or "").encode() for i, u, h in pages if i == r.page_id and (u or "") == r.response.url)
        same = [i for i, _, h in pages if (h or "").encode() == html and i is not None]
        assert r.response.payload_bytes == len(html) and r.response.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        if r.response.kind == "response":
            assert bytes(r.response.payload) == html and r.page_id == min(same) and r.refers_to is None
        else:
            assert r.response.payload is None and r.refers_to == min(same)
        assert r.request.url == r.response.url and r.metadata.page == r.page_id
    assert sum(r.response.kind == "response" for r in out) == 4
    plain = op07_warc.read_captures(op07_warc.write_warc(df, least=1)).collect()
    assert sum(r.response.kind == "response" for r in plain) == 5
    assert op07_warc.read_captures(op07_warc.write_warc(df.limit(0))).collect() == []


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme/path": ("", "", None, "allow"),
        "HTTP://WWW.Example.NET/en/x?y#z": ("www.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://example.net?x=/": ("example.net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "http://a.org/fr/casino": ("a.org", "/fr/casino", "org/fr/", "allow"),
        "http://a.io/best-casino/": ("a.io", "/best-casino/", None, "block"),
        "http://a.io/casinoroyal": ("a.io", "/casinoroyal", None, "allow"),
        "http://a.io/free/free": ("a.io", "/free/free", None, "allow"),
        "http://a.io/free/Download": ("a.io", "/free/Download", None, "allow"),  # 1 + 1
        "http://a.io/free/Poker": ("a.io", "/free/Poker", None, "block"),  # 1 + 2
        "http://a.io/poker/poker": ("a.io", "/poker/poker", None, "allow"),
        "http://a.io/" + "x" * 100_000 + "/poker/" + "y/" * 1000 + "cheap": None,
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    cases = {u: x or ("a.io", u[len("http://a.io") :], None, "block") for u, x in cases.items()}
    for most in (op08_urls.MOST_ENTRIES, 2):  # terms and rules in one part, or in many
        rows = op08_urls.filter_urls(df.union(df), most=most).collect()
        assert len(rows) == 2 * len(cases)
        assert {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == dict(enumerate(cases.values()))
    assert not set(op08_urls.STRICT) & set(op08_urls.SOFT) and max(op08_urls.SOFT.values()) < op08_urls.LIMIT
    assert op08_urls.filter_urls(df.limit(0)).collect() == []


def test_quantised_texts_of_null():
    assert len(texts_of(pa.array([None, ""], pa.string()))) == 2


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, tmp_path, empty):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [(i, t) for i, t, _ in _toxic_docs(4, 250)]
    labels = [(i, x) for i, _, x in _toxic_docs(4, 250)]
    item = " ".join(f"bench{rng.randrange(999)}" for _ in range(20))
    second = " ".join(f"second{k}" for k in range(20))
    passage = " ".join(f"pass{k}" for k in range(30))
    ten = " ".join(f"ten{k}" for k in range(10))
    clean = [(1000 + i, " ".join(f"v{rng.randrange(9999)}" for _ in range(60))) for i in range(20)]
    texts += clean + [(2000, clean[0][1]), (2001, clean[1][1].replace("v1", "v1", 1)), (3000, f"{clean[2][1][:50]} {item} end"), (3001, f"{ten} {passage} c1"), (3002, f"d1 e1 {passage} {ten[::-1]}")]
    texts += [(None, None), (4000, ""), (4001, None), (None, clean[3][1]), (None, f"{clean[4][1][:40]} {second}"), (None, "alone without an id"), (None, "alone without an id")]
    if empty:
        texts = []
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "r", 1, 0.5, 1, 2, "k", 1, 2, 3, {"a": 1}, [({"b": 2},)]) for i, t in texts]
    clashing = "row string, id long, score double, predicted int, class_id long, key string, `my col` int, `a.b` int, `x:y` int, a_map map<string,int>, maps array<struct<m:map<string,int>>>"
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, item), (2, second)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    every = corpus_pipeline.run(spark, str(tmp_path)).collect()
    out = {r.doc_id: r for r in every}
    if empty:
        assert out == {}
        return
    assert 2000 not in out and 2001 not in out and 3000 not in out
    assert sorted(r.size for r in every if r.doc_id is None) == [0, 4]  # the copy, the leak and the twin are gone
    assert all(r.taken == sum(p.n_words for p in r.pieces or []) for r in every)
    assert {i for i, _ in clean} <= set(out) and {3001, 3002, 4000, 4001, None} <= set(out)
    assert out[3001].size == 41 and out[3002].size == 12
    gone = {i for i, x in labels if i not in out and x}
    assert len(gone) > 0.8 * sum(x for _, x in labels)


def test_every_stage_does_what_plain_versions_do(spark, tmp_path):
    import corpus_pipeline
    from brute import jaccard, lower_words, shingles, substring_dedup

    rng = random.Random(41)
    texts = [(i, t, x) for i, t, x in _toxic_docs(5, 160)]
    base = [f"b{rng.randrange(10**6)}" for _ in range(60)]
    item = " ".join(f"bench{k}" for k in range(25))
    passage = " ".join(f"pass{k}" for k in range(22))
    for k in range(6):  # near copies, some beyond the threshold
        near = list(base)
        for _ in range(k):
            near[rng.randrange(60)] = f"e{k}"
        texts.append((500 + k, " ".join(near), 0))
    texts += [(600 + k, " ".join([*(f"o{k}x{j}" for j in range(9)), passage, f"end{k}"]), 0) for k in range(4)]
    texts += [(700, f"before it {item} and after", 0), (701, item.replace("bench3 ", "other "), 0), (702, "bench1 bench2", 0)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t, _ in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x) for i, _, x in texts], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else None
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = given, {r.doc_id: r for r in docs.collect()}

    given, out = seen["toxicity"]
    model = op02_toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    ids = sorted(given)
    score = model.score(texts_of(pa.array([given[i] for i in ids])))
    assert set(out) == {i for i, s in zip(ids, score, strict=True) if s < 0.5} and set(range(500, 506)) <= set(out)

    given, out = seen["near_dedup"]
    sets = {i: shingles(t) for i, t in given.items()}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert set(out) == {i for i, c in classes(sets, links).items() if i == c} and len(out) < len(given)

    given, out = seen["substring_dedup"]
    left = substring_dedup(list(given.items()))
    for i, t in given.items():
        assert out[i].text == t if not left[i][1] else hashlib.sha256(out[i].text.encode()).hexdigest() == left[i][2]
        assert out[i].n_chars == len(out[i].text)
    assert sum(x[1] > 0 for x in left.values()) >= 3

    given, out = seen["decontaminate"]
    own, width = lower_words(item), 25

    def holds(text):
        w = lower_words(text)
        return any(jaccard(shingles(item), shingles(" ".join(w[max(s, 0) : s + width]))) >= 0.8 for s in range(1 - width, len(w)) if len(w[max(s, 0) : s + width]) >= 5)

    assert set(out) == {i for i, t in given.items() if not holds(t)} and len(own) == width and 700 not in out

    given, out = seen["mix"]
    sizes = {}
    for i, t in given.items():
        sizes[out[i].source] = sizes.get(out[i].source, 0) + len(t.split())
    want = _targets(sizes)
    for i, r in out.items():
        assert r.size == len(given[i].split()) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-9
    for s, n in want.items():
        assert abs(sum(r.taken for r in out.values() if r.source == s) - n) <= 0.02 * n + op06_mix.BLOCK
