"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

LOWER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def lower_words(text):
    return LOWER_WORD.findall((text or "").translate(AZ))


def shingles(text, width=5):
    w = lower_words(text)
    return Counter(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if common else 0.0


def classes(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def substring_dedup(docs, width=20):
    """docs: [(doc_id, text)] of distinct ids -> {doc_id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc] = len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out
