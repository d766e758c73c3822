import random
from collections import Counter

import numpy as np
import pyarrow as pa

from siftwell.llm import dart_minhash as M
from siftwell.llm.common import flat
from siftwell.llm.components import components

P = M.Params()


def shingles(text):
    w = [x.lower() for x in (text or "").split()]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(rows):
    """Least id of each connected component over all pairs of similarity 0.8."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    rows = [(i, t) for i, t in rows if shingles(t)]
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if similarity(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.random()}"
    return " ".join(out)


def texts():
    rng = random.Random(3)
    out = [None, "", "   ", "one two", "one two", "ONE Two", "a b c d e", "x " * 50, "x " * 48]
    for size in (12, 60, 300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        out += [near(rng, words, rng.randrange(0, max(2, size // 25))) for _ in range(40)]
        passage = words[: size // 2]
        out += [" ".join(passage + [f"v{rng.randrange(10**6)}" for _ in range(size // 2)]) for _ in range(30)]
    return out


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    words = rng.choice(1000, 400)
    a, b = [" ".join(map(str, x)) for x in (words, np.concatenate([words[:330], rng.choice(5000, 70)]))]
    h, row, _ = M.shingles(*flat(pa.array([a, b])), 5)
    sig = M.signatures(*M.weights(h, row), 2, 4096)
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - similarity(a, b)) < 0.03
    assert abs(M.jaccard(pa.array([a, a]), pa.array([b, a]), P) - [similarity(a, b), 1]).max() < 1e-12


def test_signatures_of_real_weights():
    rng = np.random.default_rng(2)
    h = np.tile(rng.integers(0, 2**63, 80).astype(np.uint64), 2)
    weight = np.concatenate([rng.exponential(5, 80), rng.exponential(5, 80)]) + 0.01
    sig = M.signatures(h, np.repeat([0, 1], 80), weight, 2, 8192)
    a, b = weight.reshape(2, 80)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert M.signatures(h[:0], np.zeros(0, np.int64), weight[:0], 2, 8).sum() == 0


def test_classes(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, i, "s") for i, t in rows], "doc_id long, text string, class_id long, bands string").repartition(3)
    got = {r.doc_id: r.class_id for r in M.classes(df).collect()}
    assert got == brute(rows)
    for p in (M.Params(run=8, longest=8, outside=7, main=9, longest_text=400),):
        assert {r.doc_id: r.class_id for r in M.classes(df, p).collect()} == got


def test_cases(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in M.classes(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 2), (None, None)]
    assert M.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def same_as_brute(spark, texts, p):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in M.classes(df, p).collect()} == brute(rows)


def test_base_text_after_copies_that_differ(spark):
    """Copies are similar to their base (0.82) and not to each other (0.69): each needs its own link to the base."""
    words = [f"w{i}" for i in range(300)]
    copies = []
    for k in range(60):
        out = list(words)
        for at in random.Random(k).sample(range(6, 294, 6), 6):
            out[at] = f"edit{k}-{at}"
        copies.append(" ".join(out))
    assert all(similarity(" ".join(words), c) >= 0.8 for c in copies)
    assert sum(similarity(a, b) >= 0.8 for a, b in zip(copies, copies[1:])) == 0
    same_as_brute(spark, [*copies, " ".join(words)], M.Params(bands=4, band=1, outside=7, main=7))  # many tiles a bucket


def test_link_between_followers(spark):
    """Two groups of copies (0.95 of their centre) that only the link of their centres (0.84) joins."""
    rng = random.Random(1)

    def edited(words, places, mark):
        out = list(words)
        for at in places:
            out[at] = f"{mark}-{at}"
        return out

    one = [f"w{i}" for i in range(400)]
    changed, places = range(6, 84, 12), list(range(102, 390, 6))
    two = edited(one, changed, "two")
    rows = [" ".join(x) for x in (one, two)]
    for k in range(200):
        rows += [" ".join(edited(c, rng.sample(places, 2), f"edit{k}{j}")) for j, c in enumerate((one, two))]
    assert similarity(rows[0], rows[1]) >= 0.8 > similarity(rows[0], rows[3])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert {r.class_id for r in M.classes(df).collect()} == {0}
