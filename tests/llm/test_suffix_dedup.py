import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from siftwell.llm import suffix_dedup as S


def brute(rows, length, mode):
    """rows: (doc_id, text). Gives doc_id -> (n_bytes, n_removed, n_spans, kept)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    places = defaultdict(list)
    for k, (i, b) in enumerate(raw):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((i, p, k))
    gone = [bytearray(len(b)) for _, b in raw]
    for found in places.values():
        found.sort()
        for i, p, k in found if mode == "all" and len(found) > 1 else [f for f in found if f[:2] != found[0][:2]] if mode == "first" else []:
            gone[k][p : p + length] = b"\1" * length
    out = {}
    for (i, b), g in zip(raw, gone, strict=True):
        spans = sum(1 for p, x in enumerate(g) if x and (p == 0 or not g[p - 1]))
        out[i] = (len(b), sum(g), spans, bytes(x for x, y in zip(b, g, strict=True) if not y))
    return out


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(30), prose(150)
    out = [None, "", "short", "short", base, base, "z" * 700, "ab" * 300, "x" + "z" * 199, base[:150], passage + passage]
    for _ in range(25):
        out.append(prose(rng.randrange(0, 60)) + passage + prose(rng.randrange(0, 60)))
        words = base.split(" ")
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
        out.append(base[: rng.randrange(100, 400)] + prose(20) + base[rng.randrange(400) :])
        out.append(prose(40))
    return out


@pytest.mark.parametrize(("mode", "most"), [("all", S.BLOCK), ("all", 700), ("first", S.BLOCK), ("first", 700)])
def test_against_every_window(spark, mode, most):
    rows = [(3 * i % 1000, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k1 int, cut string").repartition(3)
    got = {r.doc_id: (r["c"].n_bytes, r["c"].n_removed, r["c"].n_spans, bytes(r["c"].kept)) for r in S.kept(df.select("doc_id", "text"), 200, mode, most).withColumnRenamed("cut", "c").collect()}
    assert got == brute(rows, 200, mode)


def test_longest_factors():
    rng = np.random.default_rng(4)
    for letters in (1, 2, 4):
        data = rng.integers(97, 97 + letters, 400).astype(np.uint8)
        data[250:330] = data[20:100]
        window = np.arange(len(data) - 40 + 1)
        raw = data.tobytes()

        def lcp(i, j):
            n = 0
            while n < 40 and raw[i + n] == raw[j + n]:
                n += 1
            return n

        for later in (False, True):
            got = S.longest_factors(data, window, 40, later)
            want = [max([lcp(i, j) for j in (range(i + 1, len(window)) if later else range(i))], default=0) for i in window]
            # lengths short of the depth come in steps of eight bytes
            assert [min(x, 40) // 8 for x in got] == [x // 8 for x in want]
    assert S.smaller(np.array([3, 1, 2, 5, 4, 0])).tolist() == [-1, -1, 1, 2, 2, -1]


def test_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long), (2, long[:150_000] + "#" + long[-500:]), (3, "x" + long[1000:1300])]
    got = {r.doc_id: (r.cut.n_removed, r.cut.n_spans) for r in S.kept(spark.createDataFrame(rows, "doc_id long, text string"), mode="first").collect()}
    assert got == {1: (0, 0), 2: (150_500, 2), 3: (300, 1)}


def test_cases(spark):
    long = "abc " * 100 + "end"
    df = spark.createDataFrame([(None, "q" * 150 + "r" * 150), (1, long), (1, long), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.cut.n_removed, r.cut.n_spans) for r in S.kept(df).collect()), key=str)
    assert got == [(1, 403, 1), (1, 403, 1), (2, 0, 0), (None, 0, 0)]
    assert S.kept(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_digest(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in rows], 200, "all")
    got = S.op6_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in want.items()}
