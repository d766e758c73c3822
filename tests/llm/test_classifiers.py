"""Held-out accuracy, and the cases that every classifier must stand."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from siftwell.llm import common, compression_quality, language_id, toxicity

DATA = "/root/testdata/sf0.01"
QUERIES = {"quality": compression_quality.op4_compression_quality, "toxic": toxicity.op7_toxicity}


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize(("label", "least"), [("quality", 0.95), ("toxic", 0.84)])
def test_held_out(spark, label, least):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = QUERIES[label](spark, DATA).join(labels, "doc_id").where("held_out").collect()
    score, y = np.array([r.score for r in got]), np.array([r[label] for r in got])
    assert len(got) > 60 and auc(score, y) > least
    cut = 0.5 if label == "quality" else 0.3
    assert all(r.predicted == (r.score >= cut) and 0 <= r.score <= 1 for r in got)


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = language_id.op8_language_id(spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99
    assert np.mean([r.rejected for r in got if r.lang == r.lang_pred]) < 0.1


ROWS = [(None, None, None, "x"), (1, "", "en", "x"), (2, " \n!? 12", None, "x"), (3, "The and of", "en", "x"), (3, "The and of", "en", "x"), (4, "der die das", "de", "x"), (5, "é" * 200_000, "fr", "x")]


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("labels", [[], [(3, 1, 0), (3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 1), (2, 0, 0)]])
def test_cases(spark, tmp_path, labels):
    sf = tables(spark, tmp_path, ROWS, labels)
    for f in (*QUERIES.values(), language_id.op8_language_id):
        got = f(spark, sf).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id == 3}) == 1
    languages = {r.doc_id: r.lang_pred for r in language_id.op8_language_id(spark, sf).collect()}
    assert languages[None] == languages[1] == languages[2] == "und" and languages[3] != "und"


def test_empty(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    for f in (*QUERIES.values(), language_id.op8_language_id):
        assert f(spark, sf).collect() == []


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts, languages, quality and toxic labels."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    rows = docs.where("text is not null and lang is not null and quality is not null and toxic is not null").orderBy("doc_id").collect()
    return [[r[n] for r in rows] for n in ("text", "lang", "quality", "toxic")]


TEXTS = ["", "x", "The and of - the, and!", "Der die das und", "é" * 50, "word " * 700]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_quality_text_by_text(labelled):
    m = compression_quality.train(labelled[0], labelled[2])

    def size(raw, words):
        d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=5)
        return sum(len(zstandard.ZstdCompressor(level=5, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))

    want = []
    texts = TEXTS + labelled[0][:5]
    for t in texts:
        raw = t.encode()
        x = (size(raw, m.bad) - size(raw, m.good)) / max(1, len(raw))
        z = [(v - c) / s for v, c, s in zip((x, x * math.log(max(1, len(raw)))), m.centre, m.scale)]
        want.append(sigmoid(m.weights[0] + z[0] * m.weights[1] + z[1] * m.weights[2]) if raw else np.mean(labelled[2]))
    assert np.allclose(m.score(*common.flat(pa.array(texts))), want)


def test_language_text_by_text(labelled):
    m, p = language_id.train(labelled[0], labelled[1]), language_id.Params()
    texts = TEXTS + labelled[0][:3]
    best, score = m.predict(*common.flat(pa.array(texts)))
    for t, b, s in zip(texts, best, score):
        low = [c + 32 if 65 <= c <= 90 else c for c in t.encode()]
        x, n = np.zeros(len(m.languages)), 0
        for size in p.grams:
            for i in range(len(low) - size + 1):
                h = 0
                for c in low[i : i + size]:
                    h = (h + c + 1) * (0x9E3779B1 + 2 * size) % 2**32
                # the first byte of a gram enters first, the loop multiplies once a byte
                h = ((h ^ h >> 15) * 0x85EBCA77 % 2**32) >> (32 - p.bits)
                x += m.rows[:, h]
                n += 1
        x = (x / max(1, n) + m.bias) / m.temperature
        e = np.exp(x - x.max())
        assert b == x.argmax() and abs(s - (e / e.sum()).max()) < 1e-5


def test_toxicity_text_by_text(labelled):
    m, p = toxicity.train(labelled[0], labelled[3]), toxicity.Params()
    byte = [int(x) for x in np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)]
    base = pow(common.Rolling.BASE, 1, 2**64)

    def code(word):
        h = (sum(byte[c] * pow(base, i, 2**64) for i, c in enumerate(word)) + len(word)) % 2**64
        return int(common.mix64(np.array([h], np.uint64))[0])

    names = sorted(toxicity.FUNCTION_WORDS)
    of = {}
    for i, k in enumerate(names):
        of |= {code(w.encode()) >> (64 - p.bits): i for w in toxicity.FUNCTION_WORDS[k].split()}
    texts = TEXTS + labelled[0][:3]
    got = m.score(*common.flat(pa.array(texts)))
    for t, s in zip(texts, got):
        words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())]
        e = [m.table[code(w) >> (64 - p.bits)] + sum((m.table[(code(w[:k]) * (2 * k + 1) % 2**64) >> (64 - p.bits)] for k in p.prefixes if len(w) > k), np.zeros(p.dims)) for w in words]
        best, k = [], 0
        for width in p.widths:
            at = [sum(e[i + j] @ m.filters[:, (k + j) * p.filters : (k + j + 1) * p.filters] for j in range(width) if i + j < len(e)) for i in range(len(e))]
            best.append(np.max(at, 0) if at else np.zeros(p.filters))
            k += width
        x = np.maximum(np.concatenate(best) + m.shift, 0) @ m.layer + m.bias
        hits = [of[h] for w in words if (h := code(w) >> (64 - p.bits)) in of]
        lang = max(range(len(names)), key=lambda i: (hits.count(i), -i)) if hits else len(names)
        assert abs(s - sigmoid(x - m.cut[lang] + math.log(p.threshold / (1 - p.threshold)))) < 1e-4


def test_sample(spark):
    rows = [(i, f"text {i} " * 20, "en") for i in range(200)] + [(500, "long " * 100_000, "en"), (600, "zwei", "de"), (600, "eins", "en"), (600, "eins", None), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = common.labelled_sample(docs.where("lang is not null"), docs.select("doc_id"), 300, 64_000).to_pylist()
    assert sorted(r["doc_id"] for r in found) == [*range(200), 500, 600]
    by = {r["doc_id"]: r for r in found}
    assert len(by[500]["text"]) == 1000 and (by[600]["text"], by[600]["lang"]) == ("eins", "en")
    few = common.labelled_sample(docs, docs.select("doc_id"), 50, 64_000)
    assert 45 <= len(few) <= 50


def test_columns_are_not_overwritten(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, Score string")
    for f in (compression_quality.quality, toxicity.toxicity):
        with pytest.raises(ValueError, match="score"):
            f(docs, None)
        assert f(docs, None, "other").first()["Score"] == "b"
    with pytest.raises(ValueError, match="text"):
        language_id.languages(docs, None, "text")


def test_toxicity_scores_in_small_steps(labelled):
    """A slice of 2 MB at once took over 100 MB."""
    import tracemalloc

    m = toxicity.train(labelled[0], labelled[3])
    some = [*labelled[0][:20], ""]
    texts = some * -(-(2 << 20) // len("".join(some).encode()))
    each = [m.score(*common.flat(pa.array([t], pa.large_string())))[0] for t in some]
    data, at = common.flat(pa.array(texts, pa.large_string()))
    common.POWERS.clear()
    tracemalloc.start()
    got = m.score(data, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, np.tile(each, len(texts) // len(some)), atol=1e-5)
    assert peak < 80 << 20
