"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of ASCII letters, digits and non-ASCII bytes, ASCII lowered) embeds as the sum of the rows of its hash and
of the hashes of its prefixes; buckets seen in too few training texts share a zero row. Filters one, two and three words
wide slide over the text, each keeps its maximum, and a logistic layer follows. One embedding dimension starts as the
bucket's smoothed log odds. Scoring adds up, for every word, precomputed filter responses of its buckets, so a text is
read whole at any length.

Thresholds are calibrated by language: set-aside texts of each language (guessed from the text's function words) give
the logit that best parts the classes, and scores are shifted to put it at `Params.threshold`.

Null and empty texts score what a text without words scores. Repeated rows score alike; columns besides doc_id and text
stay as they are, and one with the result's name is refused; with no label of both classes every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, POWERS, Rolling, added, flat, in_fold, labelled_sample, read, slices, tidy, words_of, worker_path

# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den auf für als",
    "en": "the of and to in is that it for was with as on be this",
    "es": "el los las de que y en un una por con para se del al",
    "fr": "le la les des et est une dans pour que qui sur pas du au",
}


@dataclass
class Params:
    bits: int = 15
    prefixes: tuple[int, ...] = (4, 5, 7)
    dims: int = 8
    filters: int = 6
    widths: tuple[int, ...] = (1, 2, 3)
    #: Bounds of the training sample, of each class and in all.
    max_rows: int = 1500
    max_bytes: int = 10 << 20
    #: A bucket needs so many training texts to have a row of its own.
    least_texts: int = 4
    epochs: int = 5
    batch: int = 32
    rate: float = 0.15
    threshold: float = 0.3
    seed: int = 11


#: Text bytes handled at once: words and filter responses take some hundred bytes for each.
STEP_BYTES = 256 << 10

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets(data: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + prefixes) bucket numbers, 2^bits for a prefix that is the whole word; and each word's row."""
    start, end, row = words_of(data, at, SEPARATOR)
    h = Rolling(LOWER[data])
    out = np.full((len(start), 1 + len(p.prefixes)), 1 << p.bits, np.int32)
    out[:, 0] = h(start, end) >> np.uint64(64 - p.bits)
    for i, k in enumerate(p.prefixes, 1):
        long = np.flatnonzero(end - start > k)
        out[long, i] = (h(start[long], start[long] + k) * np.uint64(2 * k + 1)) >> np.uint64(64 - p.bits)
    return out, row


def guesses(words: np.ndarray, row: np.ndarray, rows: int, p: Params) -> np.ndarray:
    """The number of the language whose function words are most frequent in each text; without any, the number of languages."""
    names = sorted(FUNCTION_WORDS)
    table = np.full((1 << p.bits) + 1, len(names), np.int8)
    for i, k in enumerate(names):
        listed = FUNCTION_WORDS[k].split()
        data, at = flat(pa.array(listed))
        table[buckets(data, at, p)[0][:, 0]] = i
    which = table[words[:, 0]].astype(np.int64)
    hit = which < len(names)
    counts = np.bincount(row[hit] * len(names) + which[hit], minlength=rows * len(names)).reshape(rows, len(names))
    return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(names)) if rows else np.zeros(0, np.int64)


def pooled(response: np.ndarray, row: np.ndarray, rows: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Each text's maximum of every filter, and all filters' values. response: (words, positions * filters)."""
    f, out, k = p.filters, [], 0
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    for w in p.widths:
        z = response[:, k * f : (k + 1) * f].copy()
        ends = last.copy()
        inside = np.flatnonzero(~ends)
        for j in range(1, w):
            z[inside] += response[inside + j, (k + j) * f : (k + j + 1) * f]
            inside = inside[~last[inside + j]]
        out.append(z)
        k += w
    z = np.concatenate(out, 1)
    best = np.zeros((rows, z.shape[1]), z.dtype)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    if len(first):
        best[row[first]] = np.maximum.reduceat(z, first, axis=0)
    return best, z


@dataclass
class Model:
    params: Params
    table: np.ndarray
    filters: np.ndarray  # (dims, positions * filters)
    shift: np.ndarray
    layer: np.ndarray
    bias: float
    #: Logit at which texts of each guessed language (and of none) count as toxic.
    cut: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    ready: np.ndarray | None = None

    def logits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, rows = self.params, len(at) - 1
        if self.ready is None:
            self.ready = (self.table @ self.filters).astype(np.float32)
        words, row = buckets(data, at, p)
        response = self.ready[words[:, 0]]
        for i in range(1, words.shape[1]):
            own = np.flatnonzero(words[:, i] < 1 << p.bits)
            response[own] += self.ready[words[own, i]]
        best, _ = pooled(response, row, rows, p)
        return np.maximum(best + self.shift, 0) @ self.layer + self.bias, guesses(words, row, rows, p)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        t, out, i = self.params.threshold, np.zeros(len(at) - 1), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
            x, lang = self.logits(data[at[i] : at[j]], at[i : j + 1] - at[i])
            out[i:j] = 1 / (1 + np.exp(-np.clip(x - self.cut[lang] + np.log(t / (1 - t)), -40, 40)))
            i = j
        return out


def train(texts: list[str], labels: list[int], p: Params | None = None) -> Model | None:
    """None unless there are texts of both classes."""
    p, y = p or Params(), np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(p.seed)
    aside = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    use = np.flatnonzero(~aside)
    words, n, size = [], [], (1 << p.bits) + 1
    held = np.zeros((2, size), np.int64)  # texts of each class that hold a bucket
    for i, j in slices(pa.array(texts, pa.large_string()), STEP_BYTES):
        b, row = buckets(*flat(pa.array(texts[i:j], pa.large_string())), p)
        words.append(b)
        n.append(np.bincount(row, minlength=j - i))
        doc, bucket = np.divmod(np.unique((row[:, None] * size + b)[~aside[i + row]].ravel()), size)
        for c in (0, 1):
            held[c] += np.bincount(bucket[y[i + doc] == c], minlength=size)
    words, n = np.concatenate(words), np.concatenate(n)
    at = np.concatenate([[0], np.cumsum(n)])
    of = [max(1, int((y[use] == c).sum())) for c in (0, 1)]
    odds = np.log((held[1] + 0.5) / (of[1] + 1)) - np.log((held[0] + 0.5) / (of[0] + 1))
    table = rng.normal(0, 0.02, ((1 << p.bits) + 1, p.dims)).astype(np.float32)
    table[:, 0] = np.clip(odds, -3, 5) / 5
    rare = held[0] + held[1] < min(p.least_texts, 1 + len(use) // 50)
    rare[-1] = True
    table[rare] = 0
    positions, f = sum(p.widths), p.filters
    filters = rng.normal(0, 0.1, (p.dims, positions * f)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + np.repeat([1.0 / w for w in p.widths for _ in range(w)], f)
    shift = np.full(len(p.widths) * f, -0.3, np.float32)
    layer, bias = np.full(len(p.widths) * f, 0.5, np.float32), -1.0
    weight = np.where(y == 1, 0.5 / of[1], 0.5 / of[0]) * len(use)
    steps, step = max(1, p.epochs * -(-len(use) // p.batch)), 0
    for _ in range(p.epochs):
        rng.shuffle(use)
        for b in range(0, len(use), p.batch):
            some = use[b : b + p.batch]
            m = n[some]
            pick = np.repeat(at[some] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            local = words[pick]
            e = table[local].sum(1)
            own = np.repeat(np.arange(len(some)), m)
            best, z = pooled(e @ filters, own, len(some), p)
            h = np.maximum(best + shift, 0)
            x = h @ layer + bias
            g = (1 / (1 + np.exp(-x)) - y[some]) * weight[some] / len(some)
            rate = p.rate * (1 - step / steps)
            gh = np.where(h > 0, g[:, None] * layer, 0).astype(np.float32)
            layer -= rate * (h.T @ g).astype(np.float32)
            bias -= rate * float(g.sum())
            shift -= rate * gh.sum(0)
            # the gradient goes through the word window where each filter had its maximum
            stop = np.cumsum(m)
            gf, ge = np.zeros_like(filters), np.zeros_like(e)
            for d in np.flatnonzero(m):
                lo, hi = int(stop[d] - m[d]), int(stop[d])
                arg = lo + z[lo:hi].argmax(0)
                k = 0
                for i, w in enumerate(p.widths):
                    for j in range(w):
                        cols = slice((k + j) * f, (k + j + 1) * f)
                        q, own_g = arg[i * f : (i + 1) * f] + j, gh[d, i * f : (i + 1) * f]
                        ok = q < hi
                        gf[:, cols] += np.where(ok, e[np.minimum(q, hi - 1)].T * own_g, 0)
                        np.add.at(ge, q[ok], (filters[:, cols] * own_g).T[ok])
                    k += w
            filters -= rate * gf
            hit = np.flatnonzero(np.abs(ge).sum(1))
            np.add.at(table, local[hit].ravel(), -rate * np.repeat(ge[hit], local.shape[1], 0))
            table[rare] = 0
            step += 1
    model = Model(p, table, filters, shift, layer, float(bias))
    del words
    model.cut = cuts(model, texts, y, np.flatnonzero(aside) if aside.any() and len(set(y[aside])) == 2 else np.arange(len(y)))
    return model


def cuts(model: Model, texts: list[str], y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each language the logit between the classes with fewest errors (classes weigh alike); few texts fall back to all."""
    some = pa.array([texts[i] for i in at], pa.large_string())
    got = [model.logits(*flat(some.slice(i, j - i))) for i, j in slices(some, STEP_BYTES)]
    x, lang = (np.concatenate(z) for z in zip(*got, strict=True))
    y = y[at]

    def best(s: np.ndarray) -> float:
        order = np.argsort(x[s], kind="stable")
        v, c = x[s][order], y[s][order]
        wrong = np.concatenate([[0], np.cumsum(c)]) / max(1, c.sum()) + (1 - np.concatenate([[0], np.cumsum(1 - c)]) / max(1, (1 - c).sum()))
        i = int(wrong.argmin())
        return float((v[max(i - 1, 0)] + v[min(i, len(v) - 1)]) / 2)

    every = best(np.arange(len(y)))
    out = np.full(len(FUNCTION_WORDS) + 1, every)
    for k in range(len(out)):
        s = np.flatnonzero(lang == k)
        if min((y[s] == 0).sum(), (y[s] == 1).sum()) >= 15:
            out[k] = best(s)
    return out


def fit(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> Model | None:
    """A model of a bounded sample of docs that labels (doc_id, toxic) covers."""
    p = p or Params()
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("__sw_y"))
    ordered = [known.where(F.col("__sw_y") == c).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows) for c in (0, 1)]
    found = labelled_sample(docs, ordered[0].unionAll(ordered[1]), 2 * p.max_rows, p.max_bytes)
    model = train(found["text"].to_pylist(), found["__sw_y"].to_pylist(), p)
    POWERS.clear()  # the driver keeps nothing of the training
    tidy()
    return model


def toxicity(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with the score in a further column."""
    worker_path(docs.sparkSession)
    if model is None:
        return added(docs, column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^bits rows, whatever the input

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            yield pa.array(np.concatenate([m.score(*flat(texts.slice(i, j - i))) for i, j in slices(texts)] or [np.zeros(0)]), pa.float64())
        tidy()

    return added(docs, column, run("text"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold("doc_id", 4, 2)
    model = fit(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    scored = toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= Params.threshold).cast("int").alias("predicted"))
