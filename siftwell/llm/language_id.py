"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte 1- to 4-grams (ASCII letters lowered), hashed into buckets. Training (stochastic gradient
descent in numpy, on a bounded sample) learns an embedding a bucket and a linear layer; scoring uses their product, one
row of class logits a bucket, so a text's logits are the mean of its subwords' rows. A temperature fitted on set-aside
windows calibrates the probability; below a threshold, fitted there too, a prediction counts as rejected.

Null texts and texts without a letter get `und` with score 0. Null languages are never learned from. With no language
to learn from, every text is `und`. Repeated rows are scored alike, in ties the language first in order wins, very long
texts are scored whole, columns besides doc_id, text and lang stay as they are (one with the result's name is refused), and an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, added, flat, in_fold, labelled_sample, read, slices, tidy, worker_path

NONE = "und"


@dataclass
class Params:
    bits: int = 15
    grams: tuple[int, ...] = (1, 2, 3, 4)
    dims: int = 16
    #: Bounds of the training sample.
    max_rows: int = 3000
    max_bytes: int = 8 << 20
    #: Windows of so many bytes are the training examples.
    windows: tuple[int, ...] = (24, 60, 150, 400)
    a_document: int = 4
    epochs: int = 6
    batch: int = 64
    rate: float = 4.0
    #: Share of right set-aside predictions that may be rejected.
    rejected: float = 0.02
    seed: int = 7


def subwords(data: np.ndarray, at: np.ndarray, p: Params) -> Iterator[np.ndarray]:
    """For each gram length the bucket of the gram at each byte; grams that would leave their text get the bucket 2^bits."""
    low = LOWER[data].astype(np.uint32) + np.uint32(1)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    for n in p.grams:
        h = np.zeros(len(data), np.uint32)
        for k in range(n):
            h[: len(data) - k] = (h[: len(data) - k] + low[k:]) * np.uint32(0x9E3779B1 + 2 * n)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - p.bits)
        h[room < n] = 1 << p.bits
        yield h


@dataclass
class Model:
    params: Params
    languages: list[str]
    rows: np.ndarray  # (languages, buckets + 1): summed logits of a bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at) - 1, len(self.languages)), np.float64)
        count = np.zeros(len(at) - 1)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            for h in subwords(data, at, self.params):
                count[full] += np.add.reduceat((h < 1 << self.params.bits).astype(np.int32), at[:-1][full])
                for c in range(len(self.languages)):
                    out[full, c] += np.add.reduceat(self.rows[c][h], at[:-1][full], dtype=np.float64)
        return out / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the best language and its probability."""
        x = self.logits(data, at) / self.temperature
        e = np.exp(x - x.max(1, keepdims=True))
        best = x.argmax(1)
        return best, (e / e.sum(1, keepdims=True))[np.arange(len(best)), best]


def train(texts: list[str], langs: list[str], p: Params | None = None) -> Model | None:
    """None if there is nothing to learn from."""
    p = p or Params()
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(p.seed)
    code = {x: i for i, x in enumerate(names)}
    examples, labels, aside = [], [], []
    for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        raw = text.encode()
        for _ in range(p.a_document):
            size = int(rng.choice(p.windows))
            i = int(rng.integers(0, max(1, len(raw) - size + 1)))
            while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
                i -= 1
            examples.append(raw[i : i + size])
            labels.append(code[lang])
            aside.append(k % 10 == 9)
    y, aside = np.array(labels), np.array(aside)
    sizes = np.array([len(x) for x in examples])
    at = np.concatenate([[0], np.cumsum(sizes)])
    grams = np.stack(list(subwords(np.frombuffer(b"".join(examples), np.uint8), at, p)), 1)
    table = rng.normal(0, 0.05, ((1 << p.bits) + 1, p.dims)).astype(np.float32)
    table[-1] = 0
    layer, bias = rng.normal(0, 0.3, (p.dims, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    use = np.flatnonzero(~aside & (sizes > 0)) if (~aside).any() else np.flatnonzero(sizes > 0)
    steps, step = max(1, p.epochs * -(-len(use) // p.batch)), 0
    for _ in range(p.epochs):
        rng.shuffle(use)
        for b in range(0, len(use), p.batch):
            some = use[b : b + p.batch]
            idx = [g := grams[at[i] : at[i + 1]].ravel() for i in some]
            idx = [g[g < 1 << p.bits] for g in idx]
            n = np.array([len(g) for g in idx])
            every, row = np.concatenate(idx), np.repeat(np.arange(len(some)), n)
            hidden = np.add.reduceat(table[every], np.cumsum(n) - n, axis=0) / n[:, None]
            x = hidden @ layer + bias
            e = np.exp(x - x.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            rate = p.rate * (1 - step / steps)
            back = (g @ layer.T / n[:, None]).astype(np.float32)
            layer -= rate * 0.1 * (hidden.T @ g).astype(np.float32)
            bias -= rate * 0.02 * g.sum(0).astype(np.float32)
            order = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.diff(every[order], prepend=-1))
            table[every[order][first]] -= rate * 25 * np.add.reduceat(back[row[order]], first, axis=0)
            step += 1
    model = Model(p, names, np.ascontiguousarray((table @ layer).T), bias.astype(np.float64))
    model.rows[:, -1] = 0
    held = np.flatnonzero(aside & (sizes > 0)) if (aside & (sizes > 0)).any() else use
    data = np.frombuffer(b"".join(examples[i] for i in held), np.uint8)
    logits = model.logits(data, np.concatenate([[0], np.cumsum(sizes[held])]))

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(held)), y[held]]).mean())

    if len(held):
        model.temperature = min(np.geomspace(0.2, 5, 33).tolist(), key=loss)
        x = logits / model.temperature
        e = np.exp(x - x.max(1, keepdims=True))
        right = (e.max(1) / e.sum(1))[x.argmax(1) == y[held]]
        model.threshold = float(np.quantile(right, p.rejected)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, p: Params | None = None) -> Model | None:
    """A model of a bounded sample of docs (doc_id, text, lang)."""
    p = p or Params()
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    found = labelled_sample(known, known.select("doc_id"), p.max_rows, p.max_bytes)
    model = train(found["text"].to_pylist(), found["lang"].to_pylist(), p)
    tidy()
    return model


def languages(docs: DataFrame, model: Model | None, column: str = "language") -> DataFrame:
    """docs with a struct column: lang_pred, score, rejected."""
    worker_path(docs.sparkSession)
    kind = "lang_pred string, score double, rejected boolean"
    if model is None:
        return added(docs, column, F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^bits rows, whatever the input

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = pa.array(m.languages)
        for texts in batches:
            parts = [m.predict(*flat(texts.slice(i, j - i))) for i, j in slices(texts)]
            best, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0))
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score), pa.array(score < m.threshold)], ["lang_pred", "score", "rejected"])
        tidy()

    return added(docs, column, run("text"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = in_fold("doc_id", 4, 2)
    model = fit(docs.where(~held))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    named = letter & F.col("language").isNotNull()
    return languages(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held.alias("held_out"),
        F.when(named, F.col("language.lang_pred")).otherwise(NONE).alias("lang_pred"),
        F.when(named, F.col("language.score")).otherwise(0.0).alias("score"),
        F.when(named, F.col("language.rejected")).otherwise(True).alias("rejected"),
    )
