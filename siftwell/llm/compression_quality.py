"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Each text is cut into blocks, and each block compressed with the good dictionary and with the bad one. The difference of
the two sizes over the text's length says which texts it resembles. A logistic calibration of that difference, and of its
product with the logarithm of the length (longer texts tell more surely), becomes the score: nothing else goes in.

Null and empty texts get the score of an empty text (the share of good labels among the learned). With no label of both
classes every score is 0.5. Repeated rows score alike; very long texts are read whole, block by block; columns besides
doc_id and text stay as they are, and one with the result's name is refused; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, flat, in_fold, labelled_sample, read, slices, tidy, worker_path


@dataclass
class Params:
    #: Bytes of each dictionary, and of the excerpt that a text gives to one.
    dictionary: int = 400 << 10
    excerpt: int = 300
    block: int = 1024
    level: int = 5
    #: Bounds of the training sample, of each class and in all.
    max_rows: int = 1500
    max_bytes: int = 10 << 20
    #: Weight of the good class in the calibration, about its share in a corpus over that of the bad class, which has 1.
    good_weight: float = 6.0
    seed: int = 5


@dataclass
class Model:
    params: Params
    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    empty: float

    def start(self) -> None:
        """Compressors can't travel; each worker makes its own."""
        if getattr(self, "tools", None) is None:
            level = self.params.level
            made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
            for d in made:
                d.precompute_compress(level=level)
            self.tools = [zstandard.ZstdCompressor(level=level, dict_data=d, write_dict_id=False, write_content_size=False, write_checksum=False) for d in made]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def difference(self, raw: bytes) -> float:
        """Compressed size with the bad dictionary less that with the good one, a byte of raw."""
        self.start()
        good, bad = self.tools
        n, out = self.params.block, 0
        for i in range(0, len(raw), n):
            block = raw[i : i + n]
            out += len(bad.compress(block)) - len(good.compress(block))
        return out / max(1, len(raw))

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        view = memoryview(data)
        d = np.array([self.difference(view[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.float64)
        return np.stack([d, d * np.log(np.maximum(np.diff(at), 1))], 1)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = (self.features(data, at) - self.centre) / self.scale
        out = 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))
        out[np.diff(at) == 0] = self.empty
        return out


def dictionary(texts: list[bytes], p: Params, rng: np.random.Generator) -> bytes:
    """Excerpts from any place of the texts, as many as fit."""
    out, size = [], 0
    for k in rng.permutation(len(texts)).tolist() * 4:
        if size >= p.dictionary:
            break
        i = int(rng.integers(0, max(1, len(texts[k]) - p.excerpt + 1)))
        out.append(texts[k][i : i + p.excerpt])
        size += len(out[-1])
    return b"\n".join(out)[: p.dictionary]


def train(texts: list[str], labels: list[int], p: Params | None = None) -> Model | None:
    """None unless there are texts of both classes. One half of the sample fills the dictionaries, the other calibrates."""
    p, y = p or Params(), np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(p.seed)
    raw = [t.encode() for t in texts]
    first = np.arange(len(y)) % 2 == 0
    if any(((y == c) & (first == half)).sum() == 0 for c in (0, 1) for half in (True, False)):
        first = np.zeros(len(y), bool)
    some = first if first.any() else ~first
    good, bad = (dictionary([raw[i] for i in np.flatnonzero(some & (y == c))], p, rng) for c in (1, 0))
    model = Model(p, good, bad, np.zeros(3), np.zeros(2), np.ones(2), float(y.mean()))
    use = np.flatnonzero(~first)
    x = np.concatenate([model.features(*flat(pa.array([texts[i] for i in use[b : b + 500]], pa.large_string()))) for b in range(0, len(use), 500)])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    x = np.concatenate([np.ones((len(x), 1)), (x - model.centre) / model.scale], 1)
    target = y[use]
    weight = np.where(target == 1, p.good_weight / max(1, (target == 1).sum()), 1 / max(1, (target == 0).sum())) / (1 + p.good_weight)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - target)) + 1e-4 * w
        h = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> Model | None:
    """A model of a bounded sample of docs that labels (doc_id, quality) covers."""
    p = p or Params()
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("__sw_y"))
    ordered = [known.where(F.col("__sw_y") == c).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows) for c in (0, 1)]
    found = labelled_sample(docs, ordered[0].unionAll(ordered[1]), 2 * p.max_rows, p.max_bytes)
    model = train(found["text"].to_pylist(), found["__sw_y"].to_pylist(), p)
    tidy()
    return model


def quality(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with the score in a further column."""
    worker_path(docs.sparkSession)
    if model is None:
        return added(docs, column, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            yield pa.array(np.concatenate([m.score(*flat(texts.slice(i, j - i))) for i, j in slices(texts)] or [np.zeros(0)]), pa.float64())
        tidy()

    return added(docs, column, run("text"))


def op4_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold("doc_id", 3, 1)
    model = fit(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    return quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
