"""Concatenate and cut: documents end to end, cut into sequences of a fixed number of tokens.

Pass one tokenises each text once, writes the ids (16 or 32 bits each) to the shared folder with the task's
number and the running token count inside that task, and sums each task's tokens. A prefix sum over those totals
(one row a task) gives every document its place in the whole stream. Pass two cuts at multiples of the sequence
length; each piece is the boundary record of its window: document, start, length, sequence and offset. sequences() brings
the pieces of a window together, for those who want the windows themselves.

Null texts count as empty (just the end id). Repeated rows are documents of their own. An empty table gives no rows.
Columns besides doc_id and text are ignored. Ties don't arise: every row has a place of its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, materialise, slices, tidy, worker_path

SEQUENCE = 2048
END = 1
#: Distinct word chunks whose ids a worker keeps.
KEPT_CHUNKS = 100_000
TOKENIZER = "byte_bpe_50k"
#: The added token of the vocabulary's JSON file, and its id.
ADDED, ADDED_ID = b"<|endoftext|>", 50256


class ByteBpe:
    """Ids of the byte-level BPE vocabulary: distinct chunks of a batch are encoded once.

    Texts are first cut where the vocabulary's own splitting pattern always cuts: before a space that
    visible ASCII follows, and after a single line feed between visible ASCII. With `added`, the vocabulary's added token in a
    text gets its own id, as tokenizers gives it by default, and parts the text; without, it is ordinary text.
    """

    def __init__(self, name: str = TOKENIZER, added: bool = False):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[bytes, bytes] = {}
        self.added = added
        if added:
            self.kept[ADDED] = array("I", [ADDED_ID]).tobytes()

    @staticmethod
    def occurrences(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of the added token that lie in one text."""
        raw, found, k = data.tobytes(), [], -1
        while (k := raw.find(ADDED, k + 1)) >= 0:
            found.append(k)
        place = np.array(found, np.int64)
        return place[np.searchsorted(at, place, "right") == np.searchsorted(at, place + len(ADDED) - 1, "right")]

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        rows = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        visible = (data > 0x20) & (data < 0x7F)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] |= (data[:-1] == 0x20) & visible[1:]
        cut[2:-1] |= visible[:-2] & (data[1:-1] == 0x0A) & visible[2:]
        if self.added and len(place := self.occurrences(data, at)):
            # a space before the token ends its part: it stays with the blanks before it
            cut[place[place > 0] - 1] = False
            cut[place] = cut[place + len(ADDED)] = True
        cut[at] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        found, kept, encode = [], self.kept, self.encoding.encode_ordinary
        for c in coded.dictionary.to_pylist():
            ids = kept.get(c)
            if ids is None:
                ids = array("I", encode(c.decode())).tobytes()
                if len(kept) < KEPT_CHUNKS and len(c) < 40:
                    kept[c] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        every = np.frombuffer(b"".join(found), np.uint32)
        first = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy().astype(np.int64)
        n = sizes[which]
        ids = every[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        row = np.searchsorted(at, starts, "right") - 1
        return ids, np.bincount(row, n, rows).astype(np.int64)


def tokenised(docs: DataFrame, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, ids (binary, unsigned little-endian 32-bit, end id included), task, before (tokens of the task before it), n (its own), written to the shared folder."""
    worker_path(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, total, encode = TaskContext.get().partitionId(), 0, ByteBpe(added=added)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids, counts = encode(*flat(batch.column(1).slice(i, j - i)))
                counts1 = counts + 1
                stop = np.cumsum(counts1)
                out = np.full(int(stop[-1]) if len(stop) else 0, end, "<u4")
                keep = np.ones(len(out), bool)
                keep[stop - 1] = False
                out[keep] = ids
                at = np.concatenate([[0], stop * 4]).astype(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.binary())
                before = pa.array(total + stop - counts1)
                total += int(stop[-1]) if len(stop) else 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed, pa.array(np.full(j - i, task)), before, pa.array(counts1)], names=["doc_id", "ids", "task", "before", "n"])
        del encode
        tidy()

    return materialise(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, task long, before long, n long"), "tokens")


def pieces(docs: DataFrame, length: int = SEQUENCE, end: int = END, added: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary). added: as in ByteBpe."""
    table = tokenised(docs, end, added)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one row a task of pass one, whatever the number of documents
    totals = table.groupBy("task").agg(F.sum("n").alias("n"))
    base = totals.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    placed = table.join(F.broadcast(base), "task").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).cast(pa.large_binary())
            data, at = np.frombuffer(ids.buffers()[2], np.uint8), np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            place, n = batch.column(2).to_numpy(), np.diff(at) // 4
            for i in range(0, len(n), 1000):
                p, m, a = place[i : i + 1000], n[i : i + 1000], at[:-1][i : i + 1000]
                first = p // length
                k = (p + m - 1) // length - first + 1
                row = np.repeat(np.arange(len(m)), k)
                seq = first[row] + np.arange(len(row)) - (np.cumsum(k) - k)[row]
                lo, hi = np.maximum(seq * length, p[row]), np.minimum((seq + 1) * length, (p + m)[row])
                begin, stop = a[row] + (lo - p[row]) * 4, a[row] + (hi - p[row]) * 4
                view = memoryview(data)
                crc = np.fromiter((zlib.crc32(view[s:e]) for s, e in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64, len(row))
                inside = pa.array([view[s:e] for s, e in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())
                cols = [batch.column(0).slice(i, 1000).take(pa.array(row)), *map(pa.array, (lo - p[row], hi - lo, crc, m[row], seq, lo - seq * length)), inside]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        tidy()

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(cut: DataFrame) -> DataFrame:
    """sequence_id, ids (binary) and its boundary records: doc_id, start, length and offset of each piece, in order."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    got = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # at most one piece a token
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return got.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("boundaries"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pieces(read(spark, sf_dir, "documents"), added=True).drop("ids")
