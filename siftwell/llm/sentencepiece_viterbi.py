"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text gets the model's space mark in front and for every space, and is cut into words (a run of marks and what follows;
no piece reaches over such a cut). Distinct words are sorted by length; words of one length advance together, position by
position: hashes of all substrings up to the longest piece probe the sorted hashes of the pieces, and vectorised maxima
keep each position's best score and backpointer. The best path has the greatest sum of the file's piece scores (the
unigram objective; in a tie the longer last piece). A character without a piece costs 10 less than the least score and
becomes its bytes' pieces. For a model that was trained by merging (BPE), paths may differ from the order of merges that
its own library applies; decoding gives the text back all the same.

Null and empty texts have no pieces. Repeated rows encode alike; very long texts are read whole, a word at a time; a word
without end is one row of its length. An empty table gives no rows; columns besides doc_id and text are ignored. A text
that holds the space mark itself decodes to a space there.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, flat, mix64, read, slices, tidy, worker_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct words whose ids a worker keeps.
KEPT_WORDS = 100_000
#: Cells (words x characters x piece lengths) that advance at once.
CELLS = 1 << 20
UNKNOWN = 10.0


class Pieces:
    """A model's pieces, sorted by hash, for encode() and decode()."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        words = [sp.id_to_piece(i) for i in ids]
        self.setup(dict(zip(words, ids, strict=True)), [sp.get_score(i) for i in ids])
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.unknown = sp.unk_id()
        self.bytes_of = {i: b"" for i in range(sp.get_piece_size())} | {i: w.replace(MARK, " ").encode() for w, i in zip(words, ids, strict=True)} | ({int(i): bytes([b]) for b, i in enumerate(self.byte)} if sp.is_byte(int(self.byte[0])) else {})
        self.has_bytes = sp.is_byte(int(self.byte[0]))

    def setup(self, pieces: dict[str, int], scores: list[float]) -> None:
        self.longest = max(map(len, pieces))
        self.least = min(scores) - UNKNOWN
        keys, names = np.zeros(len(pieces), np.uint64), list(pieces)
        for size in set(map(len, names)):
            own = [i for i, w in enumerate(names) if len(w) == size]
            keys[own] = self.hash_of(np.frombuffer("".join(names[i] for i in own).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64))[:, -1]
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(list(pieces.values()))[order], np.array(scores, np.float64)[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        self.kept: dict[str, bytes] = {}

    def hash_of(self, chars: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes along the last axis."""
        out, h = np.empty(chars.shape, np.uint64), np.zeros(chars.shape[:-1], np.uint64)
        for i in range(chars.shape[-1]):
            h = mix64((h + chars[..., i] + np.uint64(1)) * self.BASE)
            out[..., i] = h
        return out

    def paths(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (rows of code points): length and place among the keys (-1: none) of each position's best last piece.

        Substrings are probed in strips of starts, CELLS substrings at once, so a word of any length takes memory in proportion.
        """
        n, size = chars.shape
        wide = min(self.longest, size)
        best, back, chosen = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        best[:, 0] = 0
        rows, strip = np.arange(n), max(wide, CELLS // (n * wide))
        place, score = np.zeros((n, 0, wide), np.int32), np.zeros((n, 0, wide))
        for s in range(0, size, strip):
            stop = min(size, s + strip)
            new, gain = np.full((n, stop - s, wide), -1, np.int32), np.full((n, stop - s, wide), -np.inf)
            # substrings by start: hashes grow to the right, one more character at a time
            h = np.zeros((n, stop - s), np.uint64)
            for k in range(wide):
                m = min(stop, size - k) - s
                if m <= 0:
                    break
                h = mix64((h[:, :m] + chars[:, s + k : s + k + m].astype(np.uint64) + np.uint64(1)) * self.BASE)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                new[:, :m, k] = np.where(hit, at, -1)
                gain[:, :m, k] = np.where(hit, self.scores[at], self.least if k == 0 else -np.inf)
            # pieces that end here may start in the strip before
            place, score = np.concatenate([place[:, -wide:], new], 1), np.concatenate([score[:, -wide:], gain], 1)
            first = stop - place.shape[1]
            for e in range(s + 1, stop + 1):
                lengths = np.arange(min(wide, e), 0, -1)  # longest first: argmax takes the first of equals
                at = e - lengths - first
                total = best[:, e - lengths] + score[:, at, lengths - 1]
                pick = total.argmax(1)
                best[:, e], back[:, e] = total[rows, pick], lengths[pick]
                chosen[:, e] = place[rows, at[pick], lengths[pick] - 1]
        return back, chosen

    def words(self, words: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit, as bytes) of each word."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, own in by.items():
            step = max(1, CELLS // (size * min(self.longest, size)))
            for s in range(0, len(own), step):
                some = own[s : s + step]
                chars = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(-1, size)
                back, chosen = self.paths(chars)
                rows, e, found = np.arange(len(some)), np.full(len(some), size), []
                while len(rows):
                    k = back[rows, e]
                    at = chosen[rows, e]
                    found.append((rows, e, np.where(at >= 0, self.ids[at], -1)))
                    e = e - k
                    rows, e = rows[e > 0], e[e > 0]
                row, end, ids = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((end, row))
                ids, end, edge = ids[order], end[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))])
                raw, edges = ids.astype(np.uint32).tobytes(), (edge * 4).tolist()
                strange = set(row[order][ids < 0].tolist())
                for r, i in enumerate(some):
                    out[i] = self.with_bytes(words[i], ids[edge[r] : edge[r + 1]], end[edge[r] : edge[r + 1]]) if r in strange else raw[edges[r] : edges[r + 1]]
        return out

    def with_bytes(self, word: str, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The ids of a word in which characters without a piece become those of their bytes."""
        out = array("I")
        for x, e in zip(ids.tolist(), ends.tolist(), strict=True):
            out.extend([x] if x >= 0 else self.byte[list(word[e - 1].encode())].tolist() if self.has_bytes else [self.unknown])
        return out.tobytes()

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end and their number for each text."""
        rows = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        # a word starts at a text's start and at a space after another character
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[at] = True
        starts = np.flatnonzero(cut[:-1])
        head = np.isin(starts, at[:-1])
        ends = np.append(starts[1:], len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        # at a text's start one more mark goes in front; if spaces follow, they are one run
        distinct, which = np.unique(code * 2 + head, return_inverse=True)
        names = coded.dictionary.to_pylist()
        texts = [(MARK if d & 1 else "") + names[d >> 1].decode().replace(" ", MARK) for d in distinct.tolist()]
        parts, units, owner = [], [], []
        for i, t in enumerate(texts):  # a text may hold the mark itself after another character
            for u in cuts(t):
                units.append(u)
                owner.append(i)
        fresh = list(dict.fromkeys(u for u in units if u not in self.kept))
        new = dict(zip(fresh, self.words(fresh), strict=True))
        parts = [b""] * len(texts)
        for i, u in zip(owner, units, strict=True):
            parts[i] += new[u] if u in new else self.kept[u]
        for u in fresh:
            if len(self.kept) < KEPT_WORDS and len(u) < 40:
                self.kept[u] = new[u]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        every = np.frombuffer(b"".join(parts), np.uint32)
        first, n = np.cumsum(sizes) - sizes, sizes[which]
        ids = every[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return ids, np.bincount(np.searchsorted(at, starts, "right") - 1, n, rows).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each row of ids; bytes that are no UTF-8 become replacement characters."""
        if not hasattr(self, "table"):
            raw = [self.bytes_of[i] for i in range(len(self.bytes_of))]
            self.lengths = np.array([len(x) for x in raw])
            self.table, self.begin = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.lengths) - self.lengths
        n = self.lengths[ids]
        data = self.table[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        edge = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[s + (data[s : s + 1] == b" ") : e].decode("utf-8", "replace") for s, e in zip(edge[:-1], edge[1:], strict=True)]


def cuts(text: str) -> list[str]:
    """Parts that start at a mark after another character."""
    if MARK not in text[1:]:
        return [text]
    at = [0, *(i for i in range(1, len(text)) if text[i] == MARK and text[i - 1] != MARK), len(text)]
    return [text[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def pieces_of(path: str) -> Pieces:
    """One table a worker process."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str | None = None, column: str = "pieces") -> DataFrame:
    """docs with the ids (binary, unsigned little-endian 32-bit) in a further column."""
    worker_path(docs.sparkSession)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pieces_of(path or model_path())
        for texts in batches:
            out = []
            for i, j in slices(texts):
                ids, counts = pieces.encode(*flat(texts.slice(i, j - i)))
                at = np.concatenate([[0], np.cumsum(counts)]) * 4
                out.append(pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))]).cast(pa.binary()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary())
        tidy()

    return added(docs, column, run("text"))


def decoded(rows: DataFrame, path: str | None = None, column: str = "decoded") -> DataFrame:
    """rows (with `pieces`) with the text in a further column."""
    worker_path(rows.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pieces_of(path or model_path())
        for ids in batches:
            out: list[str] = []
            for i, j in slices(ids):
                raw = [x or b"" for x in ids.slice(i, j - i).to_pylist()]
                out += pieces.decode(np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(x) // 4 for x in raw]))
            yield pa.array(out, pa.string())

    return added(rows, column, run("pieces"))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    both = decoded(encoded(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return both.select(
        "doc_id",
        (F.octet_length("pieces") / 4).cast("long").alias("n_pieces"),
        F.crc32("pieces").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
