"""Near-duplicate classes by DartMinHash.

A text is the weighted set of its five-word shingles (words lowered in ASCII; shorter texts are one shingle), a shingle's
weight the number of its occurrences (signatures() takes any positive weights). The weight axis of a shingle is parted
into regions [0, 1), [1, 2), [2, 4) and so on; each region throws darts: hashed exponential gaps, shorter in wider
regions, place them along the rank axis, one hash places them inside the region, and another assigns each a coordinate.
Darts beyond the shingle's weight don't count. A text throws the darts up to a rank that fills nearly all coordinates and
doubles it until all are filled; every coordinate keeps its earliest dart. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.

Texts with the same words become one representative. Bands of coordinates make buckets, and classes grow in two rounds.

1. In the buckets of the first few bands, members come in a pseudo-random order; each is compared by whole signatures with
   the leaders before it, proposes the nearest of them if it may be similar, and leads too unless one is certainly
   similar. Large buckets are dealt out in runs, whose leaders meet in larger runs, so the proposals of a bucket make
   trees. Of each row those of its first and of its last band are verified by exact weighted Jaccard over the texts: the
   trees of these buckets are whole, and a row has two pairs at most. Connected components over the verified links are
   the first classes.
2. All rows that share a bucket of any band and are in different classes are compared by whole signatures, leaders or not,
   in tiles that hold their texts: every pair that may be similar is verified on the spot, and a link is handed on for
   each two classes that have one. Pairs of a text too long for a tile are verified apart.

So round one only saves comparisons: no link between rows of one bucket depends on who leads or proposes.

Null and empty texts, and rows without an id, are alone in their class (class_id is the row's doc_id). Rows of one id are
one document and share a class. The least doc_id represents a class. An empty table gives no rows; columns besides doc_id
and text are ignored; very long texts are read whole. Texts count as the same where two 64-bit hashes of their words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, blanks, flat, forget, materialise, mix64, powers, read, slices, tidy, words_of, worker_path
from .components import components


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    coordinates: int = 256
    #: Bands and coordinates of each; at similarity 0.8 all bands miss a pair with probability 3e-6.
    bands: int = 24
    band: int = 4
    similarity: float = 0.8
    #: Bands whose buckets the first round takes; the second takes all.
    opening: int = 6
    #: Estimates from which a pair is proposed and from which a row needs not lead: 0.8 less and plus about three and
    #: two and a half standard errors.
    proposed: float = 0.725
    certain: float = 0.86
    #: Rows of a bucket that one run handles at first; each level takes eight times as many, up to `longest`. Beyond that
    #: the first round leaves leaders to the second, so a task holds so many of them at most.
    run: int = 256
    longest: int = 16384
    #: Rows of a bucket that one tile of the second round holds: outside the bucket's main class, and streamed past those.
    outside: int = 512
    main: int = 4096
    #: Bytes of the longest text that travels into tiles.
    longest_text: int = 16 << 10
    #: Ids (8 bytes each) that are broadcast to pick texts; beyond it ids and texts meet in a shuffle.
    broadcast_ids: int = 2_000_000


BLANKS = blanks()
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each shingle; and for each row a 64-bit hash of all its words."""
    start, end, row = words_of(data, at, BLANKS)
    rows = len(at) - 1
    if not len(start):
        return np.zeros(0, np.uint64), row, np.zeros(rows, np.uint64)
    word = Rolling(LOWER[data])(start, end)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    # hash of k words on: a polynomial over the words' hashes
    sums, size_of = Rolling.__new__(Rolling), len(word)
    base = 0xD1342543DE82EF95
    sums.power, sums.undo = powers(base, size_of)
    sums.sums = np.zeros(size_of + 1, np.uint64)
    np.cumsum(word * sums.power[:size_of], out=sums.sums[1:])
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    srow = np.repeat(np.arange(rows), count)
    s = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    e = np.minimum(s + size, np.repeat(first + n, count))
    whole = sums(first, first + n)
    whole[n == 0] = 0
    return sums(s, e), srow, whole


def weights(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes, their row and the number of their occurrences."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], r[at], np.diff(np.append(at, len(h))).astype(np.float64)


def regions(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seed, row, width and share (of the width that lies under the weight) of each region that a weight reaches into."""
    level = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    n = level + 1
    of = np.repeat(np.arange(len(hashes)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    width = np.where(k > 0, 2.0 ** (k - 1), 1.0)
    low = np.where(k > 0, width, 0.0)
    return mix64(hashes[of] + GOLD * k.astype(np.uint64)), row[of], width, np.minimum(1, (weight[of] - low) / width)


def signatures(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) 64-bit marks of each coordinate's earliest dart; rows without elements keep zeros.

    hashes: distinct in each row; weight: positive numbers.
    """
    out, best = np.zeros((rows, k), np.uint64), np.full((rows, k), np.inf)
    if not len(hashes):
        return out
    total = np.bincount(row, weight, minlength=rows)
    limit = (k * np.log(k) + 2 * k) / np.where(total > 0, total, 1)

    def unit(seed: np.ndarray) -> np.ndarray:
        return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    # the darts of a region: a stream of hashes whose gaps add up to ranks
    stream, row, width, share = regions(hashes, row, weight)
    rank = -np.log(unit(stream)) / width
    while len(stream):
        inside = rank < limit[row]
        now = tuple(x[inside] for x in (stream, rank, row, width, share))
        late = [tuple(x[~inside] for x in (stream, rank, row, width, share))]
        thrown = []
        while len(now[0]):
            s, t, r, w, part = now
            thrown.append((s, t, r, part))
            s = mix64(s + GOLD)
            t = t - np.log(unit(s)) / w
            on = t < limit[r]
            late.append(tuple(x[~on] for x in (s, t, r, w, part)))
            now = tuple(x[on] for x in (s, t, r, w, part))
        if thrown:
            m, t, r, part = (np.concatenate(x) for x in zip(*thrown, strict=True))
            thrown.clear()
            partial = np.flatnonzero(part < 1)
            beyond = partial[unit(mix64(m[partial] ^ np.uint64(0x8EBC6AF09C88C6E3))) >= part[partial]]
            if len(beyond):
                m, t, r = (np.delete(x, beyond) for x in (m, t, r))
            dart = mix64(m ^ np.uint64(0xA0761D6478BD642F))
            cell = r * k + (dart >> np.uint64(33)).astype(np.int64) % k
            order = np.lexsort((t, cell))
            first = order[np.append(True, np.diff(cell[order]) != 0)[: len(order)]]
            better = t[first] < best.ravel()[cell[first]]
            first = first[better]
            best.ravel()[cell[first]] = t[first]
            out.ravel()[cell[first]] = dart[first]
        # rows with an empty coordinate throw on, up to twice the rank
        short = np.isinf(best).any(1) & (total > 0)
        if not short.any():
            break
        limit[short] *= 2
        waiting = [np.concatenate(x) for x in zip(*late, strict=True)]
        stream, rank, row, width, share = (x[short[waiting[2]]] for x in waiting)
    return out


def jaccard(a: pa.Array, b: pa.Array, p: Params) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of texts side by side."""
    sides = []
    for x in (a, b):
        h, row, _ = shingles(*flat(x), p.shingle)
        key, at, n = np.unique(mix64(h + GOLD * row.astype(np.uint64)), return_index=True, return_counts=True)
        sides.append((key, row[at] if len(at) else row, n, np.bincount(row, minlength=len(x))))
    _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    common = np.bincount(sides[0][1][i], np.minimum(sides[0][2][i], sides[1][2][j]), len(a))
    every = sides[0][3] + sides[1][3] - common
    return np.divide(common, every, out=np.zeros(len(a)), where=every > 0)


def signed(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, words (hash of all words, two of them), bands (array of bucket hashes), marks (8 bits a coordinate); written to the shared folder. Texts without words are left out."""
    worker_path(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20, 2000):
                data, at = flat(batch.column(1).slice(i, j - i))
                h, row, whole = shingles(data, at, p.shingle)
                own = np.flatnonzero(np.bincount(row, minlength=j - i))
                if not len(own):
                    continue
                sig = signatures(*weights(h, row), j - i, p.coordinates)[own]
                second = np.zeros(j - i, np.uint64)
                np.add.at(second, row, mix64(h ^ GOLD))
                parts = sig[:, : p.bands * p.band].reshape(len(own), p.bands, p.band)
                bucket = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
                for c in range(p.band):
                    bucket = mix64(bucket * GOLD + parts[:, :, c])
                n = parts.shape[1]
                marks = (sig & np.uint64(0xFF)).astype(np.uint8)
                width = p.coordinates
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(own)),
                        pa.array(whole[own].view(np.int64)),
                        pa.array(second[own].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(own) + 1) * n, n, dtype=np.int32)), pa.array(bucket.ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, (len(own) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(marks))]),
                    ],
                    names=["doc_id", "w1", "w2", "bands", "marks"],
                )
        tidy()

    rows = docs.where("doc_id is not null").select("doc_id", "text")
    return materialise(rows.mapInArrow(run, f"doc_id {kind}, w1 long, w2 long, bands array<long>, marks binary"), "signed")


def compared(state: dict, of: tuple[int, int], ids: np.ndarray, marks: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one run, in order, against the leaders so far (in state). Gives rows with their nearest leader's id, and which rows lead."""
    if state.get("of") != of:
        state.update(of=of, n=0, ids=np.zeros(16, np.int64), marks=np.zeros((16, marks.shape[1]), marks.dtype))
    best, nearest, leads = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)

    def against(rows: np.ndarray, lo: int, hi: int) -> None:
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            for k in range(lo, hi, 256):
                same = (marks[part][:, None, :] == state["marks"][None, k : min(hi, k + 256), :]).mean(2)
                top = same.argmax(1)
                value = same[np.arange(len(part)), top]
                better = value > best[part]
                best[part[better]], nearest[part[better]] = value[better], state["ids"][k + top[better]]

    todo = np.arange(len(ids))
    if state["n"]:
        against(todo, 0, state["n"])
    while len(todo):  # the first row that no leader is certainly similar to leads
        free = best[todo] < p.certain
        if not free.any():
            break
        k = int(free.argmax())
        x, n = todo[k], state["n"]
        leads[x] = True
        if n == len(state["ids"]):
            state["ids"], state["marks"] = np.concatenate([state["ids"]] * 2), np.concatenate([state["marks"]] * 2)
        state["ids"][n], state["marks"][n], state["n"] = ids[x], marks[x], n + 1
        todo = todo[k + 1 :]
        against(todo, n, n + 1)
    row = np.flatnonzero(best >= p.proposed)
    return row, nearest[row], leads


def led(members: DataFrame, p: Params) -> DataFrame:
    """members: band, bucket, run, doc_id, marks. Gives proposed pairs a, b; and with null b each a that leads; with band and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, salt, ids, band = (batch.column(i).to_numpy() for i in range(4))
            raw = batch.column(4).cast(pa.large_binary())
            begin = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
            marks = np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + len(ids) * p.coordinates].reshape(len(ids), p.coordinates)
            edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])))
            out = []
            for s, e in zip(edge.tolist(), np.append(edge[1:], len(ids)).tolist(), strict=True):
                row, leader, leads = compared(state, (int(bucket[s]), int(salt[s])), ids[s:e], marks[s:e], p)
                heads = s + np.flatnonzero(leads)
                every = np.append(s + row, heads)
                out.append((band[every], bucket[every], ids[every], np.append(leader, heads * 0), np.append(row * 0, heads * 0 + 1).astype(bool)))
            band, bucket, a, b, alone = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(bucket), pa.array(a), pa.array(b, mask=alone)], names=["band", "bucket", "a", "b"])
        tidy()

    order = F.xxhash64("bucket", "doc_id")
    dealt = members.withColumn("__sw_o", order).repartition("bucket", "run").sortWithinPartitions("bucket", "run", "__sw_o").select("bucket", "run", "doc_id", "band", "marks")
    return dealt.mapInArrow(run, "band int, bucket long, a long, b long")


def salted(members: DataFrame, run: int) -> DataFrame:
    """members (band, bucket, doc_id) of buckets with two rows at least, with run: buckets of up to `run` rows have one."""
    size = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    runs = F.ceil(F.col("n") / run)
    # the run depends on the bucket too: rows that part in one bucket meet in another
    return members.join(size, "bucket").select("band", "bucket", F.pmod(F.xxhash64("doc_id", "bucket", F.lit(run)), runs).alias("run"), "doc_id", (runs > 1).alias("split"))


def buckets(heads: DataFrame) -> DataFrame:
    """band, bucket and doc_id of the rows that share a bucket with another; written to the shared folder."""
    every = heads.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = every.groupBy("bucket").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("bucket")
    return materialise(every.join(shared, "bucket", "left_semi"), "buckets")


def proposals(heads: DataFrame, shared: DataFrame, p: Params) -> DataFrame:
    """heads: doc_id, marks; shared: see buckets(). Gives distinct pairs a, b that may be similar, two a row at most; written to the shared folder."""
    members, run, found, held = shared.where(F.col("band") < p.opening).select("band", "bucket", "doc_id"), p.run, [], []
    while True:
        level = materialise(salted(members, run), "runs")
        found.append(materialise(led(level.drop("split").join(heads.select("doc_id", "marks"), "doc_id"), p), "led"))
        # buckets that had several runs: their leaders meet again
        again = level.where("split").select("bucket").distinct()
        members = materialise(found[-1].where("b is null").select("band", "bucket", F.col("a").alias("doc_id")).join(again, "bucket", "left_semi"), "leaders")
        held += [level, members]
        if run >= p.longest or members.isEmpty():
            break
        run *= 8
    pairs = reduce(DataFrame.unionAll, (x.where("b is not null").select("a", "b", "band") for x in found))
    ends = pairs.groupBy("a").agg(F.min(F.struct("band", "b")).alias("x"), F.max(F.struct("band", "b")).alias("y"))
    pairs = ends.select("a", F.explode(F.array("x.b", "y.b")).alias("b"))
    out = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    forget(*found, *held)
    return out


def across(tiles: DataFrame, p: Params) -> DataFrame:
    """tiles: bucket, left, right, side, doc_id, component, marks, bands, text (null: too long). Gives pairs a, b of different components and whether they are `sure` links.

    A tile's rows of side 0 meet those of side 1 and, in the first tile of their run (right = 0), each other, in blocks of
    256 rows. Pairs that may be similar are verified in the first bucket that they share: of each block and two components
    one link comes out. Pairs of texts that are too long come out unverified, all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, left, right, side, ids, component = (batch.column(i).to_numpy() for i in range(6))
            raw = batch.column(6).cast(pa.large_binary())
            begin = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
            marks = np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + len(ids) * p.coordinates].reshape(len(ids), p.coordinates)
            bands = batch.column(7).flatten().to_numpy().reshape(len(ids), p.bands)
            texts = batch.column(8).cast(pa.large_string())
            keys = np.stack([bucket, left, right, side])
            edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            for s, e in zip(edge.tolist(), np.append(edge[1:], len(ids)).tolist(), strict=True):
                now = (int(bucket[s]), int(left[s]), int(right[s]))
                if now != tile:
                    tile, held = now, []
                for i in range(s, e, 256):
                    j = min(e, i + 256)
                    own = (ids[i:j], component[i:j], marks[i:j], bands[i:j], texts.slice(i, j - i))
                    if side[s] == 0:
                        held.append((*(x.copy() for x in own[:4]), pa.concat_arrays([own[4]])))
                        if now[2]:
                            continue
                    for k, other in enumerate(held):
                        apart = own[1][:, None] != other[1][None, :]
                        if side[s] == 0 and k == len(held) - 1:
                            apart &= np.tri(j - i, k=-1, dtype=bool)
                        x, y = np.nonzero(apart)
                        if len(x):
                            near = (own[2][x] == other[2][y]).mean(1) >= p.proposed
                            x, y = x[near], y[near]
                        if len(x):
                            first = (own[3][x] == other[3][y]).argmax(1)
                            here = own[3][x, first] == now[0]
                            x, y = x[here], y[here]
                        if len(x):
                            a, b, sure = linked(own, other, x, y, p)
                            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(sure)], names=["a", "b", "sure"])
        tidy()

    names = ("bucket", "left", "right", "side", "doc_id", "component", "marks", "bands", "text")
    dealt = tiles.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "side").select(*names)
    return dealt.mapInArrow(run, "a long, b long, sure boolean")


def linked(own: tuple, other: tuple, x: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs x of own and y of other (ids, components, marks, bands, texts): one verified link of each two components, and what has a text missing."""
    left, right = own[4].take(pa.array(x)), other[4].take(pa.array(y))
    known = ~(left.is_null().to_numpy(zero_copy_only=False) | right.is_null().to_numpy(zero_copy_only=False))
    value = np.zeros(len(x))
    at = np.flatnonzero(known)
    left, right = left.take(pa.array(at)), right.take(pa.array(at))
    if len(at):
        value[at] = np.concatenate([jaccard(left.slice(i, j - i), right.slice(i, j - i), p) for i, j in slices(left, 1 << 20, 5000)])
    link = np.flatnonzero(known & (value >= p.similarity))
    lo, hi = np.minimum(own[1][x[link]], other[1][y[link]]), np.maximum(own[1][x[link]], other[1][y[link]])
    order = np.lexsort((hi, lo))
    new = np.append(True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0))[: len(order)]
    keep = np.append(link[order[new]], np.flatnonzero(~known))
    return own[0][x[keep]], other[0][y[keep]], known[keep]


def crossing(docs: DataFrame, heads: DataFrame, shared: DataFrame, label: DataFrame, p: Params) -> DataFrame:
    """Distinct pairs a, b (with sure: see across()) of rows that share a bucket and are in different components; written to the shared folder.

    shared: bucket, doc_id; label: node, component. Rows outside a bucket's largest component (its main one) meet all of the
    bucket's rows of other components, in tiles of a run of them and a run of the others.
    """
    of = label.select(F.col("node").alias("doc_id"), "component")
    members = materialise(shared.join(of, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "members")
    size = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = size.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    runs = mixed.select("bucket", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / p.outside).alias("lefts"), F.ceil(F.col("main.n") / p.main).alias("rights"))
    met = materialise(members.join(runs, "bucket"), "mixed")
    # a run of outside rows is the left of a tile with each run of the main component and each later run of outside rows
    run = F.pmod(F.xxhash64("doc_id"), F.when(F.col("component") == F.col("main"), F.col("rights")).otherwise(F.col("lefts")))
    rows = met.withColumn("run", run)

    r, rights, lefts = F.col("run"), F.col("rights"), F.col("lefts")

    def each(start, stop, left, right, side):  # tiles by a number from start to stop - 1; none for an empty range
        made = F.transform(F.sequence(start, stop - 1), lambda k: F.struct(left(k).alias("left"), right(k).alias("right"), F.lit(side).alias("side")))
        return F.slice(made, F.lit(1), F.greatest(stop - start, F.lit(0)).cast("int"))

    zero = F.lit(0).cast("long")
    streamed = each(zero, lefts, lambda k: k, lambda k: r, 1)
    first = each(zero, rights, lambda k: r, lambda k: k, 0)
    later = each(r + 1, lefts, lambda k: r, lambda k: rights + k, 0)
    earlier = each(zero, r, lambda k: k, lambda k: rights + r, 1)
    tile = F.when(F.col("component") == F.col("main"), streamed).otherwise(F.concat(first, later, earlier))
    tiles = rows.select("bucket", "doc_id", "component", F.explode(tile).alias("t")).select("bucket", "t.left", "t.right", "t.side", "doc_id", "component")
    # one text an id, and its signature
    ids = materialise(met.select("doc_id").distinct(), "ids")
    text = F.when(F.octet_length("text") <= p.longest_text, F.col("text"))
    texts = materialise(texts_of(docs, ids, text, p).join(heads.select("doc_id", "marks", "bands"), "doc_id"), "texts")
    found = across(tiles.join(texts, "doc_id"), p)
    out = materialise(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), "crossing")
    forget(members, met, ids, texts)
    return out


def texts_of(docs: DataFrame, ids: DataFrame, text: Column, p: Params) -> DataFrame:
    """doc_id and text of the rows that ids (doc_id, distinct) names; of repeated ids the greatest text, so that pairs don't double.

    A counted, bounded number of ids is broadcast, so that texts nobody asks for aren't shuffled.
    """
    few = ids.count() <= p.broadcast_ids
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"))


def verified(docs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """The pairs a, b whose texts have the similarity; pairs is read several times. Written to the shared folder."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "ids")
    texts = materialise(texts_of(docs, ids, F.col("text"), p), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    @F.arrow_udf("double")
    def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ta, tb in batches:
            parts = [jaccard(ta.slice(i, j - i), tb.slice(i, j - i), p) for i, j in slices(ta, 1 << 20, 5000)]
            yield pa.array(np.concatenate(parts or [np.zeros(0)]), pa.float64())
        tidy()

    out = materialise(both.select("a", "b", similarity("ta", "tb").alias("similarity")).where(F.col("similarity") >= p.similarity).select("a", "b"), "links")
    forget(ids, texts)
    return out


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) once links between its components, or rows without one, count too; written to the shared folder."""
    of = label.select(F.col("node").alias("x"), F.col("component").alias("c"))
    near = links.join(of.withColumnRenamed("x", "a"), "a", "left").select(F.coalesce("c", "a").alias("p"), "b")
    edges = near.join(of.withColumnRenamed("x", "b"), "b", "left").select(F.col("p").alias("a"), F.coalesce("c", "b").alias("b"))
    top = materialise(components(edges), "top")
    moved = label.join(top.select(F.col("node").alias("component"), F.col("component").alias("t")), "component", "left").select("node", F.coalesce("t", "component").alias("component"))
    fresh = top.join(label.select("node"), "node", "left_anti")
    out = materialise(moved.unionByName(fresh), "label")
    forget(top)
    return out


def classes(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class), one row a document."""
    p = p or Params()
    table = signed(docs, p)
    # texts with the same words: one representative, whose signature is that of all
    same = table.groupBy("w1", "w2").agg(F.min("doc_id").alias("head"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    heads = materialise(same, "heads")
    words = materialise(table.select("doc_id", "w1", "w2"), "words")
    forget(table)
    signs = heads.select(F.col("head").alias("doc_id"), "bands", "marks")
    shared = buckets(signs)
    pairs = proposals(signs, shared, p)
    links = verified(docs, pairs, p)
    label = materialise(components(links), "label")
    # what round one kept from a proposal: rows of one bucket that are still apart
    rest = crossing(docs, signs, shared.select("bucket", "doc_id"), label, p)
    forget(shared, pairs, links)
    long = verified(docs, rest.where("not sure").select("a", "b"), p)
    links = rest.where("sure").select("a", "b").unionAll(long)
    if not links.isEmpty():
        more = joined(label, links)
        forget(label)
        label = more
    forget(rest, long)
    top = heads.select("w1", "w2", "head").join(label.select(F.col("node").alias("head"), "component"), "head", "left")
    top = materialise(top.select("w1", "w2", F.coalesce("component", "head").alias("class_id")), "classes")
    placed = materialise(words.join(top, ["w1", "w2"]).select("doc_id", "class_id"), "placed")
    forget(heads, words, label, top)
    alone = docs.select("doc_id").join(placed, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"))
    return placed.unionAll(alone)


def op1_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
