"""Repeated passages by suffix order and longest-previous-factor arrays.

Every byte that a repeated string of `length` bytes covers is removed: mode "all" counts every place that has another
one, mode "first" only those with an earlier one (by doc_id, then position), so the first copy stays.

1. Anchors. Of the 32-byte grams inside each 200-byte window the one with the least hash is the window's anchor;
   neighbouring windows that share it form a segment. Equal windows have equal anchors at equal offsets, so a window can
   only repeat among segments whose anchor grams are equal. A first pass counts grams, and only segments of grams that
   have two places travel on.
2. Equal segments of one gram collapse into one that knows it is repeated. Grams with several different segments remain.
3. Those segments come together by gram, in blocks of whole grams. Prefix doubling sorts a block's suffixes to the depth of
   200 bytes. For every suffix the previous and the next smaller place in suffix order give its longest previous factor
   (lengths come from the ranks at the doubling's depths, and end at 200): windows whose factor reaches 200 have an
   earlier copy. Mode "all" takes the longest next factor as well, from the greater places. A gram whose segments are
   larger than a block is parted first: anchors by further hash functions split its segments, equal parts collapse, parts
   with a key of their own are done, and the rest meet in blocks again. What is still too much for a block is dealt out
   window by window by hashes of the 200 bytes, which puts equal prefixes together.
4. The spans of all windows found go back to their texts.

Equal texts are handled once. Null and empty texts have nothing to remove. A text shorter than 200 bytes never loses
anything. Repeated rows count as copies ("first": rows with the same id are all first). Rows without an id come first. An
empty table gives no rows; columns besides doc_id and text are ignored; very long texts are read whole. Texts and windows
count as equal where two 64-bit hashes agree, segments and parts where one does beside that of their anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, flat, forget, materialise, read, slices, tidy, worker_path

LENGTH = 200
GRAM = 32
#: Bytes of the segments of a gram (or part key) beyond which it is dealt out further.
BLOCK = 1 << 20
#: Bytes from which a block takes no further gram.
FULL = 1 << 19


def keys() -> dict:
    return {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(77), F.col("text"))}


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring values."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Row, first and last window start (from the row's start), gram hash and segment hash of each segment."""
    none = np.zeros(0, np.int64)
    size = np.diff(at)
    if not len(data) or size.max(initial=0) < length:
        return none, none, none, none, none
    h = Rolling(data)
    grams = np.arange(len(data) - GRAM + 1)
    code = h(grams, grams + GRAM)
    place = (code & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    least = (sliding_least(place, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    window = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    anchor = least[window]
    new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(row) != 0)))
    last = np.append(new[1:], len(window)) - 1
    lo, hi, own = window[new], window[last], row[new]
    mark = h(lo, hi + length) * np.uint64(0x9E3779B97F4A7C15) + (anchor[new] - lo).astype(np.uint64)
    return own, lo - at[own], hi - at[own], code[anchor[new]].view(np.int64), mark.view(np.int64)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2, lo, hi, gram, seg of each segment of each text."""
    worker_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2), 1 << 20):
                row, lo, hi, gram, seg = segments(*flat(batch.column(2).slice(i, j - i)), length)
                if len(row):
                    of = pa.array(i + row)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(2)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram), pa.array(seg)], names=["k1", "k2", "lo", "hi", "gram", "seg"])
        tidy()

    long = docs.where(F.octet_length("text") >= length).select(*(c.alias(n) for n, c in keys().items()), "text")
    return long.mapInArrow(run, "k1 long, k2 long, lo int, hi int, gram long, seg long")


def ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """By depth 8, 16, 32 and so on up to `length`: the suffixes' ranks by that many first bytes; equal prefixes share a number.

    Bytes past the end count as zeros, so ranks are right for suffixes of the depth or longer.
    """
    n = len(data)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : n + k]
    depth, out = 8, []
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]])[:n])
        out.append((depth, rank))
        if depth >= length:
            return out
        step = min(depth, length - depth)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank.astype(np.int64) * n + after
        depth += step


def smaller(place: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller value; -1 without one. Jumps over what is known to be greater."""
    at = np.arange(len(place)) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[place[at[todo]] > place[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, up to `length`; both have so many bytes."""
    out = np.zeros(len(a), np.int64)
    whole = levels[-1][1][a] == levels[-1][1][b]
    out[whole] = length
    left = np.flatnonzero(~whole)
    last = len(levels[0][1]) - 1
    for depth, rank in levels[-2::-1]:  # a common prefix of 200 is excluded, so each depth fits once at most
        x, y = np.minimum(a[left] + out[left], last), np.minimum(b[left] + out[left], last)
        out[left] += np.where(rank[x] == rank[y], depth, 0)
    return np.minimum(out, length)


def longest_factors(data: np.ndarray, window: np.ndarray, length: int, later: bool = False) -> np.ndarray:
    """For each of the suffixes at `window` the longest prefix (up to `length`, in whole steps of 8 bytes) that also starts at an earlier (`later`: a later) one of them."""
    return factors(ranks(data, length), window, length, later)


def factors(levels: list[tuple[int, np.ndarray]], window: np.ndarray, length: int, later: bool) -> np.ndarray:
    order = np.argsort(levels[-1][1][window], kind="stable")  # suffix order; ties in order of place
    place = len(order) - 1 - order if later else order
    before, after = smaller(place), smaller(place[::-1])[::-1]
    after = np.where(after >= 0, len(order) - 1 - after, -1)
    best = np.zeros(len(order), np.int64)
    for near in (before, after):
        x = np.flatnonzero(near >= 0)
        best[x] = np.maximum(best[x], common(levels, window[order[x]], window[order[near[x]]], length))
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def repeated(data: np.ndarray, size: np.ndarray, length: int, first: bool) -> np.ndarray:
    """For every window of the segments (end to end in data, in order of place): whether there is another, or with `first` an earlier equal one."""
    count = size - length + 1
    window = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    levels = ranks(data, length)
    out = factors(levels, window, length, False) >= length
    return out if first else out | (factors(levels, window, length, True) >= length)


def runs(flags: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and last window of each run of flags within a segment."""
    of = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    x = np.flatnonzero(flags)
    if not len(x):
        return x, x, x
    new = np.append(True, (np.diff(x) != 1) | (np.diff(of[x]) != 0))
    s, e = x[new], x[np.append(np.flatnonzero(new)[1:], len(x)) - 1]
    return of[s], s - begin[of[s]], e - begin[of[s]]


def in_blocks(rows: DataFrame, length: int, first: bool) -> DataFrame:
    """rows: gram, seg, id, lo, bytes. Gives gram, seg, w1, w2: runs of repeated windows of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, [("id", "ascending"), ("lo", "ascending")], null_placement="at_start")).combine_chunks()
            data, at = binary(t.column("bytes").chunk(0))
            seg, w1, w2 = runs(repeated(data, np.diff(at), length, first), np.diff(at) - length + 1)
            own = pa.array(seg)
            return pa.RecordBatch.from_arrays([t.column("gram").chunk(0).take(own), t.column("seg").chunk(0).take(own), pa.array(w1, pa.int32()), pa.array(w2, pa.int32())], names=["gram", "seg", "w1", "w2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            bytes_to = np.append(0, np.cumsum(np.diff(binary(batch.column(4))[1])))
            begin = 0  # whole grams up to here have been handed on
            for e in [*np.flatnonzero(np.diff(gram) != 0) + 1, len(gram)]:
                if size >= FULL and gram[begin] != last:
                    yield done()
                    held, size = [], 0
                held.append(batch.slice(begin, e - begin))
                size += int(bytes_to[e] - bytes_to[begin])
                last, begin = gram[e - 1], e
        if held:
            yield done()
            held = []
        tidy()

    return rows.repartition("gram").sortWithinPartitions("gram").select("gram", "seg", "id", "lo", "bytes").mapInArrow(run, "gram long, seg long, w1 int, w2 int")


def binary(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end and the len+1 offsets."""
    x = x.cast(pa.large_binary())
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def parted(rows: DataFrame, length: int) -> DataFrame:
    """gram, seg, id, lo and bytes of segments: parts with the same anchors by four further hash functions.

    Gives gram, seg, w1, w2 (the part's windows in its segment), key (of the anchors), part (of the bytes), id, lo, bytes.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                data, at = binary(some.column(4))
                count = np.diff(at) - length + 1
                of = np.repeat(np.arange(len(count)), count)
                w = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                start = at[:-1][of] + w
                grams = np.arange(len(data) - GRAM + 1)
                new, key = np.append(True, np.diff(of) != 0), some.column(0).to_numpy()[of].view(np.uint64)
                for seed in range(3, 7):
                    code = Rolling(data, seed)(grams, grams + GRAM)
                    least = sliding_least((code & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64), length - GRAM + 1)
                    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[start]
                    new |= np.append(True, np.diff(anchor) != 0)
                    key = (key ^ code[anchor]) * np.uint64(0x9E3779B97F4A7C15)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(start)) - 1
                w1, w2, own = w[first], w[last], of[first]
                s, e = start[first], start[last] + length
                take, view = pa.array(own), memoryview(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(take),
                        some.column(1).take(take),
                        pa.array(w1.astype(np.int32)),
                        pa.array(w2.astype(np.int32)),
                        pa.array(key[first].view(np.int64)),
                        pa.array(Rolling(data, 2)(s, e).view(np.int64)),
                        some.column(2).take(take),
                        pa.array((some.column(3).to_numpy()[own] + w1).astype(np.int32)),
                        pa.array([view[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["gram", "seg", "w1", "w2", "key", "part", "id", "lo", "bytes"],
                )
        tidy()

    return rows.select("gram", "seg", "id", "lo", "bytes").mapInArrow(run, f"gram long, seg long, w1 int, w2 int, key long, part long, id {kind}, lo int, bytes binary")


def in_parts(rows: DataFrame, length: int, first: bool, most: int) -> DataFrame:
    """Repeated windows (gram, seg, w1, w2) of grams with more than a block's bytes; written to the shared folder."""
    parts = materialise(parted(rows, length), "parts")
    least = F.min(F.struct("id", "lo"))
    groups = parts.groupBy("key", "part").agg(least.alias("f"), (F.count("*") > 1).alias("again"), F.max(F.octet_length("bytes")).alias("size"))
    groups = materialise(groups, "groups")
    many = groups.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1").select("key", (F.col("size") > most).alias("hot"))
    mixed = materialise(groups.join(many, "key").select("key", "part", "hot", "f"), "mixed")
    firsts = parts.join(mixed, ["key", "part"]).where("id <=> f.id and lo = f.lo")
    firsts = materialise(firsts.select(F.col("key").alias("gram"), F.col("part").alias("seg"), "hot", "id", "lo", "bytes"), "firsts")
    found = in_blocks(firsts.where("not hot"), length, first).unionAll(by_hash(firsts.where("hot"), length, first))
    found = materialise(found.select(F.col("gram").alias("key"), F.col("seg").alias("part"), F.col("w1").alias("x1"), F.col("w2").alias("x2")), "found")
    # parts that need nothing more stay behind: those of a group of one whose key no other group has
    told = groups.join(mixed.select("key", "part", F.lit(True).alias("met")), ["key", "part"], "left").where("again or met")
    joined = materialise(parts.drop("bytes").join(told.select("key", "part", "f", "again"), ["key", "part"]), "joined")
    here = "id <=> f.id and lo = f.lo"
    whole = joined.where(f"again and not ({here})" if first else "again").select("gram", "seg", "w1", "w2")
    own = joined.where(here if first else "not again").select("key", "part", "gram", "seg", "w1")
    inner = own.join(found, ["key", "part"]).select("gram", "seg", (F.col("w1") + F.col("x1")).alias("w1"), (F.col("w1") + F.col("x2")).alias("w2"))
    out = materialise(whole.unionAll(inner), "inner")
    forget(parts, groups, mixed, firsts, found, joined)
    return out


def by_hash(rows: DataFrame, length: int, first: bool) -> DataFrame:
    """Repeated windows (gram, seg, w1, w2), dealt out one by one: equal ones meet by a 128-bit hash, counted before they travel."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                data, at = binary(part.column(4))
                count = np.diff(at) - length + 1
                of = np.repeat(np.arange(len(count)), count)
                w = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                s = at[:-1][of] + w
                take = pa.array(of)
                hashes = (pa.array(Rolling(data, seed)(s, s + length).view(np.int64)) for seed in (1, 2))
                place = pa.array((part.column(3).to_numpy()[of] + w).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(3)), place, pa.array(w.astype(np.int32)), *hashes], names=["gram", "seg", "id", "place", "w", "h1", "h2"])

    windows = materialise(rows.select("gram", "seg", "id", "lo", "bytes").mapInArrow(run, f"gram long, seg long, id {kind}, place int, w int, h1 long, h2 long"), "windows")
    met = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "place")).alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
    found = windows.join(met, ["h1", "h2"])
    if first:
        found = found.where("not (id <=> least.id and place = least.place)")
    out = materialise(found.select("gram", "seg", F.col("w").alias("w1"), F.col("w").alias("w2")), "met")
    forget(windows)
    return out


def spans(docs: DataFrame, length: int = LENGTH, mode: str = "all", most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Removed spans by text (k1, k2, spans), without what copies of whole texts lose; and all texts (k1, k2, id, n)."""
    first = mode == "first"
    long = docs.where(F.octet_length("text") >= length)
    texts = long.select("doc_id", *(c.alias(n) for n, c in keys().items())).groupBy("k1", "k2")
    texts = texts.agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.count("*").alias("n"))
    texts = materialise(texts.select("k1", "k2", F.when(~F.col("no_id"), F.col("id")).alias("id"), "n"), "texts")
    every = anchors(docs, length)
    # places of a gram: copies of a text count once
    place = F.xxhash64("k1", "k2", "lo")
    grams = every.select("gram", place.alias("place")).groupBy("gram").agg(F.min("place").alias("p1"), F.max("place").alias("p2"))
    twice = materialise(grams.where("p1 <> p2").select("gram"), "grams")
    found = materialise(every.join(twice, "gram", "left_semi"), "found")
    once = found.groupBy("k1", "k2", "lo").agg(F.first("hi").alias("hi"), F.first("gram").alias("gram"), F.first("seg").alias("seg"))
    one = once.withColumn("id", F.lit(None).cast("long"))
    if first:  # places are ordered by id; in mode "all" any order will do
        one = once.join(texts.select("k1", "k2", "id"), ["k1", "k2"])
    one = materialise(one.select("gram", "seg", "k1", "k2", "id", "lo", "hi"), "one")
    forget(twice, found)
    # different segments, each with its first place; repeated rows of one id share a place
    least = F.min(F.struct("id", "lo", "k1", "k2", "hi"))
    different = materialise(one.groupBy("gram", "seg").agg(least.alias("f"), (F.min(place) != F.max(place)).alias("again")), "segments")
    many = different.groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.col("f.hi") - F.col("f.lo") + length).alias("size")).where("n > 1")
    wanted = different.join(many.select("gram", (F.col("size") > most).alias("hot")), "gram").select("gram", "seg", "hot", "f.*")
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "seg", "hot", "id", "lo", "hi")).alias("s"))
    by_text = materialise(by_text, "wanted")  # a list holds no more than its text
    own = long.select(*(c.alias(n) for n, c in keys().items()), "text").join(by_text, ["k1", "k2"])
    cut = own.select(F.explode("s").alias("s"), F.col("text").cast("binary").alias("raw")).select("s.*", F.expr(f"substring(raw, s.lo + 1, s.hi - s.lo + {length})").alias("bytes"))
    # copies of a text give a segment more than once
    rows = materialise(cut.groupBy("gram", "seg").agg(F.first("hot").alias("hot"), F.first(F.struct("id", "lo", "bytes")).alias("r")).select("gram", "seg", "hot", "r.*"), "bytes")
    forget(by_text)
    inner = [materialise(in_blocks(rows.where("not hot"), length, first), "inner")]
    if not rows.where("hot").isEmpty():
        inner.append(in_parts(rows.where("hot"), length, first, most))
    forget(rows)
    # whole segments: those with other places ("first": at all places but the first)
    told = different.where("again").select("gram", "seg", "f")
    whole = one.join(told, ["gram", "seg"])
    if first:
        whole = whole.where("not (id <=> f.id and lo = f.lo)")
    whole = whole.select("k1", "k2", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    heads = different if first else different.where("not again")
    begin = F.col("f.lo")
    part = reduce(DataFrame.unionAll, inner).join(heads.select("gram", "seg", "f"), ["gram", "seg"])
    part = part.select("f.k1", "f.k2", (begin + F.col("w1")).alias("s"), (begin + F.col("w2") + length).alias("e"))
    listed = whole.unionAll(part).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))  # of one text
    listed = materialise(listed, "spans")
    forget(one, different, *inner)
    return listed, texts


def without(data: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is left of each text without the spans (in order of row and start): all bytes, offsets; and bytes and maximal runs removed."""
    rows = len(at) - 1
    s, e = at[row] + start, np.maximum.accumulate(at[row] + end) if len(row) else row
    new = np.append(True, (s[1:] > e[:-1]) | (row[1:] != row[:-1]))[: len(row)]
    first = np.flatnonzero(new)
    s, e = s[first], e[np.append(first[1:], len(row)) - 1] if len(first) else first
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1  # runs of one text don't touch, but one may start where that of the text before ends
    np.subtract.at(edge, e, 1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    gone = np.bincount(row[first], e - s, rows).astype(np.int64)
    return data[keep], np.append(0, np.cumsum(np.diff(at) - gone)), gone, np.bincount(row[first], minlength=rows)


def kept(docs: DataFrame, length: int = LENGTH, mode: str = "all", most: int = BLOCK) -> DataFrame:
    """docs (all its columns) with a struct column `cut`: n_bytes, n_removed, n_spans, kept (binary)."""
    found, texts = spans(docs, length, mode, most)
    more = materialise(texts.where("n > 1").join(found, ["k1", "k2"], "full").select("k1", "k2", "id", F.coalesce("n", F.lit(1)).alias("n"), "spans"), "removed")
    forget(found, texts)
    names = {f"__sw_{n}": c for n, c in keys().items()}
    side = more.select(*(F.col(c).alias(f"__sw_{c}") for c in more.columns))
    both = docs.withColumns(names).join(side, list(names), "left")
    # copies of whole texts; a text without an id is first if any copy has none
    copy = (F.col("__sw_n") > 1) & (F.lit(True) if mode == "all" else ~F.col("doc_id").eqNullSafe(F.col("__sw_id")))
    copy = F.coalesce(copy & (F.octet_length("text") >= length), F.lit(False))
    lists = F.when(copy, F.array(F.struct(F.lit(0).alias("s"), F.octet_length("text").alias("e")))).otherwise(F.col("__sw_spans"))

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, pairs in batches:
            parts = []
            for i, j in slices(text):
                data, at = flat(text.slice(i, j - i))
                some = pairs.slice(i, j - i)
                row = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False))
                every = some.flatten()
                left, edge, gone, runs_ = without(data, at, row, every.field("s").to_numpy(), every.field("e").to_numpy())
                rest = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(left)]).cast(pa.binary())
                parts.append(pa.StructArray.from_arrays([*map(pa.array, (np.diff(at), gone, runs_)), rest], ["n_bytes", "n_removed", "n_spans", "kept"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))
        tidy()

    return both.withColumn("__sw_cut", run("text", lists)).drop(*names, *(f"__sw_{c}" for c in ("id", "n", "spans"))).withColumnRenamed("__sw_cut", "cut")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return kept(docs).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


#: Every window of every text, counted: DuckDB's form of the result, for tables that fit one machine.
SQL = """
with t as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
k as (select *, row_number() over () as k from t),
c as (select k, c, substr(h, 2 * c + 1, 1398) as h from (select k, h, unnest(range(0, length(h)::bigint // 2 - 199, 500)) as c from k)),
w as (select k, c + p as p, md5_number(substr(h, 2 * p + 1, 400)) as g from (select k, c, h, unnest(range(0, length(h)::bigint // 2 - 199)) as p from c)),
d as (select g from w group by g having count(*) > 1),
s as (select k, p, lag(p) over (partition by k order by p) as b from w where g in (select g from d)),
r as (select k, p, sum(case when b is null or p > b + 200 then 1 else 0 end) over (partition by k order by p) as run from s),
m as (select k, run, min(p) as s, max(p) + 200 as e from r group by all),
x as (select k, s, e, lag(e) over (partition by k order by s) as b, lead(s) over (partition by k order by s) as a from m),
q as (select k, sum(e - s)::bigint as n_removed, count(*)::bigint as n_spans, list(struct_pack(s := s, e := e, a := a) order by s) as l, min(s) as f from x group by k),
z as (select doc_id, length(h)::bigint // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when l is null then h else substr(h, 1, 2 * f) || array_to_string(list_transform(l, lambda y: substr(h, 2 * y.e + 1, 2 * (coalesce(y.a, length(h)::bigint // 2) - y.e))), '') end as kept from k left join q using (k))
select doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) as kept_sha256 from z
"""
