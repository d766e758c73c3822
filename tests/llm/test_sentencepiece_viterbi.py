import functools
import random

import numpy as np
import pyarrow as pa

from siftwell.llm import sentencepiece_viterbi as V
from siftwell.llm.common import flat

TEXTS = [None, "", " ", "  ", "a", "hello world", " lead and  double   spaces ", "tab\tand\nline", "naïve 你好 \U0001f600 \u0000", "x" * 3000, "word " * 500, "日本語テキスト" * 20, "a▁b ▁", "same", "same"]


@functools.cache
def pieces():
    return V.Pieces(V.model_path())


def brute(text):
    """Plain dynamic programming over the whole text."""
    if not text:
        return []
    p, t = pieces(), V.MARK + text.replace(" ", V.MARK)
    score = {w: (s, i) for w, s, i in table()}
    best, back = [0.0] + [-np.inf] * len(t), [None] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - p.longest), e):
            got = score.get(t[s:e], (p.least, None) if e - s == 1 else None)
            if got and best[s] + got[0] > best[e]:
                best[e], back[e] = best[s] + got[0], (s, got[1])
    out, e = [], len(t)
    while e:
        s, i = back[e]
        out.append([i] if i is not None else p.byte[list(t[s:e].encode())].tolist())
        e = s
    return [i for x in out[::-1] for i in x]


@functools.cache
def table():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=V.model_path())
    return [(sp.id_to_piece(i), sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_against_plain_viterbi():
    rng = random.Random(4)
    more = ["".join(rng.choice("aehinorst .,éß你") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = TEXTS + more
    ids, counts = pieces().encode(*flat(pa.array(texts)))
    assert split(ids, counts) == [brute(t) for t in texts]
    again, _ = pieces().encode(*flat(pa.array(texts)))
    assert (again == ids).all()
    assert pieces().decode(ids.astype(np.int64), counts) == [(t or "").replace(V.MARK, " ") for t in texts]


def test_decodes_what_the_library_encodes():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=V.model_path())
    texts = [t for t in TEXTS if t and V.MARK not in t and "\0" not in t]
    got = [sp.encode(t) for t in texts]
    assert pieces().decode(np.array([i for x in got for i in x]), np.array([len(x) for x in got])) == texts


def test_query(spark, sf, tmp_path):
    rows = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded binary").repartition(3)
    rows.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in V.op10_sentencepiece(spark, str(tmp_path)).collect()}
    assert [got[i].n_pieces for i in range(len(TEXTS))] == [len(brute(t)) for t in TEXTS]
    assert all(got[i].round_trip == (V.MARK not in (t or "")) for i, t in enumerate(TEXTS))
    assert all(r.round_trip for r in V.op10_sentencepiece(spark, sf).collect())
    assert V.encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_word_in_strips(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aehinorst") for _ in range(n)) for n in (700, 701, 5000)]
    want = [brute(t) for t in texts]
    monkeypatch.setattr(V, "CELLS", 1 << 9)
    ids, counts = V.Pieces(V.model_path()).encode(*flat(pa.array(texts)))
    assert split(ids, counts) == want
