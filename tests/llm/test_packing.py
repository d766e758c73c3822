import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siftwell.llm import packing

TEXTS = [
    None, "", " ", "a", "it's  the\n\nend.\n x", "é éa naïve　 x  y", "<|endoftext|> is text", "\t\ttabs \r\n rows", "word " * 3000, "x" * 5000, "Ünïcode 你好 world 123abc 4 5", "same", "same",
]


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def expected(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, texts):
    """rows: what pieces() gives. Each id of each document lies in one piece, and sequences have no gaps."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert set(by_doc) == set(texts)
    for k, text in texts.items():
        parts = sorted(by_doc[k], key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        assert np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist() == expected(text)
        assert {r.doc_tokens for r in parts} == {sum(r.length for r in parts)}
    full = 0
    for k, parts in by_seq.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        n = sum(r.length for r in parts)
        assert n <= packing.SEQUENCE
        full += n == packing.SEQUENCE
    assert full >= len(by_seq) - 1


def test_cases(spark):
    texts = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(k, t, k, "x") for k, t in texts.items()], "doc_id long, text string, ids int, task string").repartition(3)
    check(packing.pieces(df).collect(), texts)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    got = packing.pieces(docs)
    check(got.collect(), {r.doc_id: r.text for r in docs.collect()})
    for r in packing.sequences(got).collect():
        assert len(r.ids) == 4 * sum(p.length for p in r.boundaries)


def test_empty(spark):
    assert packing.pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []


ADDED_TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b", "a <|endoftext|> <|endoftext|>\nb", "x\n<|endoftext|>\n\ny", "<|endof", "text|>", "é <|endoftext|>é", "plain text"]


def test_added_token_has_its_id():
    """Against the tokenizer as loaded, all texts in one buffer."""
    import pyarrow as pa

    from siftwell.llm.common import flat

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ADDED_TEXTS + [t or "" for t in TEXTS]
    ids, n = packing.ByteBpe(added=True)(*flat(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_gives_added_token_its_id(spark, tmp_path):
    spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = packing.op2_packing(spark, str(tmp_path)).collect()
    assert row.doc_tokens == 4 and row.ids_crc32 == zlib.crc32(np.array([64, 50256, 65, packing.END], "<u4").tobytes())


def test_both_passes_give_memory_back(spark, monkeypatch):
    """Spark keeps workers for later stages, so each pass ends by giving freed memory back."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    ran, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, g=kind.mapInArrow: ran.append(f) or g(self, f, *a))
    packing.pieces(docs)
    calls = []
    monkeypatch.setattr(packing, "tidy", lambda: calls.append(1))
    assert list(ran[-1](iter([]))) == [] and calls == [1]
