import pytest

import corpus_pipeline as C
from siftwell.llm import compression_quality, toxicity
from test_dart_minhash import brute as classes
from test_packing import check
from test_suffix_dedup import brute as passages


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    now = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(C.STAGES):
        df = spark.createDataFrame(list(now.values()), docs.schema)
        got = stage(spark, df, sf)
        if k == 4:
            check(got.collect(), {i: r.text for i, r in now.items()})
            break
        assert got.columns == names
        kept = {r.doc_id: r for r in got.collect()}
        if k < 2:
            held = C.in_fold("doc_id", (3, 4)[k], (1, 2)[k])
            labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held)
            module, column = ((compression_quality, "quality"), (toxicity, "toxicity"))[k]
            score = {r.doc_id: r.s for r in getattr(module, column)(df, module.fit(df.where(~held), labels), "s").collect()}
            assert set(kept) == {i for i in now if (score[i] >= 0.5 if k == 0 else score[i] < 0.3)}
            assert all(kept[i] == now[i] for i in kept)
        elif k == 2:
            assert set(kept) == {i for i, c in classes([(i, r.text) for i, r in now.items()]).items() if i == c}
        else:
            want = passages([(i, r.text) for i, r in now.items()], 200, "first")
            assert {i: r.text for i, r in kept.items()} == {i: x[3].decode("utf-8", "ignore") if x[1] else now[i].text for i, x in want.items() if not x[1] or x[3].decode("utf-8", "ignore")}
            assert all(r.n_chars == len(r.text) for r in kept.values())
        now = kept


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "a b c", "z")]])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, cut string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.doc_id) == ([(1, 1), (2, 4)] if rows else [])
