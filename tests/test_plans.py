import gzip
import os

import pytest
from pyspark.sql import functions as F

from siftwell import queries
from siftwell.operators import clusters, plotdata
from siftwell.operators.profile import histogram
from siftwell.plans import benchmark, sensitivity
from siftwell.plans.detection import detect
from siftwell.schema import Columns, Detection
from siftwell.sources import matrix_market, sinks
from siftwell.streaming.histogram import stream_histogram


@pytest.fixture(scope="module")
def cells(spark, sf):
    return queries.cells_b(spark, sf).withColumn("grp", F.substring("sample", 1, 1)).withColumn("cluster", F.pmod("cell_id", F.lit(4))).cache()


def test_comparison(spark, cells, tmp_path):
    few = [benchmark.Strategy("fixed_10", max_mito=0.1), benchmark.Strategy("adaptive_largest_drop"), benchmark.Strategy("adaptive_low", changes={"selection": "first_significant_low"})]
    got = benchmark.compare(cells, Columns(), few, weights={"retention": 0.3, "mito": 0.4, "sample_balance": 0.2, "group_balance": 0.1}, scoring=["balanced"], cluster="cluster")
    rows = {r.strategy: r for r in got.summary.collect()}
    assert rows["fixed_10"].total_cells_after == cells.where("mitoRatio <= 0.1").count()
    # the recommendation, not the selection rule, is what applies by default
    assert rows["adaptive_largest_drop"].total_cells_after == rows["adaptive_low"].total_cells_after
    best = got.recommendation.first()
    assert best.scoring_profile == "custom" and best.recommended_adaptive_strategy.startswith("adaptive_")
    assert all(0 <= r.overall_score <= 1 for r in got.all_scores.collect())
    assert rows["fixed_10"].downstream_status == "ok" and 0 < rows["fixed_10"].sample_entropy_weighted <= 1
    sinks.write_comparison(got, str(tmp_path), cells=True)
    assert {"benchmark_summary", "benchmark_scores", "benchmark_cutoff_plan", "benchmark_report.md", "kept_cells"} <= set(os.listdir(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/kept_cells").where("strategy = 'fixed_10'").count() == rows["fixed_10"].total_cells_after


def test_strategy_validation():
    assert [s.name for s in benchmark.default_strategies(True)][-1] == "adaptive_groupwise" and len(benchmark.default_strategies(False)) == 8
    with pytest.raises(ValueError):
        benchmark.Strategy("x", mode="none")
    with pytest.raises(ValueError):
        benchmark.normalised_weights({"retention": 1})
    assert sum(benchmark.profiles()["balanced"]) == pytest.approx(1)


def test_sweep_equals_single_detections(cells, tmp_path):
    grid = {"bin_width": (0.02, 0.05), "alpha": (0.05,), "min_drop_fraction": (0.01, 0.02), "loss_test": ("threshold_only",), "selection": ("largest_drop", "first_significant_low")}
    got = sensitivity.sweep(cells, **grid)
    rows = got.table.collect()
    assert len({r.parameter_id for r in rows}) == 8
    for r in [x for x in rows if x.parameter_id in ("P001", "P004", "P007")]:
        p = Detection(bin_width=r.bin_width, min_drop_fraction=r.min_drop_fraction, loss_test="threshold_only", selection=r.sample_cutoff_method)
        one = detect(cells, params=p)
        assert {x["sample"]: x.detected_cutoff for x in one.summary.collect()}[r["sample"]] == r.detected_cutoff and one.cutoff() == r.global_cutoff
    assert [r.bin_width for r in sorted({(r.parameter_id, r): r for r in rows}.values(), key=lambda r: r.parameter_id)][:1] == [0.02]
    assert all(r.n_parameter_combinations == 8 for r in got.summary.collect())
    sinks.write_sensitivity(got, str(tmp_path))
    sinks.write_detection(one, str(tmp_path))
    assert len(os.listdir(tmp_path)) == 11


def test_mixing(spark):
    df = spark.createDataFrame([(1, "a")] * 3 + [(1, "b")] + [(2, "a")] * 4, "k int, l string")
    row = clusters.mixing(df, "k", "l").first()
    assert row.cluster_count == 2 and row.dominant_fraction == pytest.approx((0.75 * 4 + 4) / 8) and row.entropy_weighted == pytest.approx(0.8112781244591328 / 2)


def test_plot_data(cells):
    assert plotdata.complexity(cells).where("complexity is not null").count() > 0
    assert plotdata.cell_bars(cells, "sample").count() == 5 and plotdata.boxes(cells, "sample", "nCount_RNA").count() == 5
    assert plotdata.density(cells, "sample", "nCount_RNA").agg(F.sum("cells")).first()[0] == cells.where("nCount_RNA > 0").count()


def test_matrix_market(spark, tmp_path):
    folder = tmp_path / "a" / "filtered"
    folder.mkdir(parents=True)
    with gzip.open(folder / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n3 2 4\n1 1 5\n2 1 7\n3 2 4\n1 2 1\n")
    (folder / "barcodes.tsv").write_text("AAA\nCCC\n")
    (folder / "features.tsv").write_text("e1\tMT-ND1\tGene Expression\ne2\tACTB\tGene Expression\ne3\tACTB\tGene Expression\n")
    counts, features, cells = matrix_market.read_matrix_market(spark, matrix_market.find_folder(str(tmp_path)))
    assert {tuple(r) for r in counts.collect()} == {("AAA", "MT-ND1", 5.0), ("AAA", "ACTB", 7.0), ("CCC", "ACTB.1", 4.0), ("CCC", "MT-ND1", 1.0)}
    got, _ = matrix_market.load_example(spark, "pbmc3k", str(tmp_path), min_cells=1, min_features=1)
    assert {r.cell_id: (r.nFeature_RNA, r.mitoRatio, r.species) for r in got.collect()} == {"AAA": (2, 5 / 12, "human"), "CCC": (2, 0.2, "human")}
    with pytest.raises(FileNotFoundError):
        matrix_market.find_folder(str(tmp_path / "a" / "none"))
    with pytest.raises(ValueError):
        matrix_market.load_cells(spark, "x.rds")


def test_stream(spark, cells, tmp_path):
    cells.select("sample", "mitoRatio").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sample string, mitoRatio double").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = stream_histogram(stream, Columns(), Detection(), "running", {"availableNow": True})
    q.awaitTermination(120)
    want = {tuple(r) for r in histogram(cells, Columns(), Detection()).collect()}
    assert {tuple(r) for r in spark.table("running").collect()} == want


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
