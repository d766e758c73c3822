import pytest
from pyspark.sql import functions as F

from siftwell.operators import features, losstest, profile, qc, support
from siftwell.plans import cutoff_plan
from siftwell.plans.detection import detect
from siftwell.plans.quality import options, qc_multi, qc_one
from siftwell.schema import Bounds, Columns, Detection, as_fraction, check_cells, checked_ratio, mito_cutoff
from siftwell.sources import tables

LOOSE = {"bin_width": 0.05, "min_cut": 0.05, "min_drop_cells": 1, "min_drop_fraction": 0, "min_cells_after": 1, "min_retention_after": 0, "loss_test": "threshold_only"}


def cells(spark, values, sample="A"):
    df = spark.createDataFrame([(i, sample, m) for i, m in enumerate(values)], "cell_id int, sample string, mitoRatio double")
    return df.withColumns({"nFeature_RNA": F.lit(500), "nCount_RNA": F.lit(1000.0), "grp": F.concat(F.lit("g"), "sample")})


def test_largest_drop(spark):
    df = cells(spark, [0.24] * 20 + [0.19] * 5 + [0.14] * 15 + [0.02] * 60)
    got = detect(df, params=Detection(**LOOSE, max_cut=0.25))
    row = got.summary.first()
    assert (row.selected_cutoff, row.cutoff_source) == (0.2, "significant_largest_drop")
    assert got.cutoff() == 0.2 and row.supports_final_cutoff
    names = got.summary.columns
    assert len(set(names)) == len(names) == 46
    wide = got.wide_profile().first()
    assert [wide[c] for c in ("raw_counts", "0.25", "0.2", "0.15", "0.1", "0.05")] == [100, 100, 80, 75, 60, 60]


def test_reference_guided(spark):
    df = cells(spark, [0.24] * 10 + [0.07] * 30 + [0.02] * 60)
    row = detect(df, params=Detection(**LOOSE, max_cut=0.30, species="human")).summary.first()
    assert (row.first_significant_cutoff_high, row.largest_drop_cutoff, row.reference_cutoff, row.recommended_cutoff, row.selected_cutoff) == (0.2, 0.05, 0.1, 0.2, 0.05)
    row = detect(df, params=Detection(**LOOSE, max_cut=0.30, species="human", selection="reference_guided")).summary.first()
    assert row.selected_cutoff == 0.2 and row.recommendation_level == "cautious" and row.warning_level == "moderate_reference_deviation"


def test_nothing_detected(spark):
    df = cells(spark, [i / 100 for i in range(80)])
    row = detect(df, params=Detection(min_drop_cells=10_000, fallback="none")).summary.first()
    assert row.detected_cutoff is None and row.cutoff_source == "not_detected" and not row.fallback_used and row.recommended_method == "not_detected"
    row = detect(df, params=Detection(min_drop_cells=10_000)).summary.first()
    assert row.cutoff_source == "quantile_fallback_0.90" and row.fallback_used and row.cutoff_confidence == "low"
    assert detect(df, params=Detection(min_drop_cells=10_000, fallback="max_cut")).summary.first().selected_cutoff == 1.0
    with pytest.raises(ValueError):
        cutoff_plan.build_plan(df, params=Detection(min_drop_cells=10_000, fallback="none"))


def test_profile_is_strict_and_filter_inclusive(spark):
    df = cells(spark, [c for i in range(1, 21) for c in [round(i * 0.05, 2)] * 10])
    p = Detection(bin_width=0.05, min_cut=0.05)
    got = {r.cutoff: r.retained_cells for r in profile.profile(df, p=p).collect()}
    assert got == {c: sum(10 for i in range(1, 21) if round(i * 0.05, 2) < c) for c in p.grid}
    found = detect(df, params=Detection(bin_width=0.05, min_cut=0.05, selection="median_significant"))
    assert found.cutoff() == found.summary.first().detected_cutoff
    assert qc.filter_cells(df, Columns(), Bounds(), 0.5).count() == 100


def test_support_rule(spark):
    df = spark.createDataFrame([(0.05,), (0.08,), (0.08,), (0.20,)], "cutoff double")
    row = support.resolved(df, fraction=0.5).first()
    assert (row.global_cutoff, row.support_count, row.required_support, row.n_total_samples) == (0.08, 3, 2, 4)
    row = support.resolved(df.unionAll(spark.createDataFrame([(None,)] * 9, "cutoff double")), fraction=0.5).first()
    assert (row.global_cutoff, row.required_support, row.n_total_samples) == (0.05, 7, 13)
    assert support.resolved(df.where("cutoff > 1").unionAll(spark.createDataFrame([(None,)], "cutoff double"))).first().global_cutoff is None


def test_empirical_tail_and_single_interval(spark):
    df = spark.createDataFrame([("s", i, x, x / 20) for i, x in enumerate([5, 1, 5, 7])] + [("t", 0, 3, 0.1)], "sample string, interval_index int, interval_loss long, interval_loss_fraction double")
    got = {(r["sample"], r.interval_index): r for r in losstest.tested(df, "empirical_tail").collect()}
    assert got["s", 0].p_value == 0.75
    assert got["t", 0].p_value == 1.0 and got["t", 0].test_method == "empirical_tail_insufficient_baseline"


def test_bounds_and_validation(spark):
    with pytest.warns(UserWarning):
        assert mito_cutoff(20) == 0.2
    assert mito_cutoff(1) == 1.0 and mito_cutoff("adaptive", adaptive=True) == "adaptive"
    for bad in (101, -1, "x", float("nan")):
        with pytest.raises(ValueError):
            mito_cutoff(bad)
    with pytest.raises(ValueError):
        Bounds(min_genes=5, max_genes=4)
    for change in ({"alpha": 0}, {"bin_width": 0}, {"loss_test": "x"}, {"min_cut": 0.5, "max_cut": 0.4}):
        with pytest.raises(ValueError):
            Detection(**change)
    assert options(Detection(alpha=0.01), {"alpha": None, "bin_width": 0.02}) == Detection(bin_width=0.02)
    df = cells(spark, [20.0, 30.0])
    assert as_fraction(df, ["mitoRatio"]).agg(F.max("mitoRatio")).first()[0] == 0.3
    with pytest.warns(UserWarning):
        assert checked_ratio(df, "mitoRatio").agg(F.max("mitoRatio")).first()[0] == 0.3
    for values in ([200.0], [-0.1], [float("nan")], [None]):
        with pytest.raises(ValueError):
            checked_ratio(cells(spark, values), "mitoRatio")
    with pytest.raises(ValueError):
        check_cells(cells(spark, [0.1, None]), Columns())
    with pytest.raises(ValueError):
        check_cells(df.drop("sample"), Columns())


def test_quality_control(spark):
    df = cells(spark, [0.24] * 20 + [0.02] * 80).unionAll(cells(spark, [0.3] * 30 + [0.05] * 70, "B"))
    with pytest.warns(UserWarning):
        per_cent = qc_multi(df, max_mito=20)
    fraction = qc_multi(df, max_mito=0.2, mode="all")
    assert per_cent.cells.count() == fraction.cells.count() == 150
    rows = {r.Stage: r for r in fraction.summary.collect()}
    assert rows["after"].RetentionRate == 0.75 and rows["before"].CellsRemoved == 0 and rows["after"].MitoRatio_median == 0.02
    assert {r["sample"]: r.cells_removed for r in fraction.tables["split_summary"].collect()} == {"A": 20, "B": 30}
    with pytest.raises(ValueError):
        qc_multi(df, max_mito=0.03)
    one = qc_one(df, max_mito=0.2, remove_doublets=True, doublets=lambda c: c.where("cell_id % 2 = 0"))
    assert one.cells.count() == 75 and one.provenance["doublets"]["status"] == "completed"
    failed = qc_one(df, max_mito=0.2, remove_doublets=True, doublets=lambda c: 1 / 0)
    assert failed.cells.count() == 150 and failed.provenance["doublets"]["status"] == "failed"
    with pytest.warns(UserWarning, match="one sample"):
        plan = qc_multi(df, Columns(group="grp"), strategy="groupwise").plan
    assert plan.final()["final_cutoff"] == max(r.group_cutoff for r in plan.groups.collect())
    with pytest.raises(ValueError):
        cutoff_plan.sample_groups(df.withColumn("grp", F.col("cell_id").cast("string")), Columns(group="grp"))


def test_features(spark):
    rows = [(f, c, n) for f, pair in {"ATP6": (10, 5), "ND1": (20, 15), "ACTB": (80, 90)}.items() for c, n in zip("xy", pair)]
    counts = spark.createDataFrame(rows, "feature string, cell_id string, count int")
    empty = spark.createDataFrame([("x",), ("y",)], "cell_id string")
    got = {r.cell_id: r.mitoRatio for r in features.ensure_mito_ratio(empty, counts, species="pig").collect()}
    assert got == {"x": 30 / 110, "y": 20 / 110}
    assert features.add_mito_ratio(empty, counts, "percent", species="pig").where("cell_id = 'x'").first().mitoRatio == pytest.approx(3000 / 110)
    with pytest.raises(ValueError, match="no mitochondrial features"):
        features.ensure_mito_ratio(empty, counts, species="human", pattern="^MT-")
    with pytest.raises(ValueError):
        features.ensure_mito_ratio(empty, counts, auto_add=False)
    names = spark.createDataFrame([("MT-ND1", "a"), ("MT-CO1", "b"), ("MT-CO2", "c"), ("MT-ATP6", "d"), ("GeneA", "MT-X"), ("GeneB", None)], "feature string, symbol string")
    assert features.mito_features(names, "human").count() == 4
    assert [tuple(r) for r in features.mito_features(names.where("feature like 'Gene%'"), "human").collect()] == [("GeneA", "feature_metadata:symbol")]
    low = names.select(F.lower("feature").alias("feature"))
    assert {r.source for r in features.mito_features(low, "human").collect()} == {"feature_names_case_insensitive"}
    assert features.mito_features(names, listed=["GeneB", "none"]).first().source == "user_supplied_features"
    assert features.resolved_species("hum") == "human"
    with pytest.raises(ValueError):
        features.resolved_species("c")


def test_tables(spark):
    assert tables.reference_cutoffs(spark).count() == 6
    assert [r.tissue for r in tables.reference_cutoffs(spark, "Human", "pbmc").collect()] == ["PBMC"]
    assert tables.reference_cutoffs(spark, tissue="liver").count() == 0
    assert tables.reference_for("human", "liver").tissue == "global" and not tables.reference_for("yak").found
    assert tables.reference_for(given=0.07).source == "user_provided"
    own = spark.createDataFrame([("yak", "milk", 0.33)], "species string, tissue string, reference_cutoff double")
    assert tables.reference_for("Yak", "milk", table=own).cutoff == 0.33
    assert tables.manifest(spark).count() == 13 and tables.manifest(spark, species=["Human"]).count() == 0
    assert tables.methods(spark)["p_adjust_methods"].where("method = 'none'").count() == 2
