"""Plans read their cells once, however many tables they make of them: cells may be a join of large tables."""

import pytest
from pyspark.sql import functions as F

from siftwell.plans import benchmark, cutoff_plan
from siftwell.plans.detection import detect
from siftwell.plans.quality import qc_multi
from siftwell.schema import Columns

N = 400
COLS = Columns(group="grp")


@pytest.fixture
def counted(spark):
    """Cells of four samples, and how often a cell was computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def ratio(i):
        seen.add(1)
        return (i * 37 % 100) / 250

    i = F.col("id")
    cells = spark.range(N).select(i.alias("cell_id"), ratio(i).alias("mitoRatio"), F.concat(F.lit("s"), i % 4).alias("sample"), F.concat(F.lit("g"), i % 2).alias("grp"), (i % 9 + 200).alias("nFeature_RNA"), (i % 7 + 500).cast("double").alias("nCount_RNA"))
    # every column comes from the rows that the function has made
    return cells.where("mitoRatio >= 0"), seen


def passes(seen, run):
    before = seen.value
    run()
    return (seen.value - before) / N


def test_plans_read_cells_once(spark, counted):
    cells, seen = counted
    once = passes(seen, lambda: cells.select("sample", "mitoRatio", "grp").write.format("noop").mode("overwrite").save())
    assert passes(seen, lambda: cutoff_plan.build_plan(cells, COLS, strategy="strictest").samples.collect()) == once
    assert passes(seen, lambda: detect(cells, COLS, check=False).summary.collect()) == once

    def tables():
        got = qc_multi(cells, COLS, check=False)
        got.summary.collect(), got.tables["split_summary"].collect()

    assert passes(seen, tables) == once


def test_plan_of_read_cells_is_the_same(spark, counted):
    cells, _ = counted
    assert cutoff_plan.build_plan(cells, COLS, narrow=False).samples.collect() == cutoff_plan.build_plan(cells, COLS).samples.collect()
    with pytest.raises(ValueError, match="missing columns"):
        cutoff_plan.build_plan(cells.drop("mitoRatio"), COLS)


def test_comparison_reads_cells_once(spark, counted):
    cells, seen = counted
    few = [benchmark.Strategy("fixed_20", max_mito=0.2), benchmark.Strategy("adaptive_strictest", cutoff_strategy="strictest")]
    once = passes(seen, lambda: cells.select("sample", "mitoRatio", "grp").write.format("noop").mode("overwrite").save())
    found = []
    assert passes(seen, lambda: found.append(benchmark.compare(cells, COLS, few, check=False))) == once
    got = found[0]
    assert passes(seen, lambda: found.append({r.strategy: r for r in got.summary.collect()})) == 0
    below = sorted(r.mitoRatio for r in cells.collect() if r.mitoRatio <= 0.2)
    row = found[1]["fixed_20"]
    assert row.total_cells_after == len(below) and row.median_mito_after == (below[(len(below) - 1) // 2] + below[len(below) // 2]) / 2
    rates = []
    assert passes(seen, lambda: rates.extend(got.sample_retention.collect())) == 0
    assert len(rates) == 8 and sum(r.after_cells for r in rates if r.strategy == "fixed_20") == len(below) and all(r.before_cells == N / 4 for r in rates)
    # the cells handed out keep all their columns
    assert set(got.kept.columns) == {*cells.columns, "strategies"} and benchmark.strategy_cells(got, "fixed_20").count() == len(below)
