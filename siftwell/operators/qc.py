"""Filtering of cells and summaries before and after."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.numerics import medians
from siftwell.schema import Bounds, Columns
from siftwell.storage import stored


def keep(cols: Columns, bounds: Bounds, upper: Column) -> Column:
    """All bounds inclusive; a null keeps nothing, an infinite bound asks nothing."""
    g, u, m = F.col(cols.n_feature), F.col(cols.n_count), F.col(cols.mito)
    tests = [g >= bounds.min_genes, u >= bounds.min_counts, m >= bounds.min_mito, m <= upper]
    tests += [c <= top for c, top in ((g, bounds.max_genes), (u, bounds.max_counts)) if math.isfinite(top)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def filter_cells(cells: DataFrame, cols: Columns, bounds: Bounds, upper: float | Column) -> DataFrame:
    """Plain predicates, so Parquet sees them."""
    return cells.where(keep(cols, bounds, F.lit(float(upper)) if isinstance(upper, (int, float)) else upper))


def outcome(after: Column, before: Column) -> tuple[Column, Column]:
    """Removed cells and retention rate (four places)."""
    return before - after, F.round(after / before, 4)


def metrics(rows: DataFrame, key: str, cols: Columns) -> DataFrame:
    """key, CellCounts and exact medians (nulls aside)."""
    middle = {"GenesCounts_median": (cols.n_feature, 1), "TranscriptCounts_median": (cols.n_count, 1), "MitoRatio_median": (cols.mito, 10_000)}
    return rows.groupBy(key).agg(F.count("*").alias("CellCounts")).join(medians(rows, key, middle), key, "left")


def summary(cells: DataFrame, cols: Columns, kept: Column, cutoff: Column) -> DataFrame:
    """Two rows, before and after; medians come from counted values, so no task holds all cells."""
    stage = F.array_compact(F.array(F.lit("before"), F.when(kept, "after")))
    long = cells.select(F.explode(stage).alias("Stage"), cols.n_feature, cols.n_count, cols.mito)
    found = metrics(long, "Stage", cols)
    stages = cells.sparkSession.createDataFrame([("before",), ("after",)], "Stage string")
    total = cells.agg(F.count("*").alias("n"), F.max(cutoff).alias("MitoCutoff"))
    out = stages.join(found, "Stage", "left").crossJoin(F.broadcast(total)).withColumn("CellCounts", F.coalesce("CellCounts", F.lit(0)))  # one row
    removed, rate = outcome(F.col("CellCounts"), F.col("n"))
    return out.withColumns({"CellsRemoved": removed, "RetentionRate": rate}).drop("n")


def with_cutoffs(cells: DataFrame, cols: Columns, samples: DataFrame) -> DataFrame:
    """cells with applied_cutoff of their sample; the plan has a row a sample, and Spark picks the join by its size."""
    side = samples.select(F.col("sample_id").alias("__sample"), "applied_cutoff")
    return cells.join(side, F.col(cols.sample).cast("string") == F.col("__sample"), "left").drop("__sample")


def level_counts(cells: DataFrame, column: str, kept: Column) -> DataFrame:
    """level_id, before_cells, after_cells, retention_rate; what is kept is part of what was, so no join."""
    out = cells.groupBy(F.col(column).cast("string").alias("level_id")).agg(F.count("*").alias("before_cells"), F.count_if(kept).alias("after_cells"))
    return out.withColumn("retention_rate", outcome(F.col("after_cells"), F.col("before_cells"))[1])


Doublets = Callable[[DataFrame], DataFrame]


def expected_doublets(n: int) -> int | None:
    """How many doublets a sample of n cells is expected to hold; None: too few cells to look."""
    return None if n < 50 else round(n / 5000 * 0.039 * n)


def without_doublets(cells: DataFrame, remove: Doublets | None, requested: bool, fail: str = "continue") -> tuple[DataFrame, dict]:
    """Applies a function that removes doublets from all cells at once (they hold the sample column to work by). A warning or an error leaves the cells as they were, or is raised with fail='stop'."""
    import warnings

    if not requested:
        return cells, {"requested": False, "status": "not_requested", "error": None}
    if remove is None:
        return cells, {"requested": True, "status": "skipped", "error": "no doublet function is set"}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            # stored here, so that what fails at run time fails under this guard
            return stored(remove(cells), "singlets"), {"requested": True, "status": "completed", "error": None}
    except Exception as e:
        if fail == "stop":
            raise
        return cells, {"requested": True, "status": "failed", "error": str(e)}
