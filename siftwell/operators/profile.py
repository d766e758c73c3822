"""Retained-cell profiles and interval losses.

The profile counts, for each sample and cutoff c, the cells with m < c. Instead of comparing cells with cutoffs, each
cell gets the number of cutoffs above its value (the grid descends, so these are a prefix); counting cells by sample and
that number is one aggregation of at most samples x (grid + 1) rows, and a running sum over it gives the profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.schema import Columns, Detection


def grid_column(p: Detection) -> Column:
    return F.expr(f"array({', '.join(f'{c!r}D' for c in p.grid)})")


def cutoffs_above(m: Column, p: Detection) -> Column:
    """How many cutoffs of the grid are greater than m; compared with the grid's own values."""
    values, n = grid_column(p), len(p.grid)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((F.lit(p.max_cut) - m) / p.bin_width).cast("int") - 2))
    return guess + sum(((guess + k < n) & (m < F.coalesce(F.get(values, guess + k), F.lit(-1.0)))).cast("int") for k in range(4))


def histogram(cells: DataFrame, cols: Columns, p: Detection) -> DataFrame:
    """sample, r (cutoffs above), n; cells with a null or NaN value count in no interval but in the sample's number."""
    m = F.col(cols.mito).cast("double")
    r = F.when(m.isNull() | F.isnan(m), 0).otherwise(cutoffs_above(m, p))
    return cells.select(F.col(cols.sample).cast("string").alias("sample"), r.alias("r")).groupBy("sample", "r").agg(F.count("*").alias("n"))


def profile(cells: DataFrame, cols: Columns | None = None, p: Detection | None = None, hist: DataFrame | None = None) -> DataFrame:
    """sample, idx, cutoff, n_cells, retained_cells, retention_fraction; one row for each sample and cutoff."""
    cols, p = cols or Columns(), p or Detection()
    hist = histogram(cells, cols, p) if hist is None else hist
    n = len(p.grid)
    # one row a sample: counts by number of cutoffs above, as a map of at most grid + 1 entries
    by_sample = hist.groupBy("sample").agg(F.sum("n").alias("n_cells"), F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("at"))
    dense = by_sample.select("sample", "n_cells", F.transform(F.sequence(F.lit(0), F.lit(n)), lambda r: F.coalesce(F.try_element_at("at", r), F.lit(0))).alias("c"))
    long = dense.select("sample", "n_cells", F.posexplode(F.slice("c", 2, n)).alias("idx", "more"))
    down = Window.partitionBy("sample").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.sum("more").over(down)
    return long.select("sample", "idx", F.get(grid_column(p), F.col("idx")).alias("cutoff"), "n_cells", kept.alias("retained_cells"), (kept / F.col("n_cells")).alias("retention_fraction"))


def wide_profile(prof: DataFrame, p: Detection, sample: str = "sample") -> DataFrame:
    """One row a sample with a column for each cutoff; the values are given, so no job looks for them."""
    named = prof.withColumn("c", F.format_number("cutoff", 6))
    values = [f"{c:.6f}" for c in p.grid]
    out = named.groupBy(F.col("sample").alias(sample), F.col("n_cells").alias("raw_counts")).pivot("c", values).agg(F.first("retained_cells"))
    return out.select(sample, "raw_counts", *(F.col(f"`{v}`").alias(f"{float(v):g}") for v in values))


def interval_losses(prof: DataFrame, p: Detection | None = None) -> DataFrame:
    """One row for each interval between neighbouring cutoffs, with the candidate filters."""
    p = p or Detection()
    along = Window.partitionBy("sample").orderBy("idx")
    both = prof.withColumns({"previous_cutoff": F.lag("cutoff").over(along), "before": F.lag("retained_cells").over(along)}).where("idx > 0")
    loss = F.greatest(F.col("before") - F.col("retained_cells"), F.lit(0))
    out = both.select("sample", F.col("idx").alias("interval_index"), "previous_cutoff", "cutoff", "n_cells", "retained_cells", "retention_fraction", loss.alias("interval_loss"))
    out = out.withColumn("interval_loss_fraction", F.col("interval_loss") / F.col("n_cells"))
    return candidate_filters(out, p)


def candidate_filters(losses: DataFrame, p: Detection) -> DataFrame:
    tests = {
        "passes_min_drop_cells": F.col("interval_loss") >= p.min_drop_cells,
        "passes_min_drop_fraction": F.col("interval_loss_fraction") >= p.min_drop_fraction,
        "passes_min_cells_after": F.col("retained_cells") >= p.min_cells_after,
        "passes_min_retention_after": F.col("retention_fraction") >= p.min_retention_after,
    }
    every = None
    for t in tests.values():
        every = t if every is None else every & t
    return losses.withColumns(tests | {"passes_candidate_filters": every})
