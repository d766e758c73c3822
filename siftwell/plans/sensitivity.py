"""Sensitivity of sample cutoffs to parameters, in one job.

Only the bin width changes the profile, only it and the loss test change p-values; alpha and the least loss fraction
change flags on that table, and the selection rule changes which flagged interval is picked.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import numerics as N
from siftwell.operators import cutoffs, losstest, profile
from siftwell.plans.detection import with_support
from siftwell.schema import LOSS_TESTS, SELECTIONS, Columns, Detection, check_cells, choice
from siftwell.sources.tables import reference_for
from siftwell.storage import narrowed, stored

FIRST = ["sample", "parameter_id", "bin_width", "alpha", "min_drop_fraction", "loss_test", "sample_cutoff_method", "detected_cutoff", "cutoff_source", "retained_cells_at_cutoff", "retention_fraction_at_cutoff", "global_cutoff"]


@dataclass
class Sweep:
    table: DataFrame
    summary: DataFrame


def sweep(cells: DataFrame, columns: Columns | None = None, bin_width: tuple[float, ...] = (0.01, 0.02), alpha: tuple[float, ...] = (0.01, 0.05, 0.10), min_drop_fraction: tuple[float, ...] = (0.005, 0.01, 0.02), loss_test: tuple[str, ...] = ("mad_zscore", "empirical_tail"), selection: tuple[str, ...] = ("largest_drop", "first_significant_high", "reference_guided"), params: Detection | None = None, check: bool = True) -> Sweep:
    cols, base = columns or Columns(), params or Detection()
    for x in loss_test:
        choice(x, "loss_test", LOSS_TESTS)
    for x in selection:
        choice(x, "selection", SELECTIONS)
    if check:
        check_cells(cells, cols)
    spark = cells.sparkSession
    cells = narrowed(cells, cols.sample, cols.mito)
    ref = reference_for(base.species, base.tissue, base.reference_cutoff)
    some = cells.select(F.col(cols.sample).cast("string").alias("sample"), F.col(cols.mito).alias("m"))
    raw = stored(N.quantile8(some, "sample", "m", base.fallback_quantile), "quantiles") if base.fallback == "quantile" else None  # one row a sample
    na, nm, nb, nl = len(alpha), len(min_drop_fraction), len(bin_width), len(loss_test)
    flags = spark.createDataFrame([(float(a), float(m), i) for i, (m, a) in enumerate(itertools.product(min_drop_fraction, alpha))], "alpha double, min_drop_fraction double, k int")
    out = None
    for ib, w in enumerate(bin_width):
        p = replace(base, bin_width=w)
        prof = stored(profile.profile(cells, cols, p), "profile")  # samples x grid rows
        losses = profile.interval_losses(prof, p)
        back = raw.select("sample", N.snap(F.col("q"), w, p.min_cut, p.max_cut).alias("fallback_cutoff")) if raw is not None else None
        for il, test in enumerate(loss_test):
            p = replace(p, loss_test=test)
            judged = stored(losstest.judged(losses, p).drop("is_significant", "passes_min_drop_fraction", "passes_candidate_filters"), "judged")  # as many
            every = judged.crossJoin(F.broadcast(flags))  # a few parameter rows
            ok = F.col("passes_min_drop_cells") & F.col("passes_min_cells_after") & F.col("passes_min_retention_after") & (F.col("interval_loss_fraction") >= F.col("min_drop_fraction"))
            sig = ok if test == "threshold_only" else ok & F.coalesce(F.col("p_adj") <= F.col("alpha"), F.lit(False))
            every = every.withColumn("is_significant", sig)
            for ix, rule in enumerate(selection):
                q = replace(p, selection=rule)
                rows = cutoffs.summary(every, prof, back, q, ref, ("alpha", "min_drop_fraction", "k"))
                rows, found, _ = with_support(rows, q, ["alpha", "min_drop_fraction", "k"])
                rows = rows.join(found.select("k", "global_cutoff"), "k")
                number = F.lit(1 + ib) + nb * (F.col("k") + F.lit(na * nm * (il + nl * ix)))
                rows = rows.withColumns({"parameter_id": F.format_string("P%03d", number.cast("int")), "bin_width": F.lit(float(w))}).drop("k")
                out = rows if out is None else out.unionByName(rows)
    table = out.select(*FIRST, *(c for c in out.columns if c not in FIRST))
    return Sweep(table, summarise(table))


def summarise(table: DataFrame) -> DataFrame:
    """One row a sample: quartiles (type 8) and range of the cutoffs, shares of fallbacks and of low confidence."""
    q = N.quantile8_small(table, ["sample"], "detected_cutoff", {"q1": 0.25, "cutoff_median": 0.5, "q3": 0.75})
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    counts = table.groupBy("sample").agg(
        F.count("*").alias("n_parameter_combinations"), F.min("detected_cutoff").alias("cutoff_min"), F.max("detected_cutoff").alias("cutoff_max"),
        share(F.col("fallback_used")).alias("fallback_fraction"), share(F.col("cutoff_source") == "not_detected").alias("not_detected_fraction"), share(F.col("cutoff_confidence") == "low").alias("low_confidence_fraction"))
    return counts.join(q, "sample").select("sample", "n_parameter_combinations", "cutoff_median", (F.col("q3") - F.col("q1")).alias("cutoff_iqr"), "cutoff_min", "cutoff_max", "fallback_fraction", "not_detected_fraction", "low_confidence_fraction")
