"""Cutoff detection: cells in, profile, interval losses, sample summary and supported cutoffs out; these are lazy."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import cutoffs, losstest, profile, support
from siftwell.schema import Columns, Detection, check_cells, check_columns
from siftwell.sources.tables import Reference, reference_for
from siftwell.storage import narrowed


@dataclass
class Detected:
    """The tables of one detection."""

    profile: DataFrame
    interval_losses: DataFrame
    summary: DataFrame
    support: DataFrame
    recommended_support: DataFrame
    columns: Columns
    params: Detection
    reference: Reference

    @property
    def significant(self) -> DataFrame:
        return self.interval_losses.where("is_significant")

    def wide_profile(self) -> DataFrame:
        return profile.wide_profile(self.profile, self.params, self.columns.sample)

    def cutoff(self) -> float | None:
        """The cutoff that enough samples support; runs a job."""
        return self.support.first()["global_cutoff"]

    def mode(self) -> str:
        p = self.params
        if p.loss_test == "threshold_only":
            return "rule_based_sensitivity"
        if p.p_adjust == "none":
            return "unadjusted_sensitivity_mode"
        return "primary_fdr_mode" if p.loss_test == "mad_zscore" else "sensitivity_exploratory_mode"

    def settings(self) -> dict:
        return asdict(self.params) | asdict(self.columns) | {"detector_mode": self.mode(), "reference": asdict(self.reference)}


def with_support(rows: DataFrame, p: Detection, by: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sample summary with the two support flags; support of selected and of recommended cutoffs."""
    found = support.resolved(rows, "detected_cutoff", p.min_sample_support, by)
    advised = support.resolved(rows, "recommended_cutoff", p.min_sample_support, by, "recommended_sample_supported_global_cutoff")
    keys = list(by)
    a, b = found.select(*keys, F.col("global_cutoff").alias("__g")), advised.select(*keys, F.col("global_cutoff").alias("__r"))
    # one row each, or one for each value of `by`
    both = rows.join(a, keys, "left").join(b, keys, "left") if keys else rows.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))
    flag = lambda c, g: F.coalesce(F.col(c) >= F.col(g), F.lit(False))
    return both.withColumns({"supports_final_cutoff": flag("detected_cutoff", "__g"), "supports_recommended_final_cutoff": flag("recommended_cutoff", "__r")}).drop("__g", "__r"), found, advised


def detect(cells: DataFrame, columns: Columns | None = None, params: Detection | None = None, reference_table: DataFrame | None = None, check: bool = True, narrow: bool = True) -> Detected:
    """Cutoffs of all samples. check: one aggregation first, for nulls. narrow: cells are read several times, so the columns in use are stored; False if they are already."""
    cols, p = columns or Columns(), params or Detection()
    if check:
        check_columns(cells, [c for c in (cols.sample, cols.mito, cols.group) if c], [cols.mito])
    if narrow:
        cells = narrowed(cells, cols.sample, cols.mito, cols.group if check else None)
    if check:
        check_cells(cells, cols)
    ref = reference_for(p.species, p.tissue, p.reference_cutoff, reference_table)
    # tables of samples x grid rows and of a row a sample, which several plans read: kept, and computed anew if lost
    prof = profile.profile(cells, cols, p).persist()
    losses = losstest.judged(profile.interval_losses(prof, p), p).persist()
    rows = cutoffs.summary(losses, prof, cutoffs.fallbacks(cells, cols, p), p, ref).persist()
    table, found, advised = with_support(rows, p)
    return Detected(prof, losses, table, found, advised, cols, p, ref)
