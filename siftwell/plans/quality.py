"""Quality control of one sample or many: plan, filter, summaries, provenance."""

from __future__ import annotations

import platform
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import __version__
from siftwell.operators import qc
from siftwell.plans.cutoff_plan import Plan, build_plan, warn_small_groups
from siftwell.plans.detection import Detected, detect
from siftwell.schema import ADAPTIVE, Bounds, Columns, Detection, check_columns, mito_cutoff
from siftwell.storage import narrowed


@dataclass
class Result:
    """Kept cells (lazy), summary tables and how they came about."""

    cells: DataFrame
    summary: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)
    plan: Plan | None = None
    detection: Detected | None = None


def provenance(name: str, **more) -> dict:
    return {"function": name, "version": __version__, "spark": pyspark.__version__, "python": platform.python_version(), "time": datetime.now(UTC).isoformat(timespec="seconds")} | more


def options(base: Detection | None, changes: dict | None) -> Detection:
    """base with changes; a None goes back to the default."""
    base = base or Detection()
    return replace(base, **{k: getattr(Detection(), k) if v is None else v for k, v in (changes or {}).items()})


def none_left(summary: DataFrame) -> bool:
    return summary.where("Stage = 'after' and CellCounts = 0").count() > 0


def qc_one(cells: DataFrame, columns: Columns | None = None, bounds: Bounds | None = None, max_mito: float | str = ADAPTIVE, use_recommended: bool = True, params: Detection | None = None, doublets: qc.Doublets | None = None, remove_doublets: bool = False, fail: str = "continue", check: bool = True) -> Result:
    """All cells as one sample. Of params only species, tissue and reference count for an adaptive cutoff."""
    cols, bounds = columns or Columns(), bounds or Bounds()
    check_columns(cells, [cols.n_feature, cols.n_count, cols.mito], [cols.n_feature, cols.n_count, cols.mito])
    some = narrowed(cells, cols.n_feature, cols.n_count, cols.mito)
    found, source = None, "user_defined"
    if mito_cutoff(max_mito, adaptive=True) == ADAPTIVE:
        p = params or Detection()
        own = Detection(species=p.species, tissue=p.tissue, reference_cutoff=p.reference_cutoff, reference_warning=p.reference_warning)
        found = detect(some.withColumn("__one", F.lit("A")), replace(cols, sample="__one", group=None), own, check=check, narrow=False)
        row = found.summary.select("recommended_cutoff", "selected_cutoff").first()
        source = "recommended_cutoff" if use_recommended and row["recommended_cutoff"] is not None else "selected_cutoff"
        upper = row[source]
        if upper is None:
            upper, source = found.cutoff(), "sample_supported_global_cutoff"
        if upper is None:
            raise ValueError("no cutoff was detected")
    else:
        upper = mito_cutoff(max_mito)
    if bounds.min_mito > upper:
        raise ValueError("min_mito is greater than max_mito")
    summary = qc.summary(some, cols, qc.keep(cols, bounds, F.lit(upper)), F.lit(upper))
    if check and none_left(summary):
        raise ValueError("no cell passes the filters")
    kept, status = qc.without_doublets(qc.filter_cells(cells, cols, bounds, upper), doublets, remove_doublets, fail)
    return Result(kept, summary, {}, provenance("qc_one", cutoff=upper, source=source, bounds=asdict(bounds), doublets=status), None, found)


def split_summary(marked: DataFrame, cols: Columns, samples: DataFrame) -> DataFrame:
    """One row a sample: cutoff, cells before and after, removed, retention."""
    counts = qc.level_counts(marked, cols.sample, F.col("__keep")).withColumnRenamed("level_id", "sample")
    side = samples.select(F.col("sample_id").alias("sample"), F.col("group_id").alias("group"), "applied_cutoff", "cutoff_strategy")
    return counts.join(side, "sample").select("sample", "group", "applied_cutoff", "cutoff_strategy", "before_cells", "after_cells", (F.col("before_cells") - F.col("after_cells")).alias("cells_removed"), "retention_rate")


def qc_multi(cells: DataFrame, columns: Columns | None = None, bounds: Bounds | None = None, mode: str = "split", max_mito: float | str = ADAPTIVE, strategy: str = "consensus", fraction: float = 0.5, params: Detection | None = None, changes: dict | None = None, use_recommended: bool = True, doublets: qc.Doublets | None = None, remove_doublets: bool = False, fail: str = "continue", detected: Detected | None = None, check: bool = True) -> Result:
    """Many samples. Both modes filter alike in one pass; split asks that each sample keeps a cell. Tables count cells before doublets go."""
    cols, bounds = columns or Columns(), bounds or Bounds()
    if mode not in ("all", "split"):
        raise ValueError("mode must be all or split")
    check_columns(cells, [cols.sample, cols.n_feature, cols.n_count, cols.mito], [cols.n_feature, cols.n_count, cols.mito])
    some = narrowed(cells, cols.sample, cols.group, cols.n_feature, cols.n_count, cols.mito)
    plan = build_plan(some, cols, max_mito, strategy, fraction, options(params, changes), use_recommended, detected=detected, check=check, narrow=False)
    if check and strategy == "groupwise" and cols.group:
        warn_small_groups(plan.samples)
    joined = qc.with_cutoffs(some, cols, plan.samples)
    keep = qc.keep(cols, bounds, F.col("applied_cutoff"))
    summary = qc.summary(joined, cols, keep, F.col("applied_cutoff"))
    table = split_summary(joined.withColumn("__keep", keep), cols, plan.samples)
    if check and (table.where("after_cells = 0").limit(1).count() if mode == "split" else none_left(summary)):
        raise ValueError("a sample has no cell that passes the filters" if mode == "split" else "no cell passes the filters")
    kept = qc.with_cutoffs(cells, cols, plan.samples).where(keep).drop("applied_cutoff")
    kept, status = qc.without_doublets(kept, doublets, remove_doublets, fail)
    tables = {"split_summary": table, "all_summary": summary, "cutoff_plan": plan.samples, "group_cutoffs": plan.groups}
    return Result(kept, summary, tables, provenance("qc_multi", mode=mode, strategy=strategy, source=plan.source, level=plan.level, bounds=asdict(bounds), doublets=status, settings=plan.detection.settings() if plan.detection else None), plan, plan.detection)
