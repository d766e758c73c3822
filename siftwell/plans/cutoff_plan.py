"""The cutoff that applies to each sample: detected or fixed, brought together by a strategy."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import support
from siftwell.plans.detection import Detected, detect
from siftwell.schema import ADAPTIVE, STRATEGIES, Columns, Detection, check_columns, choice, mito_cutoff, open_unit
from siftwell.storage import narrowed, stored


@dataclass
class Plan:
    """samples: one row a sample; groups: one row a group (all_samples without groups)."""

    samples: DataFrame
    groups: DataFrame
    strategy: str
    level: str
    source: str
    columns: Columns
    detection: Detected | None = None

    def final(self) -> dict[str, float | None]:
        """Final, selected and recommended cutoffs of the strategy; one small job."""
        return self.samples.agg(F.max("final_cutoff").alias("final_cutoff"), F.max("final_selected_cutoff").alias("final_selected_cutoff"), F.max("final_recommended_cutoff").alias("final_recommended_cutoff")).first().asDict()


def sample_groups(cells: DataFrame, cols: Columns, check: bool = True) -> DataFrame:
    """sample_id, group_id, cells; a sample with no group or several is an error."""
    group = F.col(cols.group).cast("string") if cols.group else F.lit("all_samples")
    rows = cells.groupBy(F.col(cols.sample).cast("string").alias("sample_id")).agg(F.count("*").alias("n"), F.min(group).alias("group_id"), F.max(group).alias("__last"), F.count_if(group.isNull()).alias("__none"))
    if check and cols.group:
        bad = rows.where("__none > 0 or group_id <> __last or group_id is null").select("sample_id").limit(5).collect()
        if bad:
            raise ValueError(f"samples without exactly one group: {', '.join(r[0] or 'null' for r in bad)}")
    return rows.select("sample_id", "group_id", "n")


def warn_small_groups(samples: DataFrame) -> list[str]:
    """Groups of fewer than two samples, with a warning."""
    small = [r[0] for r in samples.groupBy("group_id").count().where("count < 2").orderBy("group_id").collect()]  # one row a group
    if small:
        warnings.warn(f"groups with one sample: {', '.join(small)}", stacklevel=2)
    return small


def level_cutoff(samples: DataFrame, column: str, strategy: str, fraction: float, grouped: bool) -> DataFrame:
    """One row `c`: what the strategy makes of a column."""
    if strategy == "strictest":
        return samples.agg(F.min(column).alias("c"))
    if strategy == "groupwise" and grouped:
        return support.resolved(samples, column, fraction, ["group_id"]).agg(F.max("global_cutoff").alias("c"))
    return support.resolved(samples, column, fraction).select(F.col("global_cutoff").alias("c"))


def build_plan(cells: DataFrame, columns: Columns | None = None, max_mito: float | str = ADAPTIVE, strategy: str = "consensus", fraction: float = 0.5, params: Detection | None = None, use_recommended: bool = True, cutoff_quantile: float = 0.25, detected: Detected | None = None, groups_of: DataFrame | None = None, check: bool = True, narrow: bool = True) -> Plan:
    """detected, groups_of: a detection with the same parameters and the samples' groups, if they are at hand already. cutoff_quantile is checked, and unused. narrow: as in detect()."""
    cols = columns or Columns()
    choice(strategy, "cutoff_strategy", STRATEGIES)
    open_unit(fraction, "cutoff_support_fraction")
    open_unit(cutoff_quantile, "cutoff_quantile")
    adaptive = max_mito == ADAPTIVE
    if check and adaptive:
        check_columns(cells, [c for c in (cols.sample, cols.mito, cols.group) if c], [cols.mito])
    if narrow and adaptive and detected is None:
        cells = narrowed(cells, cols.sample, cols.mito, cols.group)
    base = (groups_of if groups_of is not None else stored(sample_groups(cells, cols, check), "groups")).drop("n")  # one row a sample
    if adaptive:
        detected = detected or detect(cells, cols, params, check=check, narrow=False)
        # one row a sample: written once, as several steps read it
        rows = stored(base.join(detected.summary.withColumnRenamed("sample", "sample_id"), "sample_id", "left"), "samples")
        if check and rows.where("detected_cutoff is null").limit(1).count():
            raise ValueError("a sample has no detected cutoff")
        # recommended cutoffs apply if any sample has one
        any_ = F.max(F.col("recommended_cutoff").isNotNull()).over(Window.partitionBy(F.lit(0)))  # one row a sample
        use = any_ if use_recommended else F.lit(False)
        rows = rows.withColumn("__use", use).withColumns({"sample_cutoff": F.when(F.col("__use"), F.col("recommended_cutoff")).otherwise(F.col("selected_cutoff")), "cutoff_applied_source": F.when(F.col("__use"), "recommended_cutoff").otherwise("selected_cutoff")}).drop("__use")
        source = "recommended_cutoff" if use_recommended else "selected_cutoff"
    else:
        c = F.lit(float(mito_cutoff(max_mito)))
        text = {"recommended_method": "user_defined", "recommendation_level": "standard", "recommendation_source": "user_defined", "cutoff_applied_source": "user_defined", "cutoff_source": "user_defined", "cutoff_confidence": "user_defined", "fallback_method": None}
        rows = base.withColumns({n: c for n in ("detected_cutoff", "selected_cutoff", "recommended_cutoff", "sample_cutoff")} | {n: F.lit(v).cast("string") for n, v in text.items()} | {"significant_cutoff_count": F.lit(0), "significant_interval_count": F.lit(0), "fallback_used": F.lit(False), "fallback_quantile": F.lit(None).cast("double")})
        source = "user_defined"
    grouped = cols.group is not None
    one = level_cutoff(rows, "sample_cutoff", strategy, fraction, grouped).withColumnRenamed("c", "final_cutoff")
    rows = rows.crossJoin(F.broadcast(one))  # one row
    level = "global"
    if strategy == "groupwise" and grouped:
        found = support.resolved(rows, "sample_cutoff", fraction, ["group_id"])
        rows = rows.join(found.select("group_id", F.col("global_cutoff").alias("group_cutoff")), "group_id", "left")
        level = "group"
    elif strategy == "groupwise":
        found = support.resolved(rows, "sample_cutoff", fraction).withColumn("group_id", F.lit("all_samples"))
        rows, level = rows.withColumn("group_cutoff", F.col("sample_cutoff")), "sample"
    else:
        found = support.summarised(rows, F.max("final_cutoff"), "sample_cutoff", fraction).withColumn("group_id", F.lit("all_samples"))
        rows = rows.withColumn("group_cutoff", F.col("final_cutoff"))
    for name, column in (("final_selected_cutoff", "selected_cutoff"), ("final_recommended_cutoff", "recommended_cutoff")):
        if (name == "final_selected_cutoff") == (source != "recommended_cutoff"):
            rows = rows.withColumn(name, F.col("final_cutoff"))
        else:
            rows = rows.crossJoin(F.broadcast(level_cutoff(rows, column, strategy, fraction, grouped).withColumnRenamed("c", name)))  # one row
    rows = rows.withColumns({
        "applied_cutoff": F.col("group_cutoff"), "cutoff_strategy": F.lit(strategy), "aggregation_level": F.lit(level), "sample_by": F.lit(cols.sample),
        "group_by": F.lit(cols.group).cast("string"), "supports_final_cutoff": F.col("sample_cutoff") >= F.col("final_cutoff"),
    })
    groups = found.select("group_id", F.col("global_cutoff").alias("group_cutoff"), "sample_count", "support_count", "support_fraction", "required_support", "global_cutoff", "n_supporting_samples", "n_total_samples", F.lit(strategy).alias("strategy"), F.col("group_id").alias("group"))
    rows = stored(rows, "plan")
    return Plan(rows, groups, strategy, level, source, cols, detected)
