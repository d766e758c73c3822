"""From judged intervals to one row a sample: selected and recommended cutoffs, warnings, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import numerics as N
from siftwell.schema import Columns, Detection
from siftwell.sources.tables import Reference

# What the tokens of the summary mean, in words.
SELECTED_MEANING = {
    "largest_drop": "The significant interval that loses most cells.",
    "largest_drop_with_reference_guard": "The significant interval that loses most cells; reference and retention warnings apply.",
    "first_significant_high": "The first significant interval from high cutoffs down.",
    "reference_guided": "The first significant interval from high cutoffs down, for comparison with a reference.",
    "first_significant_low": "The first significant interval from low cutoffs up.",
    "max_significant": "The greatest significant cutoff.",
    "median_significant": "The median significant cutoff, on the grid.",
    "min_significant": "The least significant cutoff.",
}
REASONS = {
    "reference_guided": "A first significant loss from high cutoffs down exists and comes first in the recommendation.",
    "largest_drop": "Only the largest significant loss is at hand.",
    "fallback": "No interval was significant; the fallback is given for review.",
    "not_detected": "Nothing to recommend a cutoff from.",
}
WARNINGS = {
    "fallback_warning": "The cutoff is a fallback: no interval was significant.",
    "low_retention_warning": "Few cells stay below the cutoff; look at the profile before applying it.",
    "high_reference_deviation": "The cutoff is three times the reference or more; look at the sample before applying it.",
    "moderate_reference_deviation": "The cutoff is twice the reference or more; look at the distribution before applying it.",
}


def fallback_token(p: Detection) -> str:
    return {"quantile": f"quantile_fallback_{N.token(p.fallback_quantile)}", "max_cut": "max_cut_fallback", "none": "not_detected"}[p.fallback]


def fallbacks(cells: DataFrame, cols: Columns, p: Detection) -> DataFrame | None:
    """sample, fallback_cutoff; None where it is the same for all samples."""
    if p.fallback != "quantile":
        return None
    some = cells.select(F.col(cols.sample).cast("string").alias("sample"), F.col(cols.mito).alias("m"))
    return N.quantile8(some, "sample", "m", p.fallback_quantile).select("sample", N.snap(F.col("q"), p.bin_width, p.min_cut, p.max_cut).alias("fallback_cutoff"))


def median_distinct(c: Column) -> Column:
    return N.median_of(F.array_sort(F.collect_set(c)))  # a grid's worth of values


def by_sample(judged: DataFrame, p: Detection, keys: tuple[str, ...] = ()) -> DataFrame:
    """What the selection needs, in one aggregation of the interval table."""
    sig, c = F.col("is_significant"), F.col("cutoff")
    snapped = lambda x: N.snap(x, p.bin_width, p.min_cut, p.max_cut)
    own = F.when(sig, c)
    return judged.groupBy("sample", *keys).agg(
        F.max("n_cells").alias("n_cells"),
        F.count_if(sig).alias("significant_interval_count"),
        snapped(F.max(own)).alias("first_significant_cutoff_high"),
        snapped(F.min(own)).alias("first_significant_cutoff_low"),
        snapped(F.max_by(c, F.when(sig, F.struct("interval_loss", "cutoff")))).alias("largest_drop_cutoff"),
        snapped(median_distinct(own)).alias("__median"),
        F.max("interval_loss").alias("largest_interval_loss"),
        F.max("interval_loss_fraction").alias("largest_interval_loss_fraction"),
    )


def recommended(p: Detection) -> dict[str, Column]:
    """Cutoff, method and source that the recommendation gives, whatever selection was asked for."""
    high, drop, back = F.col("first_significant_cutoff_high"), F.col("largest_drop_cutoff"), F.col("__fallback")
    pick = lambda a, b, c, d: F.when(high.isNotNull(), a).when(drop.isNotNull(), b).when(back.isNotNull(), c).otherwise(d)
    source = fallback_token(p) if p.fallback != "none" else "fallback"
    return {
        "recommended_cutoff": F.coalesce(high, drop, back),
        "recommended_method": pick("reference_guided", "largest_drop", "fallback", "not_detected"),
        "recommendation_source": pick("reference_guided_first_significant_high", "largest_drop_no_first_significant_high", source, "not_detected"),
        "recommended_reason": pick(*REASONS.values()),
    }


def selection(p: Detection) -> dict[str, Column]:
    high, low, drop = (F.col(f"{x}_cutoff{y}") for x, y in (("first_significant", "_high"), ("first_significant", "_low"), ("largest_drop", "")))
    any_ = F.col("significant_interval_count") > 0
    chosen = {"largest_drop": drop, "largest_drop_with_reference_guard": drop, "first_significant_high": high, "reference_guided": high, "first_significant_low": low, "max_significant": high, "median_significant": F.col("__median"), "min_significant": low}[p.selection]
    source = {"first_significant_high": "first_significant_high", "first_significant_low": "first_significant_low", "reference_guided": "reference_guided_first_significant_high"}.get(p.selection, f"significant_{p.selection}")
    cutoff = F.when(any_, chosen).otherwise(F.col("__fallback"))
    return {
        "selected_cutoff": cutoff,
        "cutoff_source": F.when(any_, source).otherwise(fallback_token(p)),
        "selected_cutoff_interpretation": F.when(any_, SELECTED_MEANING[p.selection]).when(cutoff.isNotNull(), "A fallback: no interval was significant.").otherwise("No cutoff: no interval was significant, and there is no fallback."),
        "fallback_used": ~any_ & F.lit(p.fallback != "none"),
    }


def ratio_to(c: Column, ref: Reference) -> Column:
    return c / ref.cutoff if ref.cutoff else F.lit(None).cast("double")


def level_and_warning(p: Detection, ref: Reference) -> dict[str, Column]:
    """Recommendation level; a ratio of 2 replaces even the fallback level, low retention replaces all."""
    ratio = ratio_to(F.col("recommended_cutoff"), ref) if p.reference_warning else F.lit(None).cast("double")
    few = F.coalesce(F.col("recommended_retention_fraction") < 0.30, F.lit(False))
    first = F.when(F.col("fallback_used") | (F.col("recommended_method") == "fallback"), "fallback").when(F.col("recommended_cutoff").isNull(), "review_required").otherwise("standard")
    high, some = F.coalesce(ratio >= 3, F.lit(False)), F.coalesce(ratio >= 2, F.lit(False))
    level = F.when(few | high, "review_required").when(some & (first != "review_required"), "cautious").otherwise(first)
    notes = F.array_compact(F.array(
        F.when(high, WARNINGS["high_reference_deviation"]).when(some & (first != "review_required"), WARNINGS["moderate_reference_deviation"]),
        F.when(few, WARNINGS["low_retention_warning"]),
        F.when(level == "fallback", WARNINGS["fallback_warning"]),
    ))
    return {"recommendation_level": level, "recommendation_warning": F.when(F.size(notes) > 0, F.array_join(notes, " "))}


def flags(p: Detection, ref: Reference) -> Column:
    """Warning tokens of the selected cutoff, in order."""
    ratio = ratio_to(F.col("selected_cutoff"), ref) if p.reference_warning else F.lit(None).cast("double")
    few = F.coalesce(F.col("retention_fraction_at_cutoff") < 0.30, F.lit(False))
    # a largest drop with low retention below a higher boundary adds the same token again, so once is enough
    return F.array_compact(F.array(
        F.when(F.col("fallback_used"), "fallback_warning"),
        F.when(few, "low_retention_warning"),
        F.when(ratio >= 3, "high_reference_deviation").when(ratio >= 2, "moderate_reference_deviation"),
    ))


def confidence() -> Column:
    n, top = F.col("significant_interval_count"), F.col("largest_interval_loss_fraction")
    low = F.col("fallback_used") | (F.col("cutoff_source") == "not_detected") | top.isNull()
    return F.when(low, "low").when((n >= 2) & (top >= 0.02), "high").when((n >= 1) & (top >= 0.01), "moderate").otherwise("low")


def key(c: Column) -> Column:
    """A cutoff as a whole number of millionths: joins never compare doubles."""
    return F.round(c * 1e6).cast("long")


def summary(judged: DataFrame, prof: DataFrame, back: DataFrame | None, p: Detection, ref: Reference, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a sample (and value of keys), without the support columns. prof, judged and back are of grid size by sample."""
    rows = by_sample(judged, p, keys)
    if back is not None:
        rows = rows.join(back.withColumnRenamed("fallback_cutoff", "__fallback"), "sample", "left")
    else:
        rows = rows.withColumn("__fallback", F.lit(p.max_cut if p.fallback == "max_cut" else None).cast("double"))
    rows = rows.withColumns(selection(p)).withColumns(recommended(p))
    # the profile by cutoff, as a map of a sample: exact cutoff first, then snapped
    table = prof.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("cutoff")), F.struct("retained_cells", "retention_fraction")))).alias("__prof"))
    rows = rows.join(table, "sample", "left")
    for name, column in (("__sel", "selected_cutoff"), ("__rec", "recommended_cutoff")):
        c = F.col(column)
        near = N.snap(c, p.bin_width, p.min_cut, p.max_cut)
        rows = rows.withColumn(name, F.coalesce(F.try_element_at("__prof", key(c)), F.try_element_at("__prof", key(near))))
    rows = rows.withColumns({
        "retained_cells_at_cutoff": F.col("__sel.retained_cells"), "retention_fraction_at_cutoff": F.col("__sel.retention_fraction"),
        "recommended_retained_cells": F.col("__rec.retained_cells"), "recommended_retention_fraction": F.col("__rec.retention_fraction"),
        "reference_ratio": ratio_to(F.col("selected_cutoff"), ref),
    })
    rows = rows.withColumns(level_and_warning(p, ref)).withColumn("__flags", flags(p, ref))
    has = lambda token: F.array_contains("__flags", token)
    deviation = has("high_reference_deviation") | has("moderate_reference_deviation")
    words = F.transform("__flags", lambda x: F.element_at(F.create_map(*(F.lit(y) for kv in WARNINGS.items() for y in kv)), x))
    lit = lambda x, kind="string": F.lit(x).cast(kind)
    used = F.col("fallback_used")
    return rows.select(
        *keys, "sample", "n_cells", F.col("selected_cutoff").alias("detected_cutoff"), "selected_cutoff", lit(p.selection).alias("selected_cutoff_method"), F.col("cutoff_source").alias("selected_cutoff_source"),
        "selected_cutoff_interpretation", "recommended_cutoff", "recommended_method", "recommended_reason", "recommendation_level", "recommendation_warning", "recommendation_source", "cutoff_source", "fallback_used",
        F.when(used, p.fallback).alias("fallback_method"), F.when(used & F.lit(p.fallback == "quantile"), F.lit(p.fallback_quantile)).alias("fallback_quantile"),
        F.col("significant_interval_count").cast("int"), F.col("significant_interval_count").cast("int").alias("significant_cutoff_count"), confidence().alias("cutoff_confidence"),
        lit(ref.cutoff, "double").alias("reference_cutoff"), lit(ref.species).alias("reference_species"), lit(ref.tissue).alias("reference_tissue"), lit(ref.source).alias("reference_source"),
        "first_significant_cutoff_high", "first_significant_cutoff_low", "largest_drop_cutoff", "reference_ratio", F.coalesce(F.col("reference_ratio") >= 2, F.lit(False)).alias("reference_deviation_flag"),
        F.when(F.size("__flags") > 0, F.array_join("__flags", ";")).otherwise("none").alias("warning_level"), F.when(F.size("__flags") > 0, F.array_join(words, " ")).alias("warning_message"),
        deviation.alias("has_reference_deviation"), has("low_retention_warning").alias("has_low_retention_warning"), has("fallback_warning").alias("has_fallback_warning"),
        has("high_reference_deviation").alias("has_high_reference_deviation"), has("moderate_reference_deviation").alias("has_moderate_reference_deviation"),
        "largest_interval_loss", "largest_interval_loss_fraction", "retained_cells_at_cutoff", "retention_fraction_at_cutoff", "recommended_retained_cells", "recommended_retention_fraction",
        lit(p.loss_test).alias("loss_test"), lit(p.selection).alias("sample_cutoff_method"),
    )
