"""Writers of result tables (CSV), kept cells (Parquet) and the comparison report (Markdown)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

from siftwell.plans.benchmark import Comparison, write_kept
from siftwell.plans.detection import Detected
from siftwell.plans.quality import Result
from siftwell.plans.sensitivity import Sweep


def write_csv(df: DataFrame, path: str) -> str:
    """A folder with one CSV part and a header; the tables are of samples x grid rows at most."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_tables(tables: dict[str, DataFrame | None], folder: str) -> list[str]:
    return [write_csv(df, os.path.join(folder, name)) for name, df in tables.items() if df is not None]


def write_detection(found: Detected, folder: str) -> list[str]:
    """Nine tables; three repeat others under older names."""
    advised = ["sample", "recommended_cutoff", "recommended_method", "recommended_reason", "recommendation_level", "recommendation_warning", "recommendation_source", "recommended_retained_cells", "recommended_retention_fraction"]
    reference = ["sample", "selected_cutoff", "reference_cutoff", "reference_species", "reference_tissue", "reference_source", "reference_ratio", "reference_deviation_flag", "warning_level", "warning_message"]
    s = found.summary
    return write_tables({
        "retained_cell_profile": found.profile.drop("idx"), "interval_loss_table": found.interval_losses, "significant_intervals": found.significant, "sample_cutoff_summary": s,
        "reference_cutoff_summary": s.select(reference), "recommendation_summary": s.select(advised),
        "processed_temp_cell_num": found.wide_profile(), "mito_change_point_results": found.interval_losses, "mito_sample_cutoff_summary": s,
    }, folder)


def write_quality(found: Result, folder: str) -> list[str]:
    return write_tables(({"one_sample_summary": found.summary} if found.plan is None else found.tables), folder)


def write_comparison(found: Comparison, folder: str, cells: bool = False) -> list[str]:
    out = write_tables({
        "benchmark_summary": found.summary, "benchmark_scores": found.scores, "benchmark_normalized_scores": found.all_scores, "benchmark_score_weights": found.weights, "benchmark_recommended_strategies": found.recommendations,
        "benchmark_sample_retention": found.sample_retention, "benchmark_group_retention": found.group_retention, "benchmark_cutoff_plan": found.cutoff_plan,
    }, folder)
    if cells:
        write_kept(found, os.path.join(folder, "kept_cells"))
    with open(os.path.join(folder, "benchmark_report.md"), "w") as f:
        f.write(report(found))
    return [*out, os.path.join(folder, "benchmark_report.md")]


def write_sensitivity(found: Sweep, folder: str) -> list[str]:
    return write_tables({"sensitivity_results": found.table, "sensitivity_summary": found.summary}, folder)


def write_provenance(record: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(record, f, indent=1, default=str)


def table(df: DataFrame, columns: list[str]) -> str:
    rows = df.select(columns).limit(1000).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])


def report(found: Comparison) -> str:
    """Markdown from the small result tables."""
    best = found.recommendation.first()
    parts = [
        "# Comparison of filtering strategies",
        f"Best of all: **{best['recommended_strategy']}**. Best adaptive strategy: **{best['recommended_adaptive_strategy'] or 'none'}** (profile {found.primary}).",
        "## Strategies", table(found.summary.orderBy("ord"), ["strategy", "total_cells_before", "total_cells_after", "retention_rate", "median_mito_after", "sample_retention_cv", "applied_cutoff_min", "applied_cutoff_max"]),
        "## Scores", table(found.scores.orderBy("score_rank"), ["strategy", "retention_score", "mito_score", "sample_balance_score", "group_balance_score", "overall_score"]),
        "## Recommendations by profile", table(found.recommendations.orderBy("scoring_profile"), ["scoring_profile", "recommended_strategy", "recommended_adaptive_strategy", "overall_score"]),
        "## Weights", table(found.weights, ["scoring_profile", "retention", "mito", "sample_balance", "group_balance"]),
        "## Retention by sample", table(found.sample_retention.orderBy("strategy", "level_id"), ["strategy", "level_id", "before_cells", "after_cells", "retention_rate"]),
    ]
    if found.group_retention is not None:
        parts += ["## Retention by group", table(found.group_retention.orderBy("strategy", "level_id"), ["strategy", "level_id", "before_cells", "after_cells", "retention_rate"])]
    return "\n\n".join(parts) + "\n"
