"""Comparison of filtering strategies: every strategy's cutoffs meet the cells in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.numerics import medians
from siftwell.operators import clusters, qc
from siftwell.plans import cutoff_plan
from siftwell.plans.detection import Detected, detect
from siftwell.plans.quality import options
from siftwell.schema import ADAPTIVE, STRATEGIES, Bounds, Columns, Detection, check_cells, check_columns, choice, mito_cutoff, scalar
from siftwell.storage import narrowed, stored

WEIGHTS = ("retention", "mito", "sample_balance", "group_balance")
# Weights of the scoring profiles.
PROFILES = {
    "balanced": (0.35, 0.25, 0.20, 0.20),
    "retention_focused": (0.60, 0.15, 0.15, 0.10),
    "stringent_mito": (0.20, 0.55, 0.15, 0.10),
    "balance_focused": (0.20, 0.15, 0.35, 0.30),
}


@dataclass(frozen=True)
class Strategy:
    name: str
    mode: str = "all"
    cutoff_strategy: str = "consensus"
    max_mito: float | str = ADAPTIVE
    #: Changes to the detection parameters.
    changes: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a strategy needs a name")
        choice(self.mode, "mode", ("all", "split"))
        choice(self.cutoff_strategy, "cutoff_strategy", STRATEGIES)
        mito_cutoff(self.max_mito, adaptive=True)

    @property
    def adaptive(self) -> bool:
        return self.max_mito == ADAPTIVE or bool(re.match("adaptive_", self.name))


def default_strategies(grouped: bool) -> list[Strategy]:
    fixed = [Strategy(f"fixed_{k}", max_mito=k / 100) for k in (5, 10, 15, 20)]
    chosen = [Strategy(f"adaptive_{s}", changes={"selection": s}) for s in ("largest_drop", "first_significant_high", "reference_guided")]
    return fixed + chosen + [Strategy("adaptive_strictest", cutoff_strategy="strictest")] + [Strategy("adaptive_groupwise", cutoff_strategy="groupwise")] * grouped


def normalised_weights(weights: dict[str, float]) -> tuple[float, ...]:
    missing = [w for w in WEIGHTS if w not in weights]
    if missing:
        raise ValueError(f"weights lack {', '.join(missing)}")
    values = [scalar(float(weights[w]), w, 0) for w in WEIGHTS]
    if sum(values) <= 0:
        raise ValueError("weights must have a positive sum")
    return tuple(v / sum(values) for v in values)


def profiles(names: list[str] | None = None, custom: dict[str, float] | None = None) -> dict[str, tuple[float, ...]]:
    """Normalised weights by profile; a custom one comes first and is the primary one."""
    names = list(dict.fromkeys(names or PROFILES))
    for n in names:
        choice(n, "scoring profile", tuple(PROFILES))
    own = {"custom": normalised_weights(custom)} if custom else {}
    return own | {n: normalised_weights(dict(zip(WEIGHTS, PROFILES[n], strict=True))) for n in names}


def weights_table(spark: SparkSession, found: dict[str, tuple[float, ...]]) -> DataFrame:
    return spark.createDataFrame([(n, *w) for n, w in found.items()], "scoring_profile string, " + ", ".join(f"{w} double" for w in WEIGHTS))


@dataclass
class Comparison:
    summary: DataFrame
    scores: DataFrame
    all_scores: DataFrame
    recommendations: DataFrame
    weights: DataFrame
    sample_retention: DataFrame
    group_retention: DataFrame | None
    cutoff_plan: DataFrame
    kept: DataFrame
    primary: str

    @property
    def recommendation(self) -> DataFrame:
        return self.recommendations.where(F.col("scoring_profile") == self.primary)


def strategy_plans(cells: DataFrame, cols: Columns, strategies: list[Strategy], params: Detection, fraction: float, check: bool) -> DataFrame:
    """One row for each strategy and sample. Detections with equal parameters are one."""
    found: dict[Detection, Detected] = {}
    groups = stored(cutoff_plan.sample_groups(cells, cols, check), "groups")  # one row a sample
    out = None
    for k, s in enumerate(strategies):
        p = options(params, s.changes)
        if s.max_mito == ADAPTIVE and p not in found:
            found[p] = detect(cells, cols, p, check=False, narrow=False)
            found[p].summary = stored(found[p].summary, "summary")  # one row a sample
        rows = cutoff_plan.build_plan(cells, cols, s.max_mito, s.cutoff_strategy, fraction, p, detected=found.get(p), groups_of=groups, check=check and k == 0, narrow=False).samples
        own = s.max_mito == ADAPTIVE
        rows = rows.withColumns({
            "strategy": F.lit(s.name), "ord": F.lit(k), "mode": F.lit(s.mode), "max_mito_input": F.lit(str(s.max_mito)),
            "s_loss_test": F.lit(p.loss_test if own else None).cast("string"), "s_p_adjust": F.lit(p.p_adjust if own else None).cast("string"),
            "s_alpha": F.lit(p.alpha if own else None).cast("double"), "s_selection": F.lit(p.selection if own else None).cast("string"),
        })
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def marked(cells: DataFrame, cols: Columns, bounds: Bounds, plans: DataFrame) -> DataFrame:
    """cells with strategies: those that keep the cell. Cells stay one row each; the plan is one row a sample."""
    side = plans.groupBy(F.col("sample_id").alias("__sample")).agg(F.collect_list(F.struct("strategy", "applied_cutoff")).alias("__cuts"))  # one entry a strategy
    joined = cells.join(side, F.col(cols.sample).cast("string") == F.col("__sample"), "left").drop("__sample")
    ok = qc.keep(cols, bounds, F.lit(1e300))
    kept = F.filter("__cuts", lambda x: F.col(cols.mito) <= x["applied_cutoff"])
    return joined.withColumn("strategies", F.when(ok, F.transform(kept, lambda x: x["strategy"])).otherwise(F.array().cast("array<string>"))).drop("__cuts")


def retention(rows: DataFrame, column: str, level: str, names: list[str]) -> DataFrame:
    """strategy, level_type, level_id, before_cells, after_cells, retention_rate; one aggregation for all strategies."""
    counts = rows.groupBy(F.col(column).cast("string").alias("level_id")).agg(F.count("*").alias("before_cells"), *(F.count_if(F.array_contains("strategies", n)).alias(f"k{i}") for i, n in enumerate(names)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(f"k{i}").alias("after_cells")) for i, n in enumerate(names))))
    long = counts.select("level_id", "before_cells", each.alias("s")).select("s.strategy", F.lit(level).alias("level_type"), "level_id", "before_cells", "s.after_cells")
    return long.withColumn("retention_rate", F.round(F.col("after_cells") / F.col("before_cells"), 4))


def distribution(table: DataFrame, prefix: str) -> DataFrame:
    """Least, median, greatest and coefficient of variation of a strategy's rounded rates."""
    r = F.col("retention_rate")
    cv = F.when(F.count(r) <= 1, 0.0).when(F.avg(r) == 0, None).otherwise(F.stddev_samp(r) / F.avg(r))
    return table.groupBy("strategy").agg(F.min(r).alias(f"{prefix}_retention_min"), F.median(r).alias(f"{prefix}_retention_median"), F.max(r).alias(f"{prefix}_retention_max"), cv.alias(f"{prefix}_retention_cv"))


def balance(cv: Column) -> Column:
    return F.round(1 / (1 + cv), 4)


def summarised(rows: DataFrame, cols: Columns, plans: DataFrame, names: list[str], by_sample: DataFrame, by_group: DataFrame | None) -> DataFrame:
    """One row a strategy."""
    values = {"median_genes": (cols.n_feature, 1), "median_counts": (cols.n_count, 1), "median_mito": (cols.mito, 10_000)}
    long = rows.select(F.explode(F.concat(F.array(F.lit("")), "strategies")).alias("strategy"), cols.n_feature, cols.n_count, cols.mito)
    middle = medians(long, "strategy", values)
    before = middle.where("strategy = ''").select(*(F.col(n).alias(f"{n}_before") for n in values))
    after = middle.select("strategy", *(F.col(n).alias(f"{n}_after") for n in values))
    counts = by_sample.groupBy("strategy").agg(F.sum("before_cells").alias("total_cells_before"), F.sum("after_cells").alias("total_cells_after"))
    cut = plans.groupBy("ord", "strategy", "mode", "cutoff_strategy", "max_mito_input").agg(
        F.min("applied_cutoff").alias("applied_cutoff_min"), F.median("applied_cutoff").alias("applied_cutoff_median"), F.max("applied_cutoff").alias("applied_cutoff_max"),
        F.max("s_loss_test").alias("loss_test"), F.max("s_p_adjust").alias("p_adjust_method"), F.max("s_alpha").alias("alpha"), F.max("s_selection").alias("sample_cutoff_method"))
    out = cut.join(counts, "strategy", "left").join(after, "strategy", "left").crossJoin(F.broadcast(before)).join(distribution(by_sample, "sample"), "strategy", "left")  # before is one row
    if by_group is not None:
        out = out.join(distribution(by_group, "group"), "strategy", "left")
    else:
        out = out.withColumns({f"group_retention_{x}": F.lit(None).cast("double") for x in ("min", "median", "max", "cv")})
    rate = F.round(F.col("total_cells_after") / F.col("total_cells_before"), 4)
    return out.withColumns({
        "retention_rate": rate, "retained_cell_fraction": rate, "sample_balance": balance(F.col("sample_retention_cv")), "group_balance": balance(F.col("group_retention_cv")),
        "median_nFeature_RNA_after_qc": F.col("median_genes_after"), "median_nCount_RNA_after_qc": F.col("median_counts_after"), "median_mito_ratio_after_qc": F.col("median_mito_after"),
    })


def scaled(c: Column, higher: bool) -> Column:
    """0 to 1 over all strategies, four places; 1 if all are alike, null where missing."""
    every = Window.partitionBy(F.lit(0))  # one row a strategy
    low, high = F.min(c).over(every), F.max(c).over(every)
    x = F.try_divide(c - low, high - low) if higher else F.try_divide(high - c, high - low)
    return F.when(c.isNotNull(), F.round(F.when(high == low, 1.0).otherwise(x), 4))


def scored(summary: DataFrame, weights: tuple[float, ...], profile: str = "balanced") -> DataFrame:
    """summary with component scores and their weighted mean over those at hand, best first."""
    parts = {
        "retention_score": scaled(F.col("retention_rate"), True),
        "mito_score": scaled(F.col("median_mito_after"), False),
        "sample_balance_score": scaled(F.col("sample_retention_cv"), False),
        "group_balance_score": scaled(F.coalesce("group_retention_cv", "sample_retention_cv"), False),
    }
    out = summary.withColumn("scoring_profile", F.lit(profile)).withColumns(parts)
    total = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in zip(parts, weights, strict=True)), F.lit(0.0))
    share = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in zip(parts, weights, strict=True)), F.lit(0.0))
    out = out.withColumn("overall_score", F.round(F.try_divide(total, share), 4))
    place = F.row_number().over(Window.partitionBy("scoring_profile").orderBy(F.desc_nulls_last("overall_score"), F.desc_nulls_last("retention_rate"), "ord"))
    return out.withColumn("score_rank", place)


def recommended(scores: DataFrame) -> DataFrame:
    """For each profile the best adaptive strategy (first of equals) and the best of all."""
    adaptive = F.col("strategy").rlike("^adaptive_")
    fields = ["retention_rate", "median_mito_after", "sample_retention_cv", "group_retention_cv", "overall_score"]
    order = F.struct(F.coalesce("overall_score", F.lit(-1.0)), -F.col("score_rank"))
    best = F.max_by(F.struct("strategy", *fields), F.when(adaptive, order))
    got = scores.groupBy("scoring_profile").agg(best.alias("a"), F.min_by("strategy", "score_rank").alias("top"))
    return got.select("scoring_profile", F.col("a.strategy").alias("recommended_adaptive_strategy"), F.col("top").alias("recommended_strategy"), F.col("top").alias("top_scoring_strategy"), F.col("a.strategy").alias("adaptive_strategy"), F.col("top").alias("overall_strategy"), *(f"a.{f}" for f in fields))


def compare(cells: DataFrame, columns: Columns | None = None, strategies: list[Strategy] | None = None, bounds: Bounds | None = None, params: Detection | None = None, fraction: float = 0.5, scoring: list[str] | None = None, weights: dict[str, float] | None = None, cluster: str | None = None, check: bool = True) -> Comparison:
    """cluster: a column of cluster labels, for the mixing of samples and groups within clusters after filtering."""
    cols, bounds, params = columns or Columns(), bounds or Bounds(), params or Detection()
    strategies = default_strategies(cols.group is not None) if strategies is None else list(strategies)
    names = [s.name for s in strategies]
    if len(set(names)) < len(names) or not names:
        raise ValueError("strategy names must be unique")
    if check:
        check_columns(cells, [c for c in (cols.sample, cols.mito, cols.group) if c], [cols.mito])
    some = narrowed(cells, cols.sample, cols.group, cols.n_feature, cols.n_count, cols.mito, cluster)
    if check:
        check_cells(some, cols)
    found = profiles(scoring, weights)
    plans = strategy_plans(some, cols, strategies, params, fraction, check)
    rows = stored(marked(some, cols, bounds, plans), "marked")  # marks are computed once, too
    by_sample = retention(rows, cols.sample, "sample", names)
    by_group = retention(rows, cols.group, "group", names) if cols.group else None
    summary = summarised(rows, cols, plans, names, by_sample, by_group)
    summary = downstream(rows, cols, cluster, names, summary)
    every = None
    for n, w in found.items():
        one = scored(summary, w, n)
        every = one if every is None else every.unionByName(one)
    primary = next(iter(found))
    return Comparison(summary, every.where(F.col("scoring_profile") == primary), every, recommended(every), weights_table(cells.sparkSession, found), by_sample, by_group, plans, marked(cells, cols, bounds, plans), primary)


def downstream(rows: DataFrame, cols: Columns, cluster: str | None, names: list[str], summary: DataFrame) -> DataFrame:
    if cluster is None:
        empty = {n: F.lit(None).cast("double") for n in ("cluster_count", "sample_entropy_weighted", "group_entropy_weighted", "dominant_sample_fraction", "dominant_group_fraction")}
        return summary.withColumns(empty | {"downstream_status": F.lit("disabled")})
    out = None
    for n in names:
        own = rows.where(F.array_contains("strategies", n))
        a = clusters.mixing(own, cluster, cols.sample).toDF("cluster_count", "sample_entropy_weighted", "dominant_sample_fraction")
        b = clusters.mixing(own, cluster, cols.group).toDF("__n", "group_entropy_weighted", "dominant_group_fraction").drop("__n") if cols.group else None
        one = a.crossJoin(b) if b is not None else a.withColumns({x: F.lit(None).cast("double") for x in ("group_entropy_weighted", "dominant_group_fraction")})  # one row each
        one = one.withColumn("strategy", F.lit(n))
        out = one if out is None else out.unionByName(one)
    few = F.col("total_cells_after") < 20
    joined = summary.join(out, "strategy", "left")
    blank = {n: F.when(~few, F.col(n)) for n in ("cluster_count", "sample_entropy_weighted", "group_entropy_weighted", "dominant_sample_fraction", "dominant_group_fraction")}
    return joined.withColumns(blank).withColumn("downstream_status", F.when(few, "too_few_cells").otherwise("ok"))


def strategy_cells(found: Comparison, name: str) -> DataFrame:
    return found.kept.where(F.array_contains("strategies", name)).drop("strategies")


def write_kept(found: Comparison, path: str) -> None:
    """Kept cells by strategy, as Parquet folders."""
    found.kept.withColumn("strategy", F.explode("strategies")).drop("strategies").write.partitionBy("strategy").parquet(path)


