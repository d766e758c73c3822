"""Leave-one-out tests of interval losses and adjustment of their p-values, sample by sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import numerics as N
from siftwell.schema import Detection


def with_background(losses: DataFrame) -> DataFrame:
    """losses with bg: the other losses of the sample, sorted. A sample has a grid's worth of rows."""
    every = F.collect_list(F.struct("interval_index", "interval_loss")).over(Window.partitionBy("sample"))
    listed = losses.withColumn("__all", every)
    others = F.filter("__all", lambda x: (x["interval_index"] != F.col("interval_index")) & (x["interval_loss"] >= 0))
    return listed.withColumn("bg", F.array_sort(F.transform(others, lambda x: x["interval_loss"].cast("double")))).drop("__all")


def tested(losses: DataFrame, method: str = "mad_zscore") -> DataFrame:
    """losses with p_value, loss_score, test_method and baseline_loss."""
    loss = F.col("interval_loss").cast("double")
    some = with_background(losses).withColumn("__mean", N.mean_of(F.col("bg")))
    if method == "threshold_only":
        return some.withColumns({"p_value": F.lit(None).cast("double"), "loss_score": loss, "test_method": F.lit(method), "baseline_loss": F.col("__mean")}).drop("bg", "__mean")
    score, p, extra = branches(method, loss)
    for step in extra:  # each step is a projection of its own: nothing is computed twice
        some = some.withColumns(step)
    some = some.withColumn("loss_score_raw", score)
    p_raw = p(some) if callable(p) else p
    some = some.withColumn("__p", p_raw)
    none = F.size("bg") == 0
    base = N.median_of(F.col("bg")) if method == "mad_zscore" else F.col("__mean")
    out = {
        "p_value": F.when(none | (loss <= 0), 1.0).otherwise(F.greatest("__p", F.lit(N.TINY))),
        "loss_score": F.when(none, F.lit(None).cast("double")).when(loss <= 0, 0.0).otherwise(F.col("loss_score_raw")),
        "test_method": F.when(none, f"{method}_insufficient_baseline").otherwise(method),
        "baseline_loss": F.when(~none, base),
    }
    return some.withColumns(out).select(*losses.columns, *out)


def branches(method: str, loss: Column) -> tuple[Column, Column, list[dict[str, Column]]]:
    """Score, raw p-value, and the columns that both need, step by step."""
    bg, mean = F.col("bg"), F.col("__mean")
    if method == "empirical_tail":
        return loss, (F.size(F.filter(bg, lambda x: x >= loss)) + 1) / (F.size(bg) + 1), []
    if method == "poisson_tail":
        return loss / F.col("__rate"), N.upper_poisson(loss, F.col("__rate")), [{"__rate": F.greatest(mean, F.lit(1e-8))}]
    if method == "zscore":
        flat = ~(F.coalesce(F.col("__sd"), F.lit(0.0)) > 0)
        z = (loss - mean) / F.when(flat, None).otherwise(F.col("__sd"))
        score = F.when(flat, F.when(loss > mean, float("inf")).otherwise(0.0)).otherwise(F.col("__z"))
        p = F.when(flat, F.when(loss > mean, N.TINY).otherwise(1.0)).otherwise(N.upper_normal("__z"))
        return score, p, [{"__sd": N.sd_of(bg, mean)}, {"__z": z}]
    if method != "mad_zscore":
        raise ValueError(f"unknown loss test {method}")
    mad = N.median_of(F.col("__dev")) * 1.4826
    iqr = (N.quantile_of(bg, 0.75) - N.quantile_of(bg, 0.25)) / 1.349
    spread = F.when(F.col("__mad") > 0, F.col("__mad")).when(F.col("__iqr") > 0, F.col("__iqr")).when(F.col("__sd") > 0, F.col("__sd")).otherwise(N.EPS)
    steps = [
        {"__mid": N.median_of(bg)},
        {"__dev": F.array_sort(F.transform(bg, lambda x: F.abs(x - F.col("__mid")))), "__iqr": iqr, "__sd": N.sd_of(bg, mean)},
        {"__mad": mad},
        {"__z": (loss - F.col("__mid")) / spread},
    ]
    return F.col("__z"), N.upper_normal("__z"), steps


def adjusted(rows: DataFrame, method: str = "BH", keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """rows with p_adj: p_value adjusted over all intervals of a sample (further keys: over each of their values)."""
    p = F.col("p_value")
    whole = Window.partitionBy(*keys)
    if method == "none":
        return rows.withColumn("p_adj", p)
    n = F.count("p_value").over(whole)
    if method == "bonferroni":
        return rows.withColumn("p_adj", F.least(F.lit(1.0), n * p))
    if method == "hommel":
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, p_adj double"
        return rows.groupBy(*keys).applyInPandas(hommel, schema)  # a group is one sample's grid
    rank = F.count("p_value").over(whole.orderBy("p_value").rangeBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(whole.orderBy(F.asc_nulls_last("p_value"), "interval_index"))
    if method == "holm":
        step = rows.withColumn("__x", (n - first + 1) * p)
        return step.withColumn("p_adj", F.when(p.isNotNull(), F.least(F.lit(1.0), F.max("__x").over(whole.orderBy(F.asc_nulls_last("p_value"), "interval_index"))))).drop("__x")
    if method == "hochberg":
        last = F.row_number().over(whole.orderBy(F.desc_nulls_last("p_value"), "interval_index"))
        x = last * p
    elif method in ("BH", "fdr", "BY"):
        x = n / rank * p
        if method == "BY":
            x = x * F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / k)
    else:
        raise ValueError(f"unknown adjustment {method}")
    step = rows.withColumn("__x", x)
    low = F.min("__x").over(whole.orderBy(F.desc_nulls_last("p_value")).rangeBetween(Window.unboundedPreceding, 0))
    return step.withColumn("p_adj", F.when(p.isNotNull(), F.least(F.lit(1.0), low))).drop("__x")


def hommel(group: pd.DataFrame) -> pd.DataFrame:
    """Hommel's procedure: the least level at which Simes' test rejects every intersection that holds the hypothesis."""
    import numpy as np

    out, ok = group.copy(), group["p_value"].notna()
    p = group.loc[ok, "p_value"].to_numpy()
    n, order = len(p), np.argsort(p, kind="stable")
    s = p[order]
    level = np.full(n, min((n * s / np.arange(1, n + 1)), default=1.0) if n == 0 else (n * s / np.arange(1, n + 1)).min())
    best = level.copy()
    for m in range(n - 1, 1, -1):
        head, tail = np.arange(n - m + 1), np.arange(n - m + 1, n)
        simes = (m * s[tail] / np.arange(2, m + 1)).min()
        level[head] = np.minimum(m * s[head], simes)
        level[tail] = level[n - m]
        best = np.maximum(best, level)
    found = np.empty(n)
    found[order] = np.maximum(best, s)
    out["p_adj"] = float("nan")
    out.loc[ok, "p_adj"] = np.minimum(found, 1.0)
    out["p_adj"] = out["p_adj"].astype(object).where(out["p_adj"].notna(), None)
    return out


def significant(rows: DataFrame, p: Detection) -> DataFrame:
    """rows with is_significant: candidates, and unless the test is threshold_only with p_adj of alpha or less."""
    flag = F.col("passes_candidate_filters")
    if p.loss_test != "threshold_only":
        flag = flag & F.coalesce(F.col("p_adj") <= p.alpha, F.lit(False))
    return rows.withColumn("is_significant", flag)


def judged(losses: DataFrame, p: Detection) -> DataFrame:
    """The interval-loss table with all its columns."""
    rows = tested(losses, p.loss_test)
    rows = rows.withColumn("p_adj", F.lit(None).cast("double")) if p.loss_test == "threshold_only" else adjusted(rows, p.p_adjust)
    rows = significant(rows, p).withColumn("p_adj_method", F.lit(p.p_adjust))
    return rows.withColumns({"p_adjusted": F.col("p_adj"), "p_fdr": F.col("p_adj"), "p_adjust_method": F.col("p_adj_method"), "drop_fraction": F.col("interval_loss_fraction"), "delta_prev": F.col("interval_loss")})
