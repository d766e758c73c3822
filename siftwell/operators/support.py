"""The support rule: the largest cutoff that enough samples reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.schema import open_unit


def required(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(fraction)))).cast("int")


def resolved(cutoffs: DataFrame, column: str = "cutoff", fraction: float = 0.5, by: list[str] = (), strategy: str = "sample_supported_global_cutoff") -> DataFrame:
    """One row (for each value of `by`): the largest distinct cutoff that `required` samples reach, else the least.

    cutoffs has a row for each sample; null cutoffs count as samples but support nothing.
    """
    open_unit(fraction, "min_support_fraction")
    keys = list(by)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    reach = F.count(column).over(whole.orderBy(F.desc(column)).rangeBetween(Window.unboundedPreceding, 0))
    rows = cutoffs.select(*keys, column).withColumns({"__n": F.count(F.lit(1)).over(whole), "__s": reach})
    ok = F.col("__s") >= required(F.col("__n"), fraction)
    chosen = F.coalesce(F.max(F.when(ok, F.col(column))), F.min(column))
    found = rows.groupBy(*keys).agg(F.max("__n").alias("__n"), chosen.alias("global_cutoff"), F.collect_list(F.struct(F.col(column).alias("c"), F.col("__s").alias("s"))).alias("__all"))  # one entry a sample
    count = F.coalesce(F.get(F.filter("__all", lambda x: x["c"] == F.col("global_cutoff")), F.lit(0))["s"], F.lit(0)).cast("int")
    return support_row(found.withColumn("__count", count), fraction, keys, strategy)


def summarised(cutoffs: DataFrame, cutoff: Column, column: str = "cutoff", fraction: float = 0.5, by: list[str] = (), strategy: str = "sample_supported_global_cutoff") -> DataFrame:
    """How many samples reach a given cutoff (an aggregate expression, such as the least)."""
    open_unit(fraction, "min_support_fraction")
    keys = list(by)
    found = cutoffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), cutoff.alias("global_cutoff"), F.collect_list(column).alias("__all"))  # one entry a sample
    count = F.when(F.col("global_cutoff").isNull(), 0).otherwise(F.size(F.filter("__all", lambda x: x >= F.col("global_cutoff")))).cast("int")
    return support_row(found.withColumn("__count", count), fraction, keys, strategy)


def support_row(found: DataFrame, fraction: float, keys: list[str], strategy: str) -> DataFrame:
    n, count = F.col("__n").cast("int"), F.col("__count")
    return found.select(
        *keys,
        "global_cutoff",
        F.col("global_cutoff").alias("cutoff"),
        F.coalesce(count / n, F.lit(0.0)).alias("support_fraction"),
        count.alias("n_supporting_samples"),
        count.alias("support_count"),
        n.alias("n_total_samples"),
        n.alias("sample_count"),
        required(F.col("__n"), fraction).alias("required_support"),
        F.lit(strategy).alias("strategy"),
        *([] if "group" in keys else [F.lit(None).cast("string").alias("group")]),
    )
