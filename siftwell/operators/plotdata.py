"""The data behind the figures, aggregated before anything is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.schema import Columns

LINES = ("selected_cutoff", "recommended_cutoff", "first_significant_cutoff_high", "largest_drop_cutoff", "reference_cutoff")


def cutoff_lines(summary: DataFrame) -> DataFrame:
    """sample, cutoff, cutoff_type: the cutoff columns under each other, without nulls and repetitions."""
    return summary.select("sample", *LINES).unpivot("sample", list(LINES), "cutoff_type", "cutoff").where("cutoff is not null").select("sample", "cutoff", "cutoff_type").distinct()


def sample_order(summary: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return summary.select("sample", F.row_number().over(Window.orderBy(F.asc_nulls_last("selected_cutoff"), "sample")).alias("position"))  # one row a sample


def complexity(cells: DataFrame, cols: Columns | None = None) -> DataFrame:
    """cells with log10 of genes over log10 of counts; null without genes or with one count."""
    cols = cols or Columns()
    g, u = F.col(cols.n_feature), F.col(cols.n_count)
    return cells.withColumn("complexity", F.when((g > 0) & (u > 1), F.log10(g) / F.log10(u)))


def cell_bars(cells: DataFrame, by: str) -> DataFrame:
    return cells.groupBy(by).agg(F.count("*").alias("cells"))


def density(cells: DataFrame, by: str, value: str, bins: int = 50, log: bool = True) -> DataFrame:
    """Histogram of a value (on a logarithmic axis): by, bin, low edge, cells; bins are a fixed part of a unit, so one pass will do."""
    x = F.when(F.col(value) > 0, F.log10(value)) if log else F.col(value).cast("double")
    b = F.floor(x * bins)
    return cells.select(by, b.alias("bin")).where("bin is not null").groupBy(by, "bin").agg(F.count("*").alias("cells")).withColumn("low", F.col("bin") / bins)


def boxes(cells: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles and whisker ends of log10 of a value."""
    x = F.when(F.col(value) > 0, F.log10(value))
    q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
    return cells.groupBy(by).agg(F.min(x).alias("low"), q.alias("q"), F.max(x).alias("high")).select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "high")


def fits(cells: DataFrame, by: str, cols: Columns | None = None) -> DataFrame:
    """Line through log10 of counts (x) and of genes (y), for each value of by."""
    cols = cols or Columns()
    x, y = F.log10(F.when(F.col(cols.n_count) > 0, F.col(cols.n_count))), F.log10(F.when(F.col(cols.n_feature) > 0, F.col(cols.n_feature)))
    return cells.select(by, x.alias("x"), y.alias("y")).where("x is not null and y is not null").groupBy(by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("cells"))


def ordered_strategies(summary: DataFrame, by: str = "total_cells_after") -> DataFrame:
    """Strategies with their place along a bar chart."""
    from pyspark.sql import Window

    return summary.select("strategy", "cutoff_strategy", by, F.row_number().over(Window.orderBy(by, "ord")).alias("position"))  # one row a strategy


def parameter_labels(table: DataFrame) -> DataFrame:
    return table.withColumn("label", F.concat_ws(" | ", *(F.col(c).cast("string") for c in ("bin_width", "alpha", "min_drop_fraction", "loss_test", "sample_cutoff_method"))))


def cutoff_histogram(table: DataFrame, bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    b = F.least(F.expr(f"width_bucket(detected_cutoff, {low}, {high}, {bins})"), F.lit(bins))
    return table.where("detected_cutoff is not null").groupBy("sample", b.alias("bin")).agg(F.count("*").alias("n"))
