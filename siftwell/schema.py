"""Column names, parameters and their validation."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOSS_TESTS = ("mad_zscore", "empirical_tail", "poisson_tail", "zscore", "threshold_only")
ADJUSTMENTS = ("holm", "hochberg", "hommel", "bonferroni", "BH", "BY", "fdr", "none")
SELECTIONS = ("largest_drop", "first_significant_high", "first_significant_low", "reference_guided", "largest_drop_with_reference_guard", "max_significant", "median_significant", "min_significant")
FALLBACKS = ("quantile", "max_cut", "none")
STRATEGIES = ("consensus", "strictest", "groupwise")
#: Asks for detected cutoffs where a number would be a fixed one.
ADAPTIVE = "adaptive"


def scalar(value: float, name: str, low: float = -math.inf, high: float = math.inf, infinite: bool = False) -> float:
    """value, if it is a number in [low, high]."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or (math.isinf(value) and not infinite) or not low <= value <= high:
        raise ValueError(f"{name} must be a number in [{low}, {high}]")
    return value


def open_unit(value: float, name: str) -> float:
    if scalar(value, name, 0, 1) == 0:
        raise ValueError(f"{name} must be in (0, 1]")
    return value


def choice(value: str, name: str, of: tuple[str, ...]) -> str:
    if value not in of:
        raise ValueError(f"{name} must be one of {', '.join(of)}")
    return value


def mito_cutoff(value: float | str, name: str = "max_mito", adaptive: bool = False) -> float | str:
    """A fraction; over 1 and up to 100 counts as per cent (exactly 1 is a fraction)."""
    if adaptive and value == ADAPTIVE:
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = math.nan
    if not math.isfinite(number):
        raise ValueError(f"{name} must be a fraction" + f" or '{ADAPTIVE}'" * adaptive)
    if 1 < number <= 100:
        warnings.warn(f"{name} = {number:g} was taken as per cent", stacklevel=2)
        number /= 100
    if not 0 <= number <= 1:
        raise ValueError(f"{name} must be in [0, 1], or up to 100 per cent")
    return number


@dataclass(frozen=True)
class Columns:
    """Names of a cell table's columns."""

    sample: str = "sample"
    mito: str = "mitoRatio"
    group: str | None = None
    n_feature: str = "nFeature_RNA"
    n_count: str = "nCount_RNA"

    def __post_init__(self) -> None:
        if self.group is not None and self.group in ("", "NA"):
            object.__setattr__(self, "group", None)


@dataclass(frozen=True)
class Bounds:
    """Inclusive bounds of kept cells; None: no bound."""

    min_genes: float = 0
    max_genes: float = math.inf
    min_counts: float = 0
    max_counts: float = math.inf
    min_mito: float = 0

    def __post_init__(self) -> None:
        for f in fields(self)[:4]:
            scalar(getattr(self, f.name), f.name, 0, infinite=f.name.startswith("max"))
        object.__setattr__(self, "min_mito", mito_cutoff(self.min_mito, "min_mito"))
        for x in ("genes", "counts"):
            if getattr(self, f"min_{x}") > getattr(self, f"max_{x}"):
                raise ValueError(f"min_{x} is greater than max_{x}")


@dataclass(frozen=True)
class Detection:
    """Parameters of cutoff detection."""

    bin_width: float = 0.01
    min_cut: float = 0.01
    max_cut: float = 1.0
    min_drop_cells: float = 5
    min_drop_fraction: float = 0.01
    min_cells_after: float = 20
    min_retention_after: float = 0.1
    min_sample_support: float = 0.5
    loss_test: str = "mad_zscore"
    p_adjust: str = "BH"
    alpha: float = 0.05
    selection: str = "largest_drop"
    fallback: str = "quantile"
    fallback_quantile: float = 0.9
    species: str | None = None
    tissue: str | None = None
    reference_cutoff: float | None = None
    reference_warning: bool = True

    def __post_init__(self) -> None:
        scalar(self.bin_width, "bin_width", 0)
        scalar(self.min_cut, "min_cut", 0, 1)
        scalar(self.max_cut, "max_cut", 0, 1)
        if self.bin_width <= 0 or self.min_cut >= self.max_cut:
            raise ValueError("bin_width must be positive and min_cut less than max_cut")
        for name in ("min_drop_cells", "min_cells_after"):
            scalar(getattr(self, name), name, 0)
        for name in ("min_drop_fraction", "min_retention_after"):
            scalar(getattr(self, name), name, 0, 1)
        for name in ("min_sample_support", "alpha", "fallback_quantile"):
            open_unit(getattr(self, name), name)
        choice(self.loss_test, "loss_test", LOSS_TESTS)
        choice(self.p_adjust, "p_adjust", ADJUSTMENTS)
        choice(self.selection, "selection", SELECTIONS)
        choice(self.fallback, "fallback", FALLBACKS)
        if len(self.grid) < 2:
            raise ValueError("the grid needs two cutoffs at least")

    @property
    def grid(self) -> list[float]:
        """Candidate cutoffs from max_cut downwards, rounded to six places."""
        n = int((self.max_cut - self.min_cut) / self.bin_width + 1e-10)
        every = [round(max(self.max_cut - i * self.bin_width, self.min_cut), 6) for i in range(n + 1)]
        return [c for c in every if self.min_cut <= c <= self.max_cut]


def check_columns(df: DataFrame, names: list[str], numeric: list[str] = ()) -> None:
    """Looks at the schema alone; no job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for n in numeric:
        if not isinstance(df.schema[n].dataType, T.NumericType):
            raise ValueError(f"column {n} must be numeric")


def check_cells(cells: DataFrame, cols: Columns) -> None:
    """Samples, groups and fractions must not be null; one aggregation for all checks."""
    names = [cols.sample, cols.mito, *([cols.group] if cols.group else [])]
    check_columns(cells, names, [cols.mito])
    bad = cells.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).first()
    found = [n for n in names if bad[n]]
    if found:
        raise ValueError(f"null values in {', '.join(found)}")


def as_fraction(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns with a finite value over 1 are per cent in all rows; there is no upper limit."""
    check_columns(df, names, names)
    top = df.agg(*(F.max(F.when(F.abs(F.col(n)) < float("inf"), F.col(n))).alias(n) for n in names)).first()
    return df.withColumns({n: F.col(n) / 100 for n in names if top[n] is not None and top[n] > 1})


def checked_ratio(df: DataFrame, mito: str, convert_percent: bool = True) -> DataFrame:
    """An existing fraction column: no null, NaN, infinity or negative; up to 100 counts as per cent if allowed."""
    check_columns(df, [mito], [mito])
    c = F.col(mito).cast("double")
    wrong = F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    r = df.agg(wrong.alias("wrong"), F.min(c).alias("low"), F.max(c).alias("high")).first()
    if r["wrong"]:
        raise ValueError(f"{mito} has null or non-finite values")
    if r["low"] is not None and r["low"] < 0:
        raise ValueError(f"{mito} has negative values")
    if r["high"] is None or r["high"] <= 1:
        return df
    if r["high"] > 100 or not convert_percent:
        raise ValueError(f"{mito} is neither a fraction nor per cent")
    warnings.warn(f"{mito} was taken as per cent", stacklevel=2)
    return df.withColumn(mito, F.col(mito) / 100)
