"""Numbers as Catalyst expressions: null stands for what is missing or not finite."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 2.220446049250313e-16
TINY = 2.2250738585072014e-308

# Rational approximations of the normal distribution (W. J. Cody, 1969).
CENTRE = ((2.2352520354606839287, 161.02823106855587881, 1067.6894854603709582, 18154.981253343561249, 0.065682337918207449113), (47.20258190468824187, 976.09855173777669322, 10260.932208618978205, 45507.789335026729956))
SHOULDER = (
    (0.39894151208813466764, 8.8831497943883759412, 93.506656132177855979, 597.27027639480026226, 2494.5375852903726711, 6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218, 1.0765576773720192317e-8),
    (22.266688044328115691, 235.38790178262499861, 1519.377599407554805, 6485.558298266760755, 18615.571640885098091, 34900.952721145977266, 38912.003286093271411, 19685.429676859990727),
)
TAIL = ((0.21589853405795699, 0.1274011611602473639, 0.022235277649888, 0.001421619193227893466, 2.9112874951168792e-5, 0.02307344176494017303), (1.28426009614491121, 0.468238212480865118, 0.0659881378689285515, 0.00378239633202758244, 7.29751555083966205e-5))


def ratio(x: str, top: tuple[float, ...], below: tuple[float, ...]) -> str:
    """SQL of a rational function: leading coefficient last, as the sources list it."""
    num, den = f"({sql(top[-1])} * {x})", x
    for i in range(len(below) - 1):
        num, den = f"(({num} + {sql(top[i])}) * {x})", f"(({den} + {sql(below[i])}) * {x})"
    return f"(({num} + {sql(top[len(below) - 1])}) / ({den} + {sql(below[-1])}))"


def sql(x: float) -> str:
    """A double in any dialect (plain decimals would become DECIMAL)."""
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


def upper_normal_sql(z: str) -> str:
    """P(Z > z) in SQL that Spark and DuckDB both read."""
    y = f"abs({z})"
    cut = f"(floor({y} * 16e0) / 16e0)"
    scale = f"(exp(-{cut} * {cut} * 0.5e0) * exp(-({y} - {cut}) * ({y} + {cut}) * 0.5e0))"
    square, inverse = f"({z} * {z})", f"(1e0 / greatest({z} * {z}, 1e-300))"
    far = f"((0.398942280401432677939946059934e0 - {inverse} * {ratio(inverse, TAIL[0], TAIL[1])}) / greatest({y}, 1e-300))"
    tail = f"({scale} * case when {y} <= 5.656854249492380195e0 then {ratio(y, SHOULDER[0], SHOULDER[1])} else {far} end)"
    near = f"(0.5e0 - {z} * {ratio(square, CENTRE[0], CENTRE[1])})"
    return f"(case when {z} is null then null when {y} <= 0.67448975e0 then {near} when {y} > 39e0 then case when {z} > 0e0 then 0e0 else 1e0 end when {z} > 0e0 then {tail} else 1e0 - {tail} end)"


def rational(x: Column, top: tuple[float, ...], below: tuple[float, ...]) -> Column:
    """The same as ratio(), as a Column: deeply nested SQL takes the parser very long."""
    num, den = x * top[-1], x
    for i in range(len(below) - 1):
        num, den = (num + top[i]) * x, (den + below[i]) * x
    return (num + top[len(below) - 1]) / (den + below[-1])


def upper_normal(name: str) -> Column:
    """P(Z > z) of a column, by name."""
    z = F.col(name)
    y, square = F.abs(z), z * z
    cut = F.floor(y * 16.0) / 16.0
    scale = F.exp(-cut * cut * 0.5) * F.exp(-(y - cut) * (y + cut) * 0.5)
    inverse = 1.0 / F.greatest(square, F.lit(1e-300))
    far = (F.lit(0.398942280401432677939946059934) - inverse * rational(inverse, *TAIL)) / F.greatest(y, F.lit(1e-300))
    tail = scale * F.when(y <= 5.656854249492380195, rational(y, *SHOULDER)).otherwise(far)
    near = 0.5 - z * rational(square, *CENTRE)
    sure = F.when(y > 39.0, F.when(z > 0, 0.0).otherwise(1.0))
    return F.when(z.isNotNull(), F.when(y <= 0.67448975, near).otherwise(F.coalesce(sure, F.when(z > 0, tail).otherwise(1.0 - tail))))


@F.arrow_udf(T.DoubleType())
def upper_poisson(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """P(X >= x) of a Poisson distribution with mean m; one row an interval, so rows are few."""
    for x, m in batches:
        yield pa.array([None if a is None or b is None else poisson_tail(a, b) for a, b in zip(x.to_pylist(), m.to_pylist(), strict=True)], pa.float64())


def poisson_tail(x: float, mean: float) -> float:
    """P(X >= x): the regularised lower incomplete gamma function at (x, mean)."""
    a = math.ceil(x - 1e-7)
    if a <= 0:
        return 1.0
    lead = math.exp(a * math.log(mean) - mean - math.lgamma(a + 1)) if mean > 0 else 0.0
    if mean < a + 1:  # series of P
        total, term, k = 1.0, 1.0, a
        while term > total * 1e-17:
            k += 1
            term *= mean / k
            total += term
        return min(1.0, lead * total)
    tiny = 1e-300  # continued fraction of Q
    b = mean + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - lead * a * h)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def snap(c: Column, bin_width: float, low: float, high: float) -> Column:
    """To the nearest multiple of bin_width (halves to even), into [low, high], six places."""
    near = F.rint(c / bin_width) * bin_width
    return F.when(finite(c), F.round(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), near)), 6))


def token(x: float) -> str:
    """A number with two decimals at least."""
    out = f"{x:.7g}"
    return out if len(out.partition(".")[2]) >= 2 else f"{x:.2f}"


# -- statistics of short sorted arrays ------------------------------------------------


def at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def median_of(a: Column) -> Column:
    """Median of a sorted array; null if empty."""
    n = F.size(a)
    return F.when(n > 0, (at(a, F.floor((n - 1) / 2)) + at(a, F.floor(n / 2))) / 2.0)


def quantile_of(a: Column, p: float) -> Column:
    """Type-7 quantile of a sorted array."""
    h = (F.size(a) - 1) * F.lit(float(p))
    low, high = at(a, F.floor(h)), at(a, F.ceil(h))
    return F.when(F.size(a) > 0, low + (h - F.floor(h)) * (high - low))


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def sd_of(a: Column, mean: Column) -> Column:
    """Sample standard deviation; null below two values."""
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size(a) - 1)))


# -- exact type-8 quantiles of groups of any size -------------------------------------


def type8(n: str, p: float) -> tuple[str, str, str]:
    """SQL of the lower rank, the upper rank (1-based, clamped) and the weight of the upper value."""
    h = f"(({n} + 1e0 / 3e0) * {sql(p)} + 1e0 / 3e0)"
    j = f"floor({h} + {sql(4 * EPS)})"
    w = f"(case when abs({h} - {j}) < {sql(4 * EPS)} then 0e0 else {h} - {j} end)"
    clamp = lambda x: f"cast(least(greatest({x}, 1), {n}) as bigint)"
    return clamp(j), clamp(f"{j} + 1"), w


def type7_median(n: str, p: float = 0.5) -> tuple[str, str, str]:
    """The same for the median: both middle ranks, weighing alike."""
    del p
    return f"cast(floor(({n} + 1) / 2e0) as bigint)", f"cast(floor({n} / 2e0) + 1 as bigint)", "0.5e0"


def quantile8(rows: DataFrame, key: str, value: str, p: float, bins: float = 10_000, kind=type8, few: bool = False) -> DataFrame:
    """key and q, the exact type-8 quantile (or median) of the key's non-null values.

    Two passes: counts by key and bin tell which bins hold the two order statistics; only those bins' distinct values,
    counted, are ranked. A key of any size is one row a bin after partial aggregation, so no task holds a key's rows.
    few: keys are so few that the chosen bins, two a key at most, are broadcast, and the rows stay where they are.
    """
    some = rows.select(key, F.col(value).cast("double").alias("__v")).where("__v is not null").withColumn("__b", F.floor(F.col("__v") * bins))
    up = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counted = some.groupBy(key, "__b").agg(F.count("*").alias("__c")).withColumns({"__upto": F.sum("__c").over(up), "__n": F.sum("__c").over(Window.partitionBy(key))})
    lo, hi, w = kind("__n", p)
    placed = counted.withColumns({"__lo": F.expr(lo), "__hi": F.expr(hi), "__w": F.expr(w), "__before": F.col("__upto") - F.col("__c")})
    holds = " or ".join(f"({r} > __before and {r} <= __upto)" for r in ("__lo", "__hi"))
    chosen = placed.where(holds).select(key, "__b", "__before", "__lo", "__hi", "__w")
    values = some.join(F.broadcast(chosen) if few else chosen, [key, "__b"]).groupBy(key, "__b", "__v", "__before", "__lo", "__hi", "__w").agg(F.count("*").alias("__c"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(key, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__c"))
    pick = lambda r: F.max(F.when((F.col(r) > F.col("__from")) & (F.col(r) <= F.col("__upto")), F.col("__v")))
    both = ranked.groupBy(key).agg(pick("__lo").alias("__x"), pick("__hi").alias("__y"), F.max("__w").alias("__w"))
    q = F.when((F.col("__w") > 0) & (F.col("__w") < 1) & (F.col("__x") != F.col("__y")), (1 - F.col("__w")) * F.col("__x") + F.col("__w") * F.col("__y")).when(F.col("__w") >= 1, F.col("__y")).otherwise(F.col("__x"))
    return both.select(key, q.alias("q"))


def medians(rows: DataFrame, key: str, values: dict[str, tuple[str, float]]) -> DataFrame:
    """key and an exact median for each name; values: name -> (column, bins a unit). Keys are few: stages or strategies."""
    out = rows.select(key).distinct()
    for name, (column, bins) in values.items():
        out = out.join(quantile8(rows, key, column, 0.5, bins, type7_median, few=True).withColumnRenamed("q", name), key, "left")
    return out


def quantile8_small(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Several type-8 quantiles of small groups, from sorted arrays."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("__a"))  # a group is a grid's worth of values
    out = {}
    for name, p in probs.items():
        lo, hi, w = type8("size(__a)", p)
        x, y = f"element_at(__a, cast({lo} as int))", f"element_at(__a, cast({hi} as int))"
        out[name] = F.expr(f"case when size(__a) = 0 then null when {w} > 0 and {x} <> {y} then (1e0 - {w}) * {x} + {w} * {y} else {x} end")
    return got.withColumns(out).drop("__a")
