import math
import random

import numpy as np
from pyspark.sql import functions as F

from siftwell.functions import numerics as N
from siftwell.operators import losstest


def test_upper_normal(spark):
    zs = [-40.0, -5.0, -1.0, -0.5, 0.0, 0.3, 0.67, 0.7, 1.0, 2.0, 3.0, 5.0, 5.65, 5.66, 8.0, 12.0, 20.0, 30.0, 37.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", N.upper_normal("z").alias("p")).collect():
        want = 0.5 * math.erfc(r.z / math.sqrt(2))
        assert abs(r.p / want - 1) < 1e-9, r.z


def test_poisson_tail():
    for mean in (0.01, 0.7, 3.0, 25.0, 140.0):
        for x in (0, 1, 2, 5, 30, 160):
            want = 1 - math.fsum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(x))
            assert abs(N.poisson_tail(x, mean) - want) < 1e-12


def type8(values, p):
    x, n = sorted(values), len(values)
    h = (n + 1 / 3) * p + 1 / 3
    j = math.floor(h + 4 * N.EPS)
    g = 0 if abs(h - j) < 4 * N.EPS else h - j
    at = lambda k: x[min(max(k, 1), n) - 1]
    return at(j) if g == 0 or at(j) == at(j + 1) else (1 - g) * at(j) + g * at(j + 1)


def test_quantiles(spark):
    rng = random.Random(1)
    groups = {"one": [0.5], "ties": [0.2] * 50 + [0.2001], "wide": [rng.random() * 40 - 5 for _ in range(333)], "five": [1.0, 2.0, 4.0, 8.0, 16.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("wide", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.25, 0.9):
        assert {r.k: r.q for r in N.quantile8(df, "k", "v", p).collect()} == {k: type8(v, p) for k, v in groups.items()}
    got = {r.k: (r.a, r.b) for r in N.quantile8_small(df, ["k"], "v", {"a": 0.25, "b": 0.75}).collect()}
    assert got == {k: (type8(v, 0.25), type8(v, 0.75)) for k, v in groups.items()}
    assert abs(got["five"][0] - 5 / 3) < 1e-12
    assert {r.k: r.m for r in N.medians(df, "k", {"m": ("v", 100)}).collect()} == {k: float(np.median(v)) for k, v in groups.items()}


def test_snap(spark):
    got = [r[0] for r in spark.createDataFrame([(0.025,), (0.034,), (2.0,), (-1.0,), (None,), (float("nan"),)], "x double").select(N.snap(F.col("x"), 0.01, 0.01, 1.0)).collect()]
    assert got == [0.02, 0.03, 1.0, 0.01, None, None]
    assert N.token(0.9) == "0.90" and N.token(0.975) == "0.975"


def adjusted(p, method):
    n, order = len(p), np.argsort(p, kind="stable")
    s = np.array(p)[order]
    k = np.arange(1, n + 1)
    if method == "holm":
        x = np.maximum.accumulate((n - k + 1) * s)
    elif method == "hochberg":
        x = np.minimum.accumulate(((n - k + 1) * s)[::-1])[::-1]
    elif method == "bonferroni":
        x = n * s
    else:
        c = sum(1 / i for i in k) if method == "BY" else 1
        x = np.minimum.accumulate((c * n / k * s)[::-1])[::-1]
    out = np.empty(n)
    out[order] = np.minimum(x, 1)
    return out


def test_adjustment(spark):
    p = [0.01, 0.02, 0.02, 0.03, 0.5, 1.0, 1.0, 0.0004, 0.049]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(p)], "sample string, interval_index int, p_value double")
    for method in ("holm", "hochberg", "bonferroni", "BH", "fdr", "BY"):
        got = [r.p_adj for r in losstest.adjusted(df, method).orderBy("interval_index").collect()]
        assert np.allclose(got, adjusted(p, method), rtol=1e-12), method
    hommel = [r.p_adj for r in losstest.adjusted(df, "hommel").orderBy("interval_index").collect()]
    assert (np.array(hommel) <= adjusted(p, "hochberg") + 1e-12).all() and (np.array(hommel) >= p).all()
    # Simes over every subset, by brute force
    small = p[:5]
    want = [max(min(len(s) * v / (i + 1) for i, v in enumerate(sorted(small[j] for j in s))) for m in range(1, 32) if (s := [j for j in range(5) if m >> j & 1]) and k in s) for k in range(5)]
    got = [r.p_adj for r in losstest.adjusted(df.where("interval_index < 5"), "hommel").orderBy("interval_index").collect()]
    assert np.allclose(got, want)
