"""Number columns against Python's own arithmetic."""

import random

from pyspark.sql import functions as F

from siteready.functions import numbers as N
from siteready.operators.quantiles import nearest_rank, weighted_median


def test_rounding_is_exact_half_even(spark):
    rnd = random.Random(1)
    values = [2.675, 0.125, 0.375, -2.675, 1.005, 2.5, 0.0, 1e15, 0.045] + [rnd.randint(-10**6, 10**6) / 2000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        for row in df.select("x", N.round_half_even(F.col("x"), digits).alias("r")).collect():
            assert row.r == round(row.x, digits), (row.x, digits)


def test_interpolation_clamps_both_ends(spark):
    df = spark.createDataFrame([(0.0,), (2500.0,), (3250.0,), (4000.0,), (9000.0,), (None,)], "x double")
    got = [r[0] for r in df.select(N.interpolate(F.col("x"), [(2500, 100), (4000, 50), (8000, 0)])).collect()]
    assert got == [100, 100, 75, 50, 0, None]


def test_stored_share_never_reaches_a_missed_threshold(spark):
    df = spark.createDataFrame([(0.84953,), (0.9467,), (0.18452,), (0.5999,), (0.85,)], "x double")
    got = [r[0] for r in df.select(N.stored_share(F.col("x"), [0.85, 0.7, 0.6, 0.5])).collect()]
    assert got == [0.849, 0.947, 0.184, 0.599, 0.85]


def test_format_share(spark):
    df = spark.createDataFrame([(0.123,), (0.185,), (0.849,), (0.499,), (None,)], "x double")
    assert [r[0] for r in df.select(N.format_share(F.col("x"))).collect()] == ["12 %", "19 %", "84 %", "49,9 %", "n/d"]


def test_weighted_median_equals_expanded_median(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([-3.5, 0.0, 1.0, 1.001, 1.002, 250.0, 251.0, 252.5]), rnd.choice([1, 2])) for k in range(60) for _ in range(rnd.randint(1, 9))]
    got = {r.k: r.median for r in weighted_median(spark.createDataFrame(rows, "k int, v double, w int"), ["k"], F.col("v"), F.col("w")).collect()}
    for k in {r[0] for r in rows}:
        xs = sorted(v for kk, v, w in rows if kk == k for _ in range(w))
        n = len(xs)
        assert got[k] == (xs[(n - 1) // 2] + xs[n // 2]) / 2


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 101)], "k int, v double")
    row = nearest_rank(df, ["k"], F.col("v"), {"p50": 0.5, "p95": 0.95}).first()
    assert (row.p50, row.p95) == (50.0, 95.0)
