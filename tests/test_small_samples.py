"""Shapiro and Wilk's test against published values, and exact tails against all arrangements."""

import itertools
import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabloom.functions.tails import ks_exact, normal_quantile, normal_tail
from tabloom.operators import associate

# Weights of eleven men (Shapiro and Wilk, 1965), and stopping distances and speeds of fifty cars, with W and p-value as published. Fixed values.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
DISTANCES = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60, 80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84, 36, 46, 68, 32, 48, 52, 56, 64, 66, 54, 70, 92, 93, 120, 85]
SPEEDS = [4, 4, 7, 7, 8, 9, 10, 10, 10, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 15, 15, 15, 16, 16, 17, 17, 17, 18, 18, 18, 18, 19, 19, 19, 20, 20, 20, 20, 20, 22, 23, 24, 24, 24, 24, 25]


@pytest.mark.parametrize("parts", [1, 4])
def test_published_values(spark, parts):
    rows = list(itertools.zip_longest(map(float, MEN), map(float, DISTANCES), map(float, SPEEDS), [1.0, 2.0, 9.0], [5.0] * 9, [1.0, 2.0], [float(k) for k in range(5)]))
    df = spark.createDataFrame(rows, "men double, dist double, speed double, three double, same double, two double, five double").repartition(parts)
    got = {r.column: r for r in associate.shapiro_wilk(df, df.columns).collect()}
    assert (got["men"].w, got["men"].p_value) == pytest.approx((0.78881, 0.006704), abs=5e-6)
    assert (got["dist"].w, got["dist"].p_value) == pytest.approx((0.95144, 0.0391), abs=5e-5)
    assert (got["speed"].w, got["speed"].p_value) == pytest.approx((0.97765, 0.4576), abs=5e-5)
    # Of three values W is that of the largest gap: (3 - 1)^2 / 2 over the sum of squares.
    assert got["three"].w == pytest.approx(8**2 / 2 / (3 * statistics.pvariance([1, 2, 9])))
    assert (got["same"].w, got["same"].p_value, "two" in got) == (1.0, 1.0, False)
    assert 0.9 < got["five"].w <= 1 and got["five"].p_value > 0.9


def test_sizes_choose_the_test(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1) if k < 300 else None, None if k else 1.0) for k in range(5_200)]
    got = {r.column: r for r in associate.normality_test(spark.createDataFrame(rows, "many double, few double, one double"), ["many", "few", "one"]).collect()}
    assert (got["many"].test, got["few"].test, got["one"].test) == ("skewness_kurtosis", "shapiro_wilk", None)
    assert got["few"].is_normal and not got["one"].is_normal and (got["few"].n, got["one"].n) == (300, 1)


def test_normal_scores_and_tails(spark):
    p = [1e-12, 1e-6, 0.01, 0.074, 0.075, 0.3, 0.5, 0.8, 0.926, 0.999999]
    normal = statistics.NormalDist()
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("z")).withColumn("t", normal_tail("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(normal.inv_cdf(r.p), rel=1e-12, abs=1e-14)
        assert r.t == pytest.approx(1 - r.p, rel=1e-9)


@pytest.mark.parametrize(("n", "m"), [(1, 1), (2, 5), (6, 6), (3, 4), (6, 4), (5, 5)])
def test_exact_distance_over_all_arrangements(n, m):
    found = []
    for first in itertools.combinations(range(n + m), n):
        a = b = 0
        top = 0.0
        for k in range(n + m):
            a, b = a + (k in first), b + (k not in first)
            top = max(top, abs(a / n - b / m))
        found.append(top)
    for d in sorted(set(found)):
        assert ks_exact(d, n, m) == pytest.approx(sum(x >= d - 1e-12 for x in found) / len(found), abs=1e-12)


def test_small_samples_have_exact_p_values(spark):
    df = spark.createDataFrame([(float(k), k < 4) for k in range(8)], "x double, first boolean")
    row = associate.shift(df, "x", "first").first()
    assert row.d == 1 and row.p_value == pytest.approx(2 / 70) and row.shifted
    assert ks_exact(0.02, 4_000, 3_000) == pytest.approx(0.4953, abs=5e-3)


def test_small_tails_are_as_exact_as_large_ones():
    """Against counts of lattice paths in whole numbers, whose doubles would overflow: 1.6e-11 at six times the suppliers of sf0.1."""
    for n, m, most in ((2826, 3174, 827528), (300, 200, 30000), (471, 529, 22987)):
        row = [int(j * n < most) for j in range(m + 1)]
        for i in range(1, n + 1):
            run, low, high = 0, max(0, (i * m - most) // n), min(m, (i * m + most) // n + 1)
            new = [0] * (m + 1)
            for j in range(low, high + 1):
                if abs(i * m - j * n) < most:
                    new[j] = run = run + row[j]
            row = new
        all_, inside = math.comb(n + m, n), row[m]
        assert ks_exact(most / (n * m), n, m) == pytest.approx(float(Fraction(all_ - inside, all_)), rel=1e-11, abs=0)
