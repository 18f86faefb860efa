"""Mutual information from neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbours


def digamma(n):
    return -0.57721566490153286061 + sum(1 / i for i in range(1, n))


def near(r, apart):
    return (apart < r) | ((r == 0) & (apart == 0))


def numbers(x, y, k):
    x, y = (v / (float(f"{v.std():.10g}") or 1.0) for v in (x, y))
    n, out = len(x), []
    for i in range(n):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        r = np.sort(np.delete(np.maximum(dx, dy), i))[k - 1]
        out.append(digamma(int(near(r, dx).sum())) + digamma(int(near(r, dy).sum())))
    return max(0.0, digamma(n) + digamma(k) - np.mean(out))


def category(x, g, k):
    keep = np.array([(g == v).sum() > 1 for v in g])
    every, x, g, out = x, x[keep], g[keep], []
    for i in range(len(x)):
        own = x[g == g[i]]
        kk = min(k, len(own) - 1)
        r = np.sort(np.abs(own - x[i]))[kk]
        out.append(digamma(kk) - digamma(len(own)) - digamma(int(near(r, np.abs(x - x[i])).sum())))
    return max(0.0, digamma(len(x)) + np.mean(out)) if len(every) else 0.0


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.4, np.round(rng.normal(size=n), 1), rng.normal(size=n))
    y = np.where(rng.random(n) < 0.3, np.round(x + rng.normal(size=n) * 0.4, 1), x**2 + rng.standard_cauchy(n) * 0.1)
    g = np.where(rng.random(n) < 0.02, [f"lone{k}" for k in range(n)], np.where(x > 0.3, "a", "b"))
    return x, y, g


def test_digamma(spark):
    rows = spark.range(1, 200).select("id", neighbours.digamma(F.col("id")).alias("d")).collect()
    assert [r.d for r in rows] == pytest.approx([digamma(r.id) for r in rows], abs=1e-12)


@pytest.mark.parametrize(("parts", "stretch"), [(1, 2_048), (5, 150)])
def test_against_brute_force(spark, monkeypatch, parts, stretch):
    monkeypatch.setattr(neighbours, "STRETCH", stretch)
    x, y, g = sample(600, 1)
    rows = [(float(a), float(b), str(c)) for a, b, c in zip(x, y, g, strict=True)] + [(None, 1.0, "a"), (1.0, None, None), (math.nan, 2.0, "b")]
    df = spark.createDataFrame(rows, "x double, y double, g string").repartition(parts)
    known = np.append(x, 1.0)
    assert len(known) == 601
    got = neighbours.of_category(df, "x", "g").first()
    assert got.mi == pytest.approx(category(x, g, 3), abs=1e-9)


def test_few_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b")], "x double, g string")
    assert neighbours.of_category(df, "x", "g").first().n == 2
    assert tuple(neighbours.of_category(df.limit(0), "x", "g").first()) == (0, 0.0)


@pytest.mark.parametrize(("parts", "stretch"), [(1, 2_048), (5, 100)])
def test_two_numbers_against_brute_force(spark, monkeypatch, parts, stretch):
    monkeypatch.setattr(neighbours, "STRETCH", stretch)
    x, y, _ = sample(600, 1)
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0), (math.nan, 2.0)], "x double, y double").repartition(parts)
    got = neighbours.of_numbers(df, "x", "y").first()
    assert got.n == 600 and got.mi == pytest.approx(numbers(x, y, 3), abs=1e-9)
    assert tuple(neighbours.of_numbers(df.limit(3), "x", "y").first()) == (3, 0.0)
