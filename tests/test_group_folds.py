"""Group folds against a plain greedy loop."""

import random
from collections import Counter

import pytest

from tabloom.operators import split


def greedy(sizes, k):
    rows, groups = [0] * k, [0] * k
    for n in sorted(sizes, reverse=True):
        f = rows.index(min(rows))
        rows[f] += n
        groups[f] += 1
    return rows, groups


@pytest.mark.parametrize("seed", range(30))
def test_deal_is_the_greedy_loop(seed):
    rng = random.Random(seed)
    k = rng.randint(1, 7)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 8, 40, rng.randint(1, 300)]) for _ in range(rng.randint(0, 400))]
    histogram = sorted(Counter(sizes).items(), reverse=True)
    rows, groups = [0] * k, [0] * k
    for size, upto in split.deal(histogram, k):
        taken = [b - a for a, b in zip([0, *upto], upto)]
        assert sum(taken) == dict(histogram)[size]
        rows = [r + size * t for r, t in zip(rows, taken, strict=True)]
        groups = [g + t for g, t in zip(groups, taken, strict=True)]
    assert (rows, groups) == greedy(sizes, k)


def test_ten_million_groups_of_one_row():
    (_, big), (_, ones) = split.deal([(3, 2), (1, 10_000_000)], 4)
    rows = [3 * a + b for a, b in zip([big[0], *[y - x for x, y in zip(big, big[1:])]], [ones[0], *[y - x for x, y in zip(ones, ones[1:])]], strict=True)]
    assert sum(rows) == 10_000_006 and max(rows) - min(rows) <= 1


@pytest.mark.parametrize("parts", [1, 5])
def test_whole_groups_and_a_null_group(spark, parts):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, "a", "b", *(f"g{j}" for j in range(40))]) if k % 3 else "big") for k in range(900)]
    got = split.group_folds(spark.createDataFrame(rows, "id long, g string").repartition(parts), "g", 4).collect()
    assert len(got) == 900
    of = {}
    for r in got:
        assert of.setdefault(r.g, r.fold) == r.fold
    sizes = Counter(g for _, g in rows)
    assert [sum(sizes[g] for g in of if of[g] == f) for f in range(4)] == greedy(list(sizes.values()), 4)[0]
