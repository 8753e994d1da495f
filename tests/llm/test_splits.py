import itertools
import random

import numpy as np
import pytest

from granaria.llm import splits as sp

T = {"train": 0.6, "val": 0.2, "test": 0.2}


@pytest.mark.parametrize("seed", range(5))
def test_subset_near_is_closest(seed):
    r = random.Random(seed)
    items = [(r.randint(1, 30), r.randint(1, 3)) for _ in range(5)]
    items = list({s: m for s, m in items}.items())
    target = r.uniform(0, sum(s * m for s, m in items))
    got = sp.subset_near(items, target)
    total = sum(s * n for s, n in got.items())
    assert all(n <= dict(items)[s] for s, n in got.items())
    best = min(abs(sum(s * c for (s, _), c in zip(items, cs, strict=True)) - target) for cs in itertools.product(*[range(m + 1) for _, m in items]))
    assert abs(total - target) == pytest.approx(best)


def test_subset_near_with_many_copies():
    """Only copies near the relaxed solution stay open, and the sum is still the closest one."""
    r = random.Random(11)
    for _ in range(40):
        items = {r.randint(2, 9): r.randint(1, 400) for _ in range(3)}
        target = r.uniform(0, sum(s * m for s, m in items.items()))
        got = sp.subset_near(list(items.items()), target)
        assert all(n <= items[s] for s, n in got.items())
        reach = {0}
        for s, m in items.items():
            reach = {a + s * k for a in reach for k in range(m + 1)}
        assert abs(sum(s * n for s, n in got.items()) - target) == pytest.approx(min(abs(x - target) for x in reach))


def test_deal_large_total_uses_every_copy():
    sizes = {700: 1, 90: 4, 7: 100, 1: 3_000_000}
    total = sum(s * m for s, m in sizes.items())
    given = sp.deal(sizes, {k: v * total for k, v in T.items()})
    for s, m in sizes.items():
        assert sum(g.get(s, 0) for g in given.values()) == m
    for k, v in T.items():
        assert abs(sum(s * n for s, n in given[k].items()) - v * total) <= 1


def test_place_vectors_leaves_nothing_over_a_target():
    r = np.random.default_rng(5)
    vectors = np.unique(np.concatenate([r.integers(0, 40, (60, 8)) * (r.random((60, 8)) < 0.4), [[300] * 8]]), axis=0).astype(float)
    vectors = vectors[(vectors > 0).sum(1) > 1]
    copies = r.integers(1, 4, len(vectors))
    total = (vectors * copies[:, None]).sum(0) * 1.5
    wants = total[:, None] * np.array([0.6, 0.2, 0.2])
    given = sp.place_vectors(vectors, copies, wants)
    assert (given.sum(1) == copies).all()
    assert np.maximum(vectors.T @ given - wants, 0).sum() == 0


def test_groups_with_two_views(spark):
    """Three labels, six groups of two records each: no group in two splits, and each label near its shares."""
    rows = [(36 * 0 + label * 12 + g * 2 + view, f"l{label}", None, f"{label}-{g}") for label in range(3) for g in range(6) for view in range(2)]
    out = sp.assign_splits(records(spark, rows), T).collect()
    assert len(out) == 36
    by = {}
    for x in out:
        by.setdefault(x["component"], set()).add(x["split"])
    assert len(by) == 18 and all(len(v) == 1 for v in by.values())
    for label in range(3):
        mine = [x["split"] for x in out if x["stratum"] == f"l{label}"]
        assert [mine.count(s) for s in ("train", "val", "test")] == [8, 2, 2]


def records(spark, rows):
    return spark.createDataFrame(rows, "row_id long, stratum string, split string, group string")


def test_assignment(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a/f", "b/f"]), None, None) for i in range(200)]
    n = 200
    for g in range(60):
        stratum = r.choice(["a/f", "b/f"])
        for _ in range(r.randint(1, 12)):
            rows.append((n, stratum, None, f"g{g}"))
            n += 1
    for _ in range(300):
        rows.append((n, r.choice(["a/f", "b/f"]), None, "hot"))
        n += 1
    rows += [(n, None, "train", None), *rows[:9]]
    out = sp.assign_splits(records(spark, rows), T).collect()
    assert len(out) == n + 1
    by = {}
    for x in out:
        by.setdefault(x["component"], set()).add(x["split"])
    assert all(len(v) == 1 for v in by.values())
    for s in ("a/f", "b/f"):
        mine = [x["split"] for x in out if x["stratum"] == s]
        for k, v in T.items():
            assert abs(mine.count(k) - v * len(mine)) <= 1


def test_broken_groups(spark):
    rows = [(5, "s", "train", "g"), (3, "s", None, "g"), (9, "s", "val", "g"), (7, "s", "train", "h"), (8, "s", None, "h"), (1, "s", "train", None), (2, "s", "val", None)]
    got = [(x["component"], x["splits"]) for x in sp.broken_groups(records(spark, [*rows, rows[0]])).collect()]
    assert got == [(3, ["train", "val"])]


def test_empty(spark):
    e = records(spark, [])
    assert sp.assign_splits(e, T).count() == sp.broken_groups(e).count() == 0
    assert sp.split_shares(sp.assign_splits(e, T), T).count() == 0
