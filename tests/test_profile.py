import math
import random

import numpy as np
import pytest

from granaria.operators.column_profile import Checks, profile

CHECKS = Checks(numeric={"a": (0.0, 100.0), "b": (None, None)}, words={"w": ("x", "y")})
SCHEMA = "load long, a double, b double, w string, value string, seq long"


def brute(rows):
    out = {}
    loads = sorted({r[0] for r in rows})
    for prev, load in zip([None, *loads], loads, strict=False):
        for i, c in ((1, "a"), (2, "b")):
            def ok(v):
                return v is not None and not math.isnan(v) and (c == "b" or 0 <= v <= 100)

            v = sorted(r[i] for r in rows if r[0] == load and ok(r[i]))
            p = sorted(r[i] for r in rows if r[0] == prev and ok(r[i]))
            ks = None
            if v and p:
                at = sorted(set(v) | set(p))
                ks = max(abs(np.searchsorted(v, x, "right") / len(v) - np.searchsorted(p, x, "right") / len(p)) for x in at)
            out[load, c] = (len(v), len(set(v)), float(np.percentile(v, 10)) if v else None, float(np.median(v)) if v else None, ks)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for load in (3, 5, 9):
        for _ in range(r.randint(40, 160)):
            a = r.choice([None, float("nan"), 7.0, 7.0, 7.0, r.uniform(-20, 120), r.gauss(50, load)])
            rows.append((load, a, r.choice([None, float(r.randint(0, 3))]), r.choice(["x", "y", "z", None]), "clash", 1))
    p = profile(spark.createDataFrame(rows, SCHEMA).repartition(5), "load", CHECKS)
    stats = {(s["load_id"], s["column_name"]): s for s in p.stats.collect()}
    drift = {(s["load_id"], s["column_name"]): s for s in p.drift.collect()}
    for (load, c), (n, d, p10, med, ks) in brute(rows).items():
        s = stats[load, c]
        assert (s["valid"], s["distinct_values"]) == (n, d)
        assert s["q10"] == pytest.approx(p10)
        assert s["q50"] == pytest.approx(med)
        if load != 3:
            assert drift[load, c]["ks_distance"] == pytest.approx(ks)


def test_findings(spark):
    rows = [(1, 10.0, 1.0, "x")] * 50 + [(2, 20.0, 1.0, "x")] * 44 + [(2, None, 1.0, "y")] * 6 + [(3, 20.0, None, "x")] * 40 + [(3, 200.0, 1.0, "bad")] * 10
    p = profile(spark.createDataFrame(rows, "load long, a double, b double, w string"), "load", CHECKS)
    got = {tuple(r) for r in p.findings.collect()}
    # 12 % nulls in load 2, none in 3; share of x from 1 to 0.88 to 0.8; b all null but ten
    assert got == {(2, "a", "drift"), (2, "a", "nulls"), (2, "w", "drift"), (3, "a", "nulls"), (3, "a", "range"), (3, "b", "nulls"), (3, "w", "pattern"), (3, "w", "drift")}


def test_borders_are_exact(spark):
    # exactly 2 % invalid and exactly 0.1 more nulls are no findings
    rows = [(1, 5.0, None, "x")] * 100 + [(2, 5.0, None, "x")] * 88 + [(2, 500.0, None, "x")] * 2 + [(2, None, None, "x")] * 10 + [(3, 5.0, None, "x")] * 98 + [(3, 500.0, None, "x")] * 2
    p = profile(spark.createDataFrame(rows, "load long, a double, b double, w string"), "load", CHECKS)
    assert {tuple(r) for r in p.findings.collect()} == {(2, "a", "range")}


def test_empty_and_null_loads(spark):
    empty = profile(spark.createDataFrame([], SCHEMA), "load", CHECKS)
    assert empty.stats.count() == empty.drift.count() == empty.findings.count() == 0
    rows = [(None, 1.0, 1.0, "x", "", 1), (4, None, None, None, "", 1)]
    p = profile(spark.createDataFrame(rows, SCHEMA), "load", CHECKS)
    s = {(r["load_id"], r["column_name"]): r for r in p.stats.collect()}
    assert s[None, "a"]["q50"] == 1.0
    assert s[4, "a"]["q50"] is None
    assert s[4, "w"]["nulls"] == 1
