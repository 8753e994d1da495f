import numpy as np
import pytest

from granaria.operators.hamming import duplicates_across
from granaria.operators.quantiles import exact_quantiles

POINTS = (0.0, 0.1, 0.5, 0.95, 1.0)


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(4)
    rows = [("a", float(v)) for v in r.normal(size=400)] + [("hot", 7.0)] * 500 + [(None, float(v)) for v in r.integers(0, 5, 31)] + [("one", -2.5), ("none", None), ("a", None), ("a", float("nan")), ("zero", -0.0), ("zero", 0.0)]
    df = spark.createDataFrame(rows, "c string, v double").repartition(3)
    got = {x["c"]: x["q"] for x in exact_quantiles(df, ["c"], "v", POINTS).collect()}
    assert set(got) == {"a", "hot", None, "one", "zero"}
    for c, q in got.items():
        values = [v for k, v in rows if k == c and v is not None and v == v]
        assert q == pytest.approx(list(np.quantile(values, POINTS)))
    whole = exact_quantiles(df, [], "v", (0.5,)).collect()
    assert whole[0]["q"] == pytest.approx([np.median([v for _, v in rows if v is not None and v == v])])
    assert exact_quantiles(df.limit(0), ["c"], "v", POINTS).count() == exact_quantiles(df.limit(0), [], "v", POINTS).count() == 0


def test_pairs_across_groups(spark):
    rows = [(1, "b", "g", 5), (2, "a", "h", 5), (3, "c", "g", 7), (4, "d", "k", 1 << 40), (5, "e", "g", 5), (6, "f", "h", None)]
    df = spark.createDataFrame(rows, "row_id long, path_k string, grp string, fp long")
    got = {tuple(x) for x in duplicates_across(df.unionByName(df.limit(2)).distinct()).collect()}
    assert got == {(2, 1, 0), (2, 5, 0), (2, 3, 1), (1, 4, 3), (2, 4, 3), (3, 4, 4), (4, 5, 3)}
