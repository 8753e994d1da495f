import random

import pytest

from granaria.llm.grouping import group_links, review_links


def union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(parent)}


def shapes():
    r = random.Random(11)
    names = r.sample(range(10_000), 900)
    chain = list(zip(names[:120], names[1:120], strict=False))
    ring = [*zip(names[130:170], names[131:170], strict=False), (names[130], names[169])]
    star = [(names[200], n) for n in names[201:260]]
    broom = [*zip(names[300:330], names[301:330], strict=False), *[(names[329], n) for n in names[330:345]]]
    tree = [(names[400 + i], names[400 + r.randint(0, i - 1)]) for i in range(1, 90)]
    dense = [(names[500 + r.randint(0, 30)], names[500 + r.randint(0, 30)]) for _ in range(120)]
    lone = [(names[600], names[601])]
    two_rings = [*zip(names[610:620], names[611:620], strict=False), (names[610], names[619]), *zip(names[620:630], names[621:630], strict=False), (names[620], names[629]), (names[612], names[625])]
    return {"chain": chain, "ring": ring, "star": star, "broom": broom, "tree": tree, "dense": dense, "lone": lone, "two_rings": two_rings}


@pytest.mark.parametrize("kind", [*shapes(), "all"])
def test_shapes(spark, kind):
    s = shapes()
    pairs = [p for v in s.values() for p in v] if kind == "all" else s[kind]
    noisy = [*pairs, *[(b, a) for a, b in pairs[:20]], *pairs[:10], (pairs[0][0], pairs[0][0]), (None, 1), (1, None)]
    got = {x["v"]: x["group"] for x in group_links(spark.createDataFrame(noisy, "a long, b long")).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]])


def test_empty(spark):
    assert group_links(spark.createDataFrame([], "a long, b long")).count() == 0
    assert group_links(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_review_links(spark):
    m = spark.createDataFrame([(1, "raw/Táo (1).jpg", "x"), (1, "raw/Táo (1).jpg", "x"), (2, "raw/b.jpg", "x"), (3, None, "x")], "row_id long, path string, a string")
    v = spark.createDataFrame([("RAW\\TÁO (1).JPG ", "raw/B.jpg"), ("raw/b.jpg", "raw/táo (1).jpg"), ("raw/b.jpg", "RAW/b.jpg"), ("raw/b.jpg", None), ("raw/b.jpg", "gone")], "path_a string, path_b string")
    assert {frozenset(x) for x in review_links(v, m).collect()} == {frozenset((1, 2))}
