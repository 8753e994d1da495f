import random

from granaria.operators.components import connected_components, link_by_keys
from granaria.operators.hamming import near_pairs


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


def test_components(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    shuffled = [(b, a) for a, b in zip(*[r.sample(range(2000, 2100), 100) for _ in range(2)], strict=True) if a != b]
    star = [(5, i) for i in range(100, 160)]
    pairs = [*chain, *shuffled, *star, (7, 7), (5, 100), (100, 5)]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = {x["v"]: x["root"] for x in connected_components(df).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]])


def test_hubs_are_split(spark, monkeypatch):
    """With hubs from ten rows on, results are the same: stars, a hub in the middle of chains, a hot key."""
    from granaria.operators import components as c

    monkeypatch.setattr(c, "HUB", 10)
    monkeypatch.setattr(c, "HUBS", 10)
    pairs = [(0, i) for i in range(1, 90)] + [(i, i + 100) for i in range(1, 90)] + [(500, 400 + i) for i in range(60)] + [(700, 701)]
    got = {x["v"]: x["root"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union(pairs)
    rows = [(i, "hot") for i in range(50)] + [(i, f"k{i // 2}") for i in range(50, 80)] + [(90, None)]
    got = dict(map(tuple, link_by_keys(spark.createDataFrame(rows, "id long, k string"), "id", ["k"]).collect()))
    assert got == {i: 0 if k == "hot" else i if k is None else i - i % 2 for i, k in rows}


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_by_keys(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (5, "b", None), (5, "c", None), (6, "c", None), (6, "c", None)]
    df = spark.createDataFrame(rows, "id long, k1 string, k2 string")
    got = {tuple(x) for x in link_by_keys(df, "id", ["k1", "k2"]).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}
    single = {tuple(x) for x in link_by_keys(df, "id", ["k1"]).collect()}
    assert single == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)}


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(23)
    prints = [r.getrandbits(63) for _ in range(150)] + list(range(20)) + [(1 << 63) - 1]
    for p in prints[:60]:
        q = p
        for b in r.sample(range(63), r.randint(0, 6)):
            q ^= 1 << b
        prints.append(q)
    df = spark.createDataFrame([(p,) for p in [*prints, *prints[:5]]] + [(None,)], "fp long")
    got = {tuple(x) for x in near_pairs(df).collect()}
    d = sorted(set(prints))
    want = {(a, b, (a ^ b).bit_count()) for i, a in enumerate(d) for b in d[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert got == want
    both = {(x["fp_a"], x["fp_b"]) for x in near_pairs(df, df).collect()}
    assert both == {(a, b) for a in d for b in d if (a ^ b).bit_count() <= 4}
