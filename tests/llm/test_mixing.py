import pytest

from granaria.llm.mixing import budgets, fill, largest_total, mix_sources, pieces

DOMAINS = {"one": ("a", "b"), "two": ("c", "d")}


def test_fill_and_budgets():
    assert fill(100, {"x": 1, "y": 1}, {"x": 10, "y": 1000}) == {"x": 10, "y": 90}
    leaves = {("one", "en", "a"): (0.25, 10.0), ("one", "en", "b"): (0.25, 500.0), ("two", "en", "c"): (0.5, 500.0)}
    got = budgets(leaves, 100)
    # what a lacks goes to its sibling b, not to the other domain
    assert got == pytest.approx({("one", "en", "a"): 10, ("one", "en", "b"): 40, ("two", "en", "c"): 50})
    leaves[("one", "en", "b")] = (0.25, 20.0)
    assert budgets(leaves, 100)[("two", "en", "c")] == pytest.approx(70)
    assert largest_total({("one", "en", "a"): (0.5, 10.0), ("two", "en", "c"): (0.5, 500.0), ("two", "en", "d"): (0.2, 0.0)}) == pytest.approx(24)
    assert largest_total({}) == 0.0


def test_pieces():
    t = "ab  cd\n ef" * 50
    assert "".join(pieces(t, 7)) == t
    assert "".join(pieces("x" * 100, 7)) == "x" * 100


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 0.0) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, tokens int, rest double")


def test_mix(spark):
    rows = [("word " * 10, "en", "A"), *[("word " * 10, "EN", " a") for _ in range(9)], *[("word " * 10, "vi", "b") for _ in range(400)], *[("word " * 10, None, "c-1") for _ in range(300)], (None, "en", "a"), ("", "en", "b"), ("x", "en", None), ("x", "en", "other")]
    targets = spark.createDataFrame([("a", 0.2, 3), ("b", 0.3, 1), ("c_1", 0.4, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix, shares = mix_sources(docs(spark, rows), targets, domains={"one": ("a", "b"), "two": ("c_1", "gone")})
    got = {r["source"]: r for r in shares.collect()}
    assert got["gone"]["share"] == 0
    assert got["a"]["share"] == pytest.approx(0.2, abs=0.02)
    assert got["b"]["share"] == pytest.approx(0.3, abs=0.02)
    assert got["c_1"]["share"] == pytest.approx(0.5, abs=0.02)
    assert got["a"]["most_uses"] == 3
    uses = {r["doc_id"]: r["uses"] for r in mix.collect()}
    assert len(uses) == mix.count()
    assert sum(r["share"] for r in got.values()) == pytest.approx(1)
    again, _ = mix_sources(docs(spark, rows).repartition(7), targets, domains={"one": ("a", "b"), "two": ("c_1", "gone")})
    assert {r["doc_id"]: r["uses"] for r in again.collect()} == uses
    big, s2 = mix_sources(docs(spark, rows), targets, budget=1e6, domains={"one": ("a", "b"), "two": ("c_1", "gone")})
    assert {r["source"]: r["most_uses"] for r in s2.collect()} == {"a": 3, "b": 1, "c_1": 2, "gone": 0}


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mix_sources(docs(spark, []).limit(0), t)
    assert mix.count() == 0
    assert shares.first()["share"] == 0
    mix, shares = mix_sources(docs(spark, [("x y", "en", "a")]), t.limit(0))
    assert mix.count() == shares.count() == 0
