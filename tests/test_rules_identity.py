import pytest
from pyspark.sql import functions as F

from granaria.operators import identity as I  # noqa: E741
from granaria.operators import rules

MAN = "row_id long, path string, fruit string, status string, source string, group_id string, sha256 string, split string, quality_label string, loaded_at string, key string, n int"


def manifest(spark, rows):
    return spark.createDataFrame([(i, *r, None, "t", "clash", 0) for i, r in enumerate(rows)], MAN)


def test_manifest_rules(spark):
    sha = "b" * 64
    rows = [
        ("a/1.jpg", "apple", "fresh", "s", "g", sha, "train"),
        ("../1.jpg", "kiwi", "fresh", None, "", "xyz", "later"),
        (None, None, None, None, None, None, None),
    ]
    found = rules.violations(manifest(spark, rows), rules.manifest_rules(), "row_id")
    got = {}
    for r in found.collect():
        got.setdefault(r["row_id"], set()).add(r["code"])
    assert 0 not in got
    assert got[1] == {"missing:source", "missing:group_id", "unsafe_path", "unsupported_label", "invalid_split", "invalid_sha256"}
    assert {"missing:path", "missing:split", "unsafe_path", "invalid_sha256"} <= got[2]
    assert {r["code"] for r in rules.counts_by_code(found).collect()} >= {"missing", "unsafe_path"}
    with pytest.raises(rules.RuleError):
        rules.require(found, "bad")
    rules.require(found.where("false"), "bad")


def test_identity_worked_cases(spark):
    rows = [("A.png", "apple", "fresh", "s", "g1", "a" * 64, "train"), ("a.png", "apple", "rotten", "s", "g1", "A" * 64 + " ", "TEST"), ("b.png", "apple", "fresh", "s", "UNKNOWN", "", ""), ("c.png", "apple", "fresh", "s", "unknown", None, None)]
    r = I.records(manifest(spark, [*rows, rows[0]]))
    dup = {x["key_name"]: (x["keys"], x["extra_records"]) for x in I.duplicate_summary(I.records(manifest(spark, rows))).collect()}
    assert dup == {"path": (1, 1), "sha256": (1, 1)}
    cross = {x["key_name"]: x["splits"] for x in I.cross_split(I.records(manifest(spark, rows))).collect()}
    assert cross == {"path": ["test", "train"], "sha256": ["test", "train"], "group_id": ["test", "train"]}
    assert I.label_conflicts(r).first()["labels"] == ["apple::fresh", "apple::rotten"]
    empty = I.records(manifest(spark, []))
    assert I.duplicate_summary(empty).count() == I.cross_split(empty).count() == I.leakage_summary(empty).count() == 0


def test_content_matches_exclude_self(spark):
    own = spark.createDataFrame([("c:1", "x"), ("c:2", "x"), ("c:3", "y"), ("c:4", None)], "ref string, sha string")
    others = own.unionByName(spark.createDataFrame([("b:9", "y"), ("b:9", "y")], "ref string, sha string"))
    got = {r["ref"]: (r["matches"], r["first_match"]) for r in I.content_matches(own, others, {"sha": "SHA256"}).collect()}
    assert got == {"c:1": (1, "c:2"), "c:2": (1, "c:1"), "c:3": (1, "b:9")}


def test_reconcile_and_inherit(spark):
    f = lambda rows: spark.createDataFrame(rows, "sha string, fruit string")
    got = dict(I.reconcile(f([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "x")]), f([("a", "x"), ("b", "y"), ("c", "x")]), f([("a", "x"), ("d", "x"), ("d", "x")]), "sha", ["fruit"]).collect())
    assert got == {"a": "complete", "b": "conflict", "c": "record_only", "d": "asset_only", "e": "absent"}
    rows = spark.createDataFrame([(1, "g"), (2, "h"), (3, None)], "id int, grp string")
    earlier = spark.createDataFrame([("g", "val"), ("h", "val"), ("h", "test"), (None, "val")], "grp string, split string")
    assert {r["id"]: (r["inherited"], r["conflict"]) for r in I.inherit(rows, earlier, "grp", "split").collect()} == {1: ("val", False), 2: (None, True), 3: (None, False)}


def test_table_compares(spark):
    a = spark.createDataFrame([("f", "1"), ("g", "2")], "file string, sha256 string")
    b = spark.createDataFrame([("g", "3"), ("h", "1")], "file string, sha256 string")
    assert {tuple(r) for r in rules.compare_locks(a, b).collect()} == {("f", "missing"), ("g", "changed"), ("h", "extra")}
    assert {tuple(r) for r in rules.differing(a, b, ["file"], ["sha256"]).collect()} == {("f", "*"), ("g", "sha256"), ("h", "*")}
    assert I.same_set(a, a).count() == 0
    assert I.same_set(a, a.unionByName(a.limit(1))).count() == 1
    s = spark.createDataFrame([("n", "n", "n"), ("b", "b", "n"), ("x", "b", "n")], "now string, base string, new string")
    assert [r[0] for r in s.select(rules.file_state(F.col("now"), F.col("base"), F.col("new"))).collect()] == ["new", "base", "conflict"]
    counts = lambda rows: spark.createDataFrame(rows, "k string, n long")
    assert {tuple(r) for r in rules.compare_counts(counts([("a", 1), ("b", 2)]), counts([("a", 1), ("c", 3)]), ["k"]).collect()} == {("b", 2, 0), ("c", 0, 3)}
    cover = lambda xs: rules.covers_once(spark.createDataFrame([(x,) for x in xs], "i long"), "i").first()["complete"]
    assert cover([0, 2, 1]) is True
    assert cover([0, 2, 2]) is False
    assert cover([]) is True
