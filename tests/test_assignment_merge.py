import hashlib
import random

from pyspark.sql import functions as F

from granaria.operators import assignment as A
from granaria.operators import merge, ordering


def ranked(groups, seed=42):
    out = {}
    for s in {b for _, b in groups}:
        gs = sorted((g for g, b in groups if b == s), key=lambda g: hashlib.sha256(f"{seed}:{s}:{g}".encode()).hexdigest())
        n = len(gs)
        t = min(max(round(n * 0.6), 1), n - 2) if n >= 3 else 1
        v = min(max(round(n * 0.2), 1), n - t - 1) if n >= 3 else 0
        out |= {g: "train" if i < t else "val" if i < t + v else "test" for i, g in enumerate(gs)}
    return out


def test_ranked_split_clamps_and_ignores_order(spark):
    groups = [(f"g{s}{i}", f"b{s}") for s in (1, 2, 3, 4, 7, 20) for i in range(s)]
    want = ranked(groups)
    for parts in (1, 5):
        random.Random(parts).shuffle(groups)
        df = spark.createDataFrame(groups, "g string, b string").repartition(parts)
        assert {r["g"]: r["split"] for r in A.ranked_split(df, "g", "b", 42).collect()} == want
    assert A.ranked_split(spark.createDataFrame([], "g string, b string"), "g", "b", 42).count() == 0


def test_freeze_and_extend(spark):
    rows = [(1, "g", None, "test", "l"), (2, "g", "s", None, "l"), (3, None, "s", None, "m"), (4, "h", None, "train", "l"), (5, "h", None, "val", "l"), (6, "k", None, None, "l"), (7, "k", None, None, "m"), (8, None, None, None, "l")]
    df = spark.createDataFrame(rows, "id long, g string, s string, part string, label string")
    got = {r["id"]: (r["split"], r["conflict"]) for r in A.freeze_and_extend(df, "id", ["g", "s"], "part", "label", 42).collect()}
    assert got[1] == got[2] == got[3] == ("test", False)
    assert got[4] == got[5] == (None, True)
    assert got[6] == got[7] == ("train", False)
    assert got[8] == ("train", False)


def test_reviewed_split(spark):
    rows = [(1, "g", True, "test", None), (2, "g", False, None, "train"), (3, "h", True, "val", None), (4, "h", False, None, None), (5, "k", False, None, "val"), (6, "k", False, None, "train"), (7, "m", False, None, None)]
    df = spark.createDataFrame(rows, "id long, g string, base boolean, part string, req string")
    got = {r["id"]: (r["split"], r["problem"]) for r in A.reviewed_split(df, "id", ["g"], "base", "part", "req", "g", 42).collect()}
    assert got[2] == (None, "crosses_splits")
    assert got[4] == ("val", None)
    assert got[5] == got[6] == (None, "crosses_splits")
    want = "val" if int(hashlib.sha256(b"42:m").hexdigest()[:16], 16) % 5 == 0 else "train"
    assert got[7] == (want, None)


def test_coassign_and_report(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "c", "x"), (5, "d", "x")]
    df = spark.createDataFrame(rows, "id long, grp string, label string")
    out = A.coassign(df, "id", "grp", "label", spark.createDataFrame([(2, 3), (4, 5), (4, 4)], "a long, b long"), 42)
    got = {r["id"]: (r["component"], r["split"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == (1, "train")
    assert got[4][0] == got[5][0] == 4
    rep = A.merge_report(df, out.select("id", "component"), "id", "grp", "component").first()
    assert (rep["old_groups"], rep["new_groups"], rep["merged_components"], rep["largest"], rep["split_old_groups"]) == (4, 2, 2, 3, 0)


def test_component_hash(spark):
    df = spark.createDataFrame([(1, "k", "b"), (2, "k", "a"), (3, None, "c")], "id long, k string, name string")
    got = {r["id"]: r["group_hash"] for r in A.component_ids(df, "id", ["k"], "name").collect()}
    assert got[1] == got[2] == "v2_" + hashlib.sha256(b"a\nb").hexdigest()[:32]
    assert got[3] == "v2_" + hashlib.sha256(b"c").hexdigest()[:32]


def test_group_build_links_families_and_groups(spark, tmp_path):
    """An augmented copy joins its original by file name alone, and records join by group_id alone."""
    from datetime import datetime

    from granaria.plans.curation import component_group_build, component_group_hash

    t = datetime(2026, 1, 1)
    paths = {1: ("Screen Shot 7.png", "a"), 2: ("rotated_by_15_Screen Shot 7.png", None), 3: ("other.png", "A "), 4: ("alone.png", None), 5: ("same.png", "UNKNOWN")}
    sha = {4: "f" * 64, 5: "F" * 64}
    rows = [(i, f"apple/fresh/{n}", "apple", "fresh", "s", g, sha.get(i), "train", t) for i, (n, g) in paths.items()]
    spark.createDataFrame(rows, "row_id long, path string, fruit string, status string, source string, group_id string, sha256 string, split string, loaded_at timestamp").write.parquet(f"{tmp_path}/manifest.parquet")
    quality = "path string, width long, height long, brightness double, blur_score double, pixel_sha256 string, phash63 string, load_id long, inspected_at timestamp"
    spark.createDataFrame([], quality).write.parquet(f"{tmp_path}/image_quality.parquet")
    name = lambda *ids: "v2_" + hashlib.sha256("\n".join(sorted(f"apple/fresh/{paths[i][0]}".lower() for i in ids)).encode()).hexdigest()[:32]
    for query, groups in ((component_group_hash, ((1, 2), (3,), (4, 5))), (component_group_build, ((1, 2, 3), (4, 5)))):
        got = {tuple(r) for r in query(spark, str(tmp_path)).select("row_id", "component", "group_hash").collect()}
        assert got == {(i, min(g), name(*g)) for g in groups for i in g}


def test_upsert(spark):
    f = lambda rows: spark.createDataFrame(rows, "k string, v string, split string, source string")
    out = merge.upsert(f([("a", "1", "train", None), ("b", "2", "val", "s"), (None, "0", None, None)]), f([("a", "9", "test", "t"), ("a", "9", "test", "t"), ("c", "3", "test", None), (None, "x", "y", "z")]), "k", ["v"], ["split"], ["source"])
    got = {r["k"]: (r["v"], r["split"], r["source"], r["action"]) for r in out.collect()}
    assert got == {"a": ("9", "train", "t", "updated"), "b": ("2", "val", "s", "kept"), "c": ("3", "test", None, "inserted"), None: ("0", None, None, "kept")}
    assert [r["k"] for r in merge.conflicting(f([("a", "1", "", ""), ("a", "2", "", "")]), "k", "v").collect()] == ["a"]
    new = merge.update_by_group(f([("a", "1", "train", "g"), ("b", "1", "train", None)]), spark.createDataFrame([("g", "val")], "source string, split string"), "source", "split")
    assert {r["k"]: r["split"] for r in new.collect()} == {"a": "val", "b": "train"}


def test_ordering(spark):
    df = spark.createDataFrame([("b", "x", 2), ("a", "x", 1), ("c", "y", 3), ("d", None, 4), ("e", None, 5)], "p string, k string, id int")
    got = {r["id"]: (r["kept"], r["duplicate_of"]) for r in ordering.keep_first(df, "k", ["p"], "id").collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (True, None)}
    pairs = spark.createDataFrame([(i,) for i in range(5)], "i int")
    assert {r["complete"] for r in ordering.capped(pairs, [F.col("i")], 4).collect()} == {False}
    assert {r["complete"] for r in ordering.capped(pairs, [F.col("i")], 5).collect()} == {True}
    assert ordering.capped(pairs.limit(0), [F.col("i")], 5).count() == 0


def test_early_stop(spark):
    rows = [("r", i, v, t) for i, (v, t) in enumerate([(0.5, 1.0), (0.7, 1.0), (0.7, 0.9), (0.7 + 1e-7, 2.0), (0.6, 0.1), (0.6, 0.1), (0.9, 0.1)])] + [("s", 0, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "run string, step int, v double, t double").repartition(3)
    got = {r["run"]: (r["best_step"], r["stopped_at"]) for r in ordering.early_stop(df, "run", "step", "v", "t", patience=3).collect()}
    assert got == {"r": (2, 5), "s": (0, None)}


def test_upsert_refuses_another_label(spark):
    schema = "k string, id int, fruit string, split string, source string"
    f = lambda rows: spark.createDataFrame(rows, schema)
    old = f([("a", 1, "apple", "train", None), ("b", 2, "banana", "val", "s"), ("e", 3, None, None, None)])
    new = f([("a", 9, "orange", "test", "t"), ("b", 8, "banana", "test", "t"), ("c", 7, "apple", "test", "x"), ("c", 6, "tomato", "val", "y"), ("d", 5, "apple", None, "z"), ("d", 4, "apple", "val", None), ("e", 2, "apple", "val", None)])
    out = merge.upsert(old, new, "k", ["fruit"], ["split"], ["source"], guard=["fruit"], order=["id"])
    got = {r["k"]: (r["fruit"], r["split"], r["source"], r["action"]) for r in out.collect()}
    # a keeps its label, c is not inserted, d takes its first row as a whole, e had no label
    assert got == {"a": ("apple", "train", None, "conflict"), "b": ("banana", "val", "s", "updated"), "d": ("apple", "val", None, "inserted"), "e": ("apple", None, None, "updated")}
    found = {(r["k"], r["column_name"], r["existing"], r["least"], r["greatest"]) for r in merge.conflicts(old, new, "k", ["fruit"]).collect()}
    assert found == {("a", "fruit", "apple", "orange", "orange"), ("c", "fruit", None, "apple", "tomato")}
    assert merge.conflicts(old, new.limit(0), "k", ["fruit"]).count() == 0


def test_record_key(spark):
    rows = [("s", "u", "p"), ("", "u", "p"), (None, None, "p"), ("", "", None)]
    df = spark.createDataFrame(rows, "s string, u string, p string")
    assert [r[0] for r in df.select(merge.record_key(F.col("s"), F.col("u"), F.col("p"))).collect()] == ["sha256:s", "url:u", "path:p", None]


def test_salted_ranks(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, c string").repartition(5)
    order = F.sha2(F.col("i").cast("string"), 256)
    got = {r["i"]: (r["_rank"], r["_n"]) for r in ordering.ranked(df, ["c"], order, "i").collect()}
    for c in ("hot", None):
        mine = sorted((i for i, k in rows if k == c), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
        assert all(got[i] == (n + 1, len(mine)) for n, i in enumerate(mine))
    assert ordering.ranked(df.limit(0), ["c"], order, "i").count() == 0


def test_older_freeze(spark):
    rows = [(1, "g", "s", "test"), (2, "h", "s", None), (3, "k", None, None), (4, "m", "t", "train"), (5, "n", "t", "val")]
    out = A.freeze_groups(spark.createDataFrame(rows, "id long, g string, s string, part string"), "id", "g", "s", "part")
    assert {r["id"]: (r["split"], r["conflict"]) for r in out.collect()} == {1: ("test", False), 2: ("test", False), 3: ("train", False), 4: (None, True), 5: (None, True)}
