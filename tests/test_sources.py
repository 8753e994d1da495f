import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granaria.operators.rules import RuleError
from granaria.sources import scans, sinks
from granaria.streaming import events as ev

SHA = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4)]
HEAD = "path,fruit,status,source,group_id,sha256,split"
ROWS = [f"apple\\fresh\\1.jpg, apple ,fresh,s,g1,{SHA[0]},train", f"apple/fresh/2.jpg,apple,fresh,s,g2,{SHA[1]},val"]


def write(tmp_path, name, lines, bom=True):
    p = tmp_path / name
    p.write_bytes(("﻿" if bom else "").encode() + "\n".join(lines).encode() + b"\n")
    return str(p)


def test_csv_scan(spark, tmp_path):
    p = write(tmp_path, "m.csv", [HEAD + ",extra", *[r + ",x" for r in ROWS]])
    rows = scans.scan_manifest(spark, p)
    assert [r["path"] for r in rows.collect()] == ["apple/fresh/1.jpg", "apple/fresh/2.jpg"]
    assert rows.first()["fruit"] == "apple"
    assert "extra" in rows.columns


@pytest.mark.parametrize(
    ("lines", "error"),
    [
        (["path,fruit", "a,b"], scans.ScanError),
        ([HEAD + ",path", ROWS[0] + ",x"], scans.ScanError),
        ([HEAD, ROWS[0] + ",too,many"], Exception),
        ([HEAD, ROWS[0].replace(SHA[0], "xyz")], RuleError),
        ([HEAD, ROWS[0], ROWS[0].upper().replace(SHA[0].upper(), SHA[2]).replace("APPLE ,FRESH", "apple,fresh").replace("TRAIN", "train")], RuleError),
        ([HEAD], scans.ScanError),
    ],
)
def test_csv_scan_fails(spark, tmp_path, lines, error):
    with pytest.raises(error):
        scans.scan_manifest(spark, write(tmp_path, "m.csv", lines)).collect()


def test_locked_scan_detects_tampering(spark, tmp_path):
    p = write(tmp_path, "manifest.csv", [HEAD, *ROWS])
    lock = {"files": {"manifest.csv": hashlib.sha256(open(p, "rb").read()).hexdigest()}, "counts": [{"split": s, "fruit": "apple", "status": "fresh", "n": 1} for s in ("train", "val")]}
    (tmp_path / "dataset_lock.json").write_text(json.dumps(lock))
    assert scans.scan_locked(spark, str(tmp_path)).count() == 2
    lock["counts"][0]["n"] = 2
    (tmp_path / "dataset_lock.json").write_text(json.dumps(lock))
    with pytest.raises(RuleError, match="counts"):
        scans.scan_locked(spark, str(tmp_path))
    write(tmp_path, "manifest.csv", [HEAD, ROWS[0]])
    with pytest.raises(RuleError, match="locked file changed"):
        scans.scan_locked(spark, str(tmp_path))


def test_split_selection_checks_all_rows(spark, tmp_path):
    rows = scans.scan_csv(spark, write(tmp_path, "m.csv", [HEAD, *ROWS]), scans.MANIFEST)
    assert scans.select_split(rows, "val").count() == 1
    with pytest.raises(RuleError, match="group_id"):
        scans.select_split(rows.withColumn("group_id", F.lit("g")), "val")


def test_images(spark, tmp_path):
    for d, names in (("apple/fresh", ["1.JPG", "2.png"]), ("misc", ["3.jpg", "notes.txt"])):
        (tmp_path / d).mkdir(parents=True)
        for n in names:
            (tmp_path / d / n).write_bytes(n[:1].encode() if n != "3.jpg" else b"1")
    found = scans.scan_images(spark, str(tmp_path))
    got = {r["path"]: (r["fruit"], r["sha256"]) for r in found.collect()}
    assert set(got) == {"apple/fresh/1.JPG", "apple/fresh/2.png", "misc/3.jpg"}
    assert got["misc/3.jpg"][0] is None
    assert got["apple/fresh/1.JPG"] == ("apple", hashlib.sha256(b"1").hexdigest())
    assert {r["path"] for r in scans.distinct_images(found).collect()} == {"apple/fresh/1.JPG", "apple/fresh/2.png"}
    declared = spark.createDataFrame([("APPLE\\fresh\\1.jpg", "cam"), ("gone.jpg", "web")], "path string, source string")
    d = {r["path"]: (r["found"], r["declared"], r["source"]) for r in scans.discover(found, declared).collect()}
    assert d["apple/fresh/1.JPG"] == (True, True, "cam")
    assert d["gone.jpg"] == (False, True, "web")
    assert d["misc/3.jpg"] == (True, False, None)
    with pytest.raises(RuleError):
        scans.require_classes(found.where("fruit is not null"), 1)
    groups = spark.createDataFrame([("apple/fresh/1.jpg", "g", None)], "relative_path string, group_id string, source string")
    g = {r["path"]: (r["group_id"], r["source"]) for r in scans.with_groups(found.select("path"), groups).collect()}
    assert g["apple/fresh/1.JPG"] == ("g", "unknown")
    assert g["apple/fresh/2.png"] == ("2", "unknown")
    state = scans.verified(spark.createDataFrame([("misc/3.jpg", hashlib.sha256(b"1").hexdigest()), ("misc/4.jpg", "x"), ("apple/fresh/2.png", "x")], "path string, sha256 string"), found)
    assert dict(state.collect()) == {"misc/3.jpg": "match", "misc/4.jpg": "missing", "apple/fresh/2.png": "mismatch"}


def test_roots_and_config(spark):
    df = spark.createDataFrame([("r", "a.jpg")], "root_id string, path string")
    assert scans.resolve_roots(df, {"r": "/data"}).first()["full_path"] == "/data/a.jpg"
    with pytest.raises(Exception, match="unknown root"):
        scans.resolve_roots(df, {"q": "/data"}).collect()
    kinds = {"min_size": int, "blur": float}
    assert scans.load_config('{"min_size": 3, "blur": 2}', kinds) == {"min_size": 3, "blur": 2}
    for bad in ('{"min_size": 3}', '{"min_size": true, "blur": 1}', '{"min_size": 3, "blur": NaN}', '{"min_size": "3", "blur": 1}', "[]"):
        with pytest.raises(scans.ScanError):
            scans.load_config(bad, kinds)


def test_inventory_pages(spark, tmp_path):
    for i, ids in enumerate((["v/a.jpg", "v/b.jpg"], ["v/c.png"], [])):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"resources": [{"public_id": x, "bytes": 1} for x in ids]}))
    assert {r["sha256"] for r in scans.scan_inventory(spark, str(tmp_path), 3).collect()} == {"a", "b", "c"}
    (tmp_path / "page-2.json").write_text(json.dumps({"resources": [{"public_id": "w/a.jpg", "bytes": 1}]}))
    with pytest.raises(RuleError):
        scans.scan_inventory(spark, str(tmp_path), 3)


def test_collection_and_vectors(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_id": 1, "sha256": "a", "split": "train", "fruit": "apple"}\n{"_id": 2, "sha256": "b", "split": "val", "fruit": "apple"}\n')
    rows = scans.scan_collection(spark, str(tmp_path / "c.json"), "_id int, sha256 string, split string, fruit string", split="val")
    assert rows.columns == ["sha256", "split", "fruit"]
    assert rows.count() == 1
    spark.createDataFrame([(1, [1.0, float("nan")])], "id int, v array<double>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(RuleError):
        scans.scan_vectors(spark, str(tmp_path / "v"), "v", 2)
    assert scans.read_or_none(spark, str(tmp_path / "missing.csv")) is None
    numbered = scans.with_ordinal(spark.range(10).repartition(3))
    assert sorted(r["manifest_index"] for r in numbered.collect()) == list(range(10))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x, \"y\"", 1.5), (None, "", 2.0)], "k string, v string, n double")
    sinks.write_csv(rows, str(tmp_path / "csv"), ["v", "k"], single=True)
    back = scans.scan_csv(spark, str(tmp_path / "csv"), ["v", "k"], "v")
    assert sorted(map(tuple, back.collect())) == [("", ""), ('x, "y"', "a")]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(rows, str(tmp_path / "csv"), ["v"])
    sinks.write_json(rows, str(tmp_path / "json"))
    with pytest.raises(RuleError):
        sinks.write_json(rows.withColumn("n", F.lit(float("nan"))), str(tmp_path / "bad"))
    with pytest.raises(scans.ScanError):
        sinks.check_new_output("/a/b", ["/a"])
    sinks.check_new_output("/a", ["/ab"])


def test_snapshot_lock(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, s string")
    assert sinks.snapshot({"m": rows, "e": rows.limit(0)}, str(tmp_path / "v1")) == {"m": 3, "e": 0}
    assert sinks.verify_snapshot(spark, str(tmp_path / "v1"), ["m", "e"]).count() == 0
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "v1" / "m"))
    assert sinks.verify_snapshot(spark, str(tmp_path / "v1"), ["m", "e"]).first()["table"] == "m"


def test_bundle_export_ingest(spark, tmp_path):
    preds = spark.createDataFrame([("1", "a", "a"), ("2", "a", "b")], "path string, true_joint string, joint_class string")
    sinks.write_bundle(spark.createDataFrame([(1.0,)], "accuracy double"), preds, preds.select("path"), str(tmp_path / "b"), ["path", "joint_class"])
    assert spark.read.option("header", True).csv(str(tmp_path / "b" / "errors")).count() == 1
    col = spark.createDataFrame([(f"{i}.jpg", "apple", "fresh", "s", f"g{i}", SHA[i], None) for i in range(4)], "path string, fruit string, status string, source string, group_id string, sha256 string, split string")
    earlier = spark.createDataFrame([("g0", "test")], "group_id string, split string")
    out = sinks.export_manifest(col.drop("split"), earlier, str(tmp_path / "m"))
    got = {r["group_id"]: r["split"] for r in out.collect()}
    assert got["g0"] == "test"
    assert sorted(got[g] for g in ("g1", "g2", "g3")) == ["test", "train", "val"]
    with pytest.raises(RuleError, match="rejected"):
        sinks.ingest(col.withColumn("fruit", F.when(F.col("path") == "1.jpg", "kiwi").otherwise(F.col("fruit"))), col.limit(0), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 3


def test_streams(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ev.windowed_counts(ev.event_stream(spark, str(tmp_path / "in"), table), "1 hour", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["start"], r["event_type"]): r["n"] for r in ev.windowed_counts(table, "1 hour").collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("win").collect()} == want
    s = ev.sessions(table).agg(F.sum("n")).first()[0]
    assert s == table.count()
    man = spark.read.parquet(f"{sf}/manifest.parquet").drop("loaded_at")
    man.write.parquet(str(tmp_path / "man"))
    a = ev.admit_stream(ev.event_stream(spark, str(tmp_path / "man"), man), str(tmp_path / "out"), str(tmp_path / "cp"))
    a.awaitTermination()
    good = spark.read.parquet(str(tmp_path / "out" / "rows")).select("path").distinct().count()
    bad = spark.read.parquet(str(tmp_path / "out" / "problems")).select("path").distinct().count()
    assert good + bad == man.select("path").distinct().count()


def test_admission_judges_rows_by_themselves(spark, tmp_path):
    """A null path is rejected and not loaded; a valid row beside a broken one of its path is loaded."""
    row = lambda path, fruit, sha: (path, fruit, "fresh", "s", "g", sha, "train")
    rows = [row(None, "apple", SHA[0]), row("a.jpg", "apple", SHA[1]), row("a.jpg", "kiwi", SHA[2])]
    schema = "path string, fruit string, status string, source string, group_id string, sha256 string, split string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    ev.admit_stream(ev.event_stream(spark, str(tmp_path / "in"), df, 10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["sha256"] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()] == [SHA[1]]
    codes = {r["code"] for r in spark.read.parquet(str(tmp_path / "out" / "problems")).collect()}
    assert {"missing:path", "unsupported_label"} <= codes
    with pytest.raises(RuleError, match="rejected"):
        sinks.ingest(df, df.limit(0), str(tmp_path / "c"))
    assert [r["sha256"] for r in spark.read.json(str(tmp_path / "c")).collect()] == [SHA[1]]
    other = spark.createDataFrame([row("a.jpg", "banana", SHA[1])], schema)
    with pytest.raises(RuleError, match="labels differ"):
        sinks.ingest(other, df.where("fruit = 'apple' and path is not null"), str(tmp_path / "d"))
    assert [r["fruit"] for r in spark.read.json(str(tmp_path / "d")).collect()] == ["apple"]


def test_a_local_folder_is_refused_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from granaria import session

    def fake(master, folder=None):
        conf = SimpleNamespace(get=lambda *a: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf))

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(fake("spark://host:7077"))
    assert session.shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert "granaria-" in session.shared_dir(fake("local[3]"))


def test_ordinals_keep_the_order(spark):
    rows = spark.range(1000).repartition(7).orderBy("id")
    assert all(r["id"] == r["n"] for r in scans.with_ordinal(rows, "n").collect())
    assert scans.with_ordinal(rows.limit(0)).count() == 0


def test_workspaces(spark):
    import os

    from granaria.session import Workspace, clear_workspaces, shared_dir

    ws = Workspace(spark, "t")
    assert ws.save(spark.range(3), "a").count() == 3
    assert ws.save(spark.range(0), "b").count() == 0
    ws.drop("a")
    assert not os.path.exists(ws.path("a"))
    clear_workspaces(spark)
    assert not os.path.exists(f"{shared_dir(spark)}/granaria")
