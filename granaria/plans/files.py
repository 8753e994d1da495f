"""Queries of the scans and sinks: tables written as files, locked, and read again by the strict scans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.functions.text import identity
from granaria.operators import rules
from granaria.plans.common import PRED, REC, ident, predictions, rec
from granaria.plans.curation_sql import ranked
from granaria.session import Workspace, table
from granaria.sources import scans, sinks


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest records that break no rule, with the columns of a manifest file."""
    r = rec(spark, sf).select("path", "fruit", "status", "source", F.col("grp").alias("group_id"), F.col("sha").alias("sha256"), F.col("part").alias("split"))
    return r.where(F.size(rules.codes(rules.manifest_rules())) == 0)


def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Valid records written as CSV and scanned with all checks."""
    ws = Workspace(spark, "manifest-scan")
    sinks.write_csv(_valid(spark, sf), ws.path("manifest"), list(scans.MANIFEST))
    return scans.scan_manifest(spark, ws.path("manifest")).select("path", "fruit", "status", "split", "sha256")


def numbered_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals of the scanned manifest in path order: each from 0 once, and the order kept."""
    ws = Workspace(spark, "numbered")
    sinks.write_csv(_valid(spark, sf), ws.path("manifest"), list(scans.MANIFEST))
    rows = scans.with_ordinal(scans.scan_manifest(spark, ws.path("manifest")))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("manifest_index").alias("ordinals"), F.min("manifest_index").alias("first"), F.max("manifest_index").alias("last"), F.min_by("path", "manifest_index").alias("first_path"))


def locked_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A locked dataset: files named by digest and counts by label, both checked before the rows are used."""
    ws = Workspace(spark, "locked")
    rows = _valid(spark, sf)
    sinks.write_csv(rows, ws.path("manifest.csv"), list(scans.MANIFEST))
    files = scans.file_digests(spark, [ws.path("manifest.csv")]).collect()  # a row for each written file
    counts = rows.groupBy("split", "fruit", "status").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each label and split
    lock = {"files": {f"manifest.csv/{r['file']}": r["sha256"] for r in files if not r["file"].startswith("_")}, "counts": [r.asDict() for r in counts]}
    spark.createDataFrame([(json.dumps(lock),)], "value string").coalesce(1).write.text(ws.path("dataset_lock.json"))
    return scans.scan_locked(spark, ws.root).groupBy("split", "fruit", "status").agg(F.count(F.lit(1)).alias("n"))


def snapshot_lock(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the tables of a snapshot by its lock, and whether the tables still agree with it."""
    ws = Workspace(spark, "snapshot")
    tables = {"manifest": table(spark, sf, "manifest"), "image_quality": table(spark, sf, "image_quality")}
    counts = sinks.snapshot(tables, ws.path("v1"))
    changed = sinks.verify_snapshot(spark, ws.path("v1"), list(tables)).count()
    return spark.createDataFrame([(k, n, changed == 0) for k, n in counts.items()], "table string, rows long, unchanged boolean")


def count_report(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a count report that differ from the recount: the report counts deliveries, the recount records."""
    keys = ["fruit", "status", "split"]
    part = identity(F.col("split")).alias("split")
    reported = table(spark, sf, "manifest").select("fruit", "status", part).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = rec(spark, sf).select("fruit", "status", F.col("part").alias("split")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fill = lambda df: df.withColumn("split", F.coalesce("split", F.lit("")))
    return rules.compare_counts(fill(found), fill(reported), keys)


def lock_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Declared digests against measured ones as two file inventories, by problem."""
    want = rec(spark, sf).where("sha is not null").groupBy(F.col("path").alias("file")).agg(F.min("sha").alias("sha256"))
    have = table(spark, sf, "image_quality").select(F.col("path").alias("file"), identity(F.col("actual_sha256")).alias("sha256")).where("sha256 is not null").groupBy("file").agg(F.min("sha256").alias("sha256"))
    return rules.compare_locks(want, have).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def file_states(spark: SparkSession, sf: str) -> DataFrame:
    """Camera records by the three-way state of their digest: the measured one against the expected and the pixels'."""
    c = table(spark, sf, "camera_manifest").drop("received_at").distinct()
    state = rules.file_state(identity(F.col("sha256")), identity(F.col("expected_sha256")), identity(F.col("pixel_sha256")))
    return c.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def verified_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records against the digests of their files, by state."""
    files = table(spark, sf, "image_quality").select("path", identity(F.col("actual_sha256")).alias("s")).groupBy("path").agg(F.min("s").alias("sha256"))
    return scans.verified(rec(spark, sf).select("path", F.col("sha").alias("sha256")), files).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def discovered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Measured files joined with declared camera and manifest paths without case: how many are found, declared or both."""
    found = table(spark, sf, "image_quality").select("path").distinct()
    declared = table(spark, sf, "manifest").select("path", "fruit").distinct()
    return scans.discover(found, declared).groupBy("found", "declared").agg(F.count(F.lit(1)).alias("n"))


def grouped_files(spark: SparkSession, sf: str) -> DataFrame:
    """Group and source of measured files from the manifest as side table, the file stem where it has none."""
    files = table(spark, sf, "image_quality").select("path").distinct()
    side = rec(spark, sf).groupBy(F.col("path").alias("relative_path")).agg(F.min("grp").alias("group_id"), F.min("source").alias("source"))
    return scans.with_groups(files, side)


def rooted_files(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).select("row_id", "path", F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd").alias("root_id"))
    return scans.resolve_roots(r, {"even": "/data/a", "odd": "/data/b"}).select("row_id", "full_path")


def collection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest records kept as a collection of JSON lines, those of one split and fruit read back."""
    ws = Workspace(spark, "collection")
    rows = rec(spark, sf).select(F.col("row_id").alias("_id"), "path", "fruit", "status", F.col("part").alias("split"))
    sinks.write_json(rows, ws.path("images"))
    return scans.scan_collection(spark, ws.path("images"), "_id long, path string, fruit string, status string, split string", split="val", fruit="apple")


def vector_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors read with their checks, by label."""
    return scans.scan_vectors(spark, f"{sf}/embeddings.parquet", "embedding", 64).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def predictions_written(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and the wrong ones among them, written by one evaluation and counted as read back."""
    ws = Workspace(spark, "predictions")
    rows = predictions(spark, sf).where("known").select("vec_id", "true_joint", "joint_class", "joint_confidence")
    sinks.write_predictions(rows, ws.root, ["vec_id", "true_joint", "joint_class", "joint_confidence"])
    back = [scans.scan_csv(spark, ws.path(n), ["vec_id", "true_joint"], "vec_id").select(F.lit(n).alias("file"), "true_joint") for n in ("predictions", "errors")]
    return back[0].unionByName(back[1]).groupBy("file", "true_joint").agg(F.count(F.lit(1)).alias("n"))


def export_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The collection exported as a manifest: groups keep the one split they had, the others are ranked, and read back."""
    ws = Workspace(spark, "export")
    r = rec(spark, sf).where("grp is not null").select("path", "fruit", "status", F.coalesce("source", F.lit("")).alias("source"), F.col("grp").alias("group_id"), F.coalesce("sha", F.lit("")).alias("sha256"), F.col("part").alias("split"))
    had = r.where(F.col("split").isin("train", "val", "test")).groupBy("group_id").agg(F.min("split").alias("split"), F.max("split").alias("other")).where("split = other").select("group_id", "split")
    sinks.export_manifest(r.drop("split"), had, ws.path("manifest"))
    return scans.scan_csv(spark, ws.path("manifest"), scans.MANIFEST).select("group_id", "split").distinct()


QUERIES = {
    f.__name__: f
    for f in (manifest_scan, numbered_scan, locked_scan, snapshot_lock, count_report, lock_compare, file_states, verified_files, discovered_files, grouped_files, rooted_files, collection_scan, vector_scan, predictions_written, export_splits)
}

_SLASHED = "replace(trim(path), '\\\\', '/')"
_VALID = f"""valid AS (SELECT * FROM rec WHERE coalesce(trim(source), '') <> '' AND grp IS NOT NULL AND coalesce(trim(path), '') <> '' AND regexp_full_match(coalesce(sha, ''), '[0-9a-f]{{64}}') AND part IN ('train', 'val', 'test')
  AND fruit IN ('apple', 'banana', 'orange', 'tomato') AND status IN ('fresh', 'rotten') AND NOT starts_with({_SLASHED}, '/') AND NOT contains(path, ':') AND NOT contains(path, chr(0)) AND NOT list_contains(string_split({_SLASHED}, '/'), '..'))"""
_STEM = r"regexp_replace(string_split(replace(path, '\\', '/'), '/')[-1], '(.)\.[^.]*$', '\1')"

SQL = {
    "manifest_scan": f"WITH {REC}, {_VALID} SELECT {_SLASHED} AS path, fruit, status, part AS split, sha AS sha256 FROM valid",
    "numbered_scan": f"WITH {REC}, {_VALID} SELECT count(*) AS rows, count(*) AS ordinals, 0 AS first, count(*) - 1 AS last, arg_min({_SLASHED}, (path_k, path)) AS first_path FROM valid",
    "locked_scan": f"WITH {REC}, {_VALID} SELECT part AS split, fruit, status, count(*) AS n FROM valid GROUP BY ALL",
    "snapshot_lock": "SELECT 'manifest' AS \"table\", count(*) AS rows, true AS unchanged FROM manifest UNION ALL SELECT 'image_quality', count(*), true FROM image_quality",
    "count_report": f"""WITH {REC}, f AS (SELECT fruit, status, coalesce(part, '') AS split, count(*) AS n FROM rec GROUP BY ALL), r AS (SELECT fruit, status, coalesce({ident("split")}, '') AS split, count(*) AS n FROM manifest GROUP BY ALL)
SELECT fruit, status, split, coalesce(f.n, 0) AS found, coalesce(r.n, 0) AS reported FROM f FULL JOIN r USING (fruit, status, split) WHERE coalesce(f.n, 0) <> coalesce(r.n, 0)""",
    "lock_compare": f"""WITH {REC}, w AS (SELECT path, min(sha) AS a FROM rec WHERE sha IS NOT NULL GROUP BY path), h AS (SELECT path, min({ident("actual_sha256")}) AS b FROM image_quality GROUP BY path HAVING min({ident("actual_sha256")}) IS NOT NULL)
SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' ELSE 'changed' END AS problem, count(*) AS n FROM w FULL JOIN h USING (path) WHERE a IS DISTINCT FROM b GROUP BY ALL""",
    "file_states": f"""SELECT CASE WHEN {ident("sha256")} IS NOT DISTINCT FROM {ident("pixel_sha256")} THEN 'new' WHEN {ident("sha256")} IS NOT DISTINCT FROM {ident("expected_sha256")} THEN 'base' ELSE 'conflict' END AS state, count(*) AS n
FROM (SELECT DISTINCT * EXCLUDE (received_at) FROM camera_manifest) GROUP BY ALL""",
    "verified_files": f"""WITH {REC}, f AS (SELECT path, min({ident("actual_sha256")}) AS b FROM image_quality GROUP BY path) SELECT CASE WHEN b IS NULL THEN 'missing' WHEN b = sha THEN 'match' ELSE 'mismatch' END AS state, count(*) AS n FROM rec LEFT JOIN f USING (path) GROUP BY ALL""",
    "discovered_files": f"""WITH f AS (SELECT DISTINCT path, lower(replace(path, '\\', '/')) AS k FROM image_quality), d AS (SELECT DISTINCT path, fruit, lower(replace(path, '\\', '/')) AS k FROM manifest)
SELECT f.path IS NOT NULL AS found, d.path IS NOT NULL AS declared, count(*) AS n FROM f FULL JOIN d ON f.k = d.k GROUP BY ALL""",
    "grouped_files": f"""WITH {REC}, s AS (SELECT path, lower(replace(path, '\\', '/')) AS k, min(grp) AS g, min(source) AS src FROM rec GROUP BY path), f AS (SELECT DISTINCT path, lower(replace(path, '\\', '/')) AS k FROM image_quality)
SELECT f.path AS path, coalesce(nullif(s.g, ''), {_STEM.replace("path", "f.path")}) AS group_id, coalesce(nullif(s.src, ''), 'unknown') AS source FROM f LEFT JOIN s ON s.k = f.k""",
    "rooted_files": f"WITH {REC} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN '/data/a/' ELSE '/data/b/' END || path AS full_path FROM rec",
    "collection_scan": f"WITH {REC} SELECT path, fruit, status, part AS split FROM rec WHERE part = 'val' AND fruit = 'apple'",
    "vector_scan": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "predictions_written": f"""WITH {PRED} SELECT 'predictions' AS file, true_joint, count(*) AS n FROM rows_ WHERE known GROUP BY ALL UNION ALL SELECT 'errors', true_joint, count(*) FROM rows_ WHERE known AND true_joint <> joint_class GROUP BY ALL""",
    "export_splits": f"""WITH {REC}, had AS (SELECT grp, min(part) AS s FROM rec WHERE grp IS NOT NULL AND part IN ('train', 'val', 'test') GROUP BY grp HAVING min(part) = max(part)),
groups_ AS (SELECT grp, array_to_string(list_sort(list(DISTINCT fruit || '::' || status)), '|') AS stratum FROM rec WHERE grp IS NOT NULL AND grp NOT IN (SELECT grp FROM had) GROUP BY grp), {ranked("groups_")}
SELECT grp AS group_id, s AS split FROM had UNION ALL SELECT grp, split FROM rk""",
}
