"""Sinks: tables with fixed columns, single-file exports, snapshots with a lock, several outputs of one plan.

Atomicity comes from Spark's commit protocol: a folder without ``_SUCCESS`` is no output. Existing outputs are refused
unless stated. An empty table writes its header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granaria.operators.rules import require
from granaria.sources.scans import ScanError


def write_csv(rows: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """CSV with header in fixed column order; extra columns are left out. ``single`` writes one file, for exports of
    bounded size (a report, a manifest for people)."""
    out = rows.select(*[F.col(c).cast("string") for c in columns])
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines without NaN or infinite numbers; such a value fails before anything is written."""
    numbers = [f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")]
    if numbers:
        bad = [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in numbers]
        cond = bad[0]
        for b in bad[1:]:
            cond = cond | b
        require(rows.where(cond).select(*numbers), "not a finite number")
    rows.write.mode("errorifexists").json(path)


def check_new_output(path: str, inputs: list[str]) -> None:
    """An output must lie outside all inputs."""
    p = path.rstrip("/") + "/"
    for i in inputs:
        q = i.rstrip("/") + "/"
        if p.startswith(q) or q.startswith(p):
            raise ScanError(f"output {path} overlaps input {i}")


def snapshot(tables: dict[str, DataFrame], folder: str, report: DataFrame | None = None) -> dict[str, int]:
    """Writes the tables of a dataset version and a lock (table, rows, hash); refuses an existing folder.

    The lock's hash sums the hashes of all rows, so it is independent of order and files, and computed distributed.
    """
    counts = {}
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    lock = None
    for name in tables:
        one = table_digest(spark.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("table"), "rows", "hash")
        lock = one if lock is None else lock.unionByName(one)
    lock.coalesce(1).write.mode("errorifexists").json(f"{folder}/lock")
    if report is not None:
        write_json(report, f"{folder}/report")
    for r in spark.read.schema("table string, rows long, hash string").json(f"{folder}/lock").collect():  # a row per table
        counts[r["table"]] = r["rows"]
    return counts


def table_digest(rows: DataFrame) -> DataFrame:
    """(rows, hash) of a table as a multiset."""
    h = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash"))


def verify_snapshot(spark, folder: str, names: list[str]) -> DataFrame:
    """(table, problem) for tables that differ from their lock; read again before and after use."""
    lock = spark.read.schema("table string, rows long, hash string").json(f"{folder}/lock")
    now = None
    for name in names:
        one = table_digest(spark.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("table"), F.col("hash").alias("now"))
        now = one if now is None else now.unionByName(one)
    j = lock.join(now, "table", "full_outer")
    return j.where(~F.col("hash").eqNullSafe(F.col("now"))).select("table", F.when(F.col("hash").isNull(), "extra").when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def write_predictions(rows: DataFrame, folder: str, columns: list[str], error: str = "true_joint != joint_class") -> None:
    """Predictions and the wrong ones among them: one evaluation of the plan, two outputs."""
    kept = rows.persist()
    try:
        write_csv(kept, f"{folder}/predictions", columns)
        write_csv(kept.where(error), f"{folder}/errors", columns)
    finally:
        kept.unpersist()


def write_bundle(metrics: DataFrame, predictions: DataFrame, manifest: DataFrame, folder: str, columns: list[str]) -> None:
    """An evaluation bundle: metrics, predictions, errors and the manifest it was made from."""
    write_json(metrics, f"{folder}/metrics")
    write_predictions(predictions, folder, columns)
    write_csv(manifest, f"{folder}/manifest", manifest.columns)


def export_manifest(collection: DataFrame, earlier: DataFrame, path: str, seed: int = 42) -> DataFrame:
    """Collection to manifest: groups keep the split they had, new groups are ranked within their label, then written.

    A group that had several splits fails.
    """
    from granaria.operators.assignment import ranked_split
    from granaria.operators.identity import inherit

    rows = inherit(collection, earlier, "group_id", "split")
    require(rows.where("conflict").select("group_id"), "group had several splits")
    open_ = rows.where("inherited is null").groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("::", "fruit", "status"))), "|").alias("stratum"))
    fresh = ranked_split(open_, "group_id", "stratum", seed).select("group_id", F.col("split").alias("_fresh"))
    out = rows.join(fresh, "group_id", "left").withColumn("split", F.coalesce("inherited", "_fresh")).select("path", "fruit", "status", "source", "group_id", "sha256", "split")
    write_csv(out, path, out.columns)
    return out


def ingest(rows: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """Validated rows merged into a collection and written; a digest keeps its label. Invalid rows are counted by code, and
    any, or a digest under another label, fails at the end."""
    from granaria.operators.merge import conflicts, upsert
    from granaria.operators.rules import codes, counts_by_code, manifest_rules

    flagged = rows.withColumn("_codes", codes(manifest_rules(allow_unsplit=True)))
    good = flagged.where(F.size("_codes") == 0).drop("_codes")
    labels = ["fruit", "status"]
    merged = upsert(existing, good, "sha256", ["path", *labels], ["split"], ["source", "group_id"], guard=labels, order=["path"])
    merged.write.mode("errorifexists").json(path)
    require(counts_by_code(flagged.select(F.explode("_codes").alias("code"))), "rows were rejected")
    require(conflicts(existing, good, "sha256", labels), "labels differ")
    return merged
