"""Scans with fixed schemas: CSV manifests, JSON configs, image folders, arrays, collections, inventories.

Schemas are given, never inferred. Checks that must hold before rows are used raise ``ScanError`` or a Spark parse error;
row rules are evaluated by ``operators.rules``. An empty file list or an empty table is an error only where stated.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granaria.functions.paths import FRUITS, STATES, file_name, folder_labels, slashed
from granaria.functions.text import clean, norm
from granaria.operators.rules import manifest_rules, repeated, require, violations
from granaria.session import Workspace

MANIFEST = ("path", "fruit", "status", "source", "group_id", "sha256", "split")
OTHER = ("path", "category", "subcategory", "source", "group_id", "sha256", "split")
# Image file endings, compared without case.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp")


class ScanError(ValueError):
    """A source doesn't have the form that was asked for."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file. Reads one line; a byte order mark is dropped."""
    first = spark.read.csv(path, header=False).limit(1).collect()
    return [("" if v is None else v).lstrip("﻿").strip() for v in first[0]] if first else []


def scan_csv(spark: SparkSession, path: str, required: Iterable[str], path_column: str = "path") -> DataFrame:
    """A UTF-8 CSV with header: every column as trimmed text, nulls as empty, the path with forward slashes.

    Missing or repeated columns raise ScanError; a row with more or fewer values than the header fails the read. Extra
    columns are kept. The file's own header gives the positional schema, which is then checked against the file.
    """
    names = csv_header(spark, path)
    missing = [c for c in required if c not in names]
    if missing:
        raise ScanError(f"missing columns: {', '.join(missing)}")
    if len(names) != len(set(names)):
        raise ScanError("repeated column name")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[(slashed(clean(F.col(n))) if n == path_column else clean(F.col(n))).alias(n) for n in names])


def scan_manifest(spark: SparkSession, path: str, allow_unsplit: bool = False, kind: tuple[str, ...] = MANIFEST) -> DataFrame:
    """A validated manifest in path order: every row rule holds, no path twice, not empty."""
    rows = scan_csv(spark, path, kind)
    if rows.isEmpty():
        raise ScanError("empty manifest")
    if kind == MANIFEST:
        require(violations(rows, manifest_rules(allow_unsplit), "path"), "invalid manifest row")
    require(repeated(rows, norm(F.col("path")), "path"), "path occurs twice")
    return rows.orderBy(norm(F.col("path")), "path")


def with_ordinal(rows: DataFrame, name: str = "manifest_index") -> DataFrame:
    """Numbers rows from 0 in their order. The rows are written once with their partition and place in it; sums over the
    partitions, a row each, turn places into ordinals."""
    ws = Workspace(rows.sparkSession, "ordinal")
    placed = ws.save(rows.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).cast("int")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(first), "_part")
    return numbered.select(*rows.columns, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def scan_unique(spark: SparkSession, path: str, key: str = "sha256") -> DataFrame:
    """A CSV manifest in which ``key`` occurs once, with the row's ordinal."""
    rows = scan_csv(spark, path, MANIFEST)
    require(repeated(rows, F.nullif(F.col(key), F.lit("")), "path"), f"{key} occurs twice")
    return with_ordinal(rows)


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, sha256) of whole files, hashed where they are read."""
    f = spark.read.format("binaryFile").load(paths)
    return f.select(file_name(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"))


def scan_locked(spark: SparkSession, folder: str, manifest: str = "manifest.csv", lock: str = "dataset_lock.json") -> DataFrame:
    """The manifest of a locked dataset: digests of all locked files, and then the counts of the report, must agree."""
    from granaria.operators.rules import compare_counts, compare_locks

    want = scan_json(spark, f"{folder}/{lock}", "files map<string,string>, counts array<struct<split:string,fruit:string,status:string,n:bigint>>")
    expected = want.select(F.explode("files").alias("file", "sha256"))
    names = [r["file"] for r in expected.collect()]  # a lock names a handful of files
    by_name = expected.select(file_name(F.col("file")).alias("file"), "sha256")
    require(compare_locks(by_name, file_digests(spark, [f"{folder}/{n}" for n in names])), "locked file changed")
    rows = scan_manifest(spark, f"{folder}/{manifest}")
    found = rows.groupBy("split", "fruit", "status").agg(F.count(F.lit(1)).alias("n"))
    reported = want.select(F.explode("counts").alias("c")).select("c.*")
    require(compare_counts(found, reported, ["split", "fruit", "status"]), "counts differ from the report")
    return rows


def select_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of one split, after the whole table was checked: no group and no digest in two splits."""
    from granaria.operators.rules import spanning

    for key in ("group_id", "sha256"):
        require(spanning(rows, F.nullif(F.col(key), F.lit("")), "split"), f"{key} in several splits")
    return rows.where(F.col("split") == split)


def scan_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, name, fruit, status, length, sha256, content) of the image files below ``root``.

    Labels come from the two folders above a file, and are null elsewhere; endings are compared without case.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    p = F.regexp_replace("path", "^file:/+", "/")
    relative = F.substring(p, F.lit(len(root.rstrip("/")) + 2), F.length(p))
    rows = f.select(relative.alias("path"), "length", F.sha2("content", 256).alias("sha256"), "content")
    label = folder_labels(F.concat(F.lit("/"), F.col("path")))
    return rows.select("path", file_name(F.col("path")).alias("name"), label["fruit"].alias("fruit"), label["status"].alias("status"), "length", "sha256", "content")


def distinct_images(images: DataFrame) -> DataFrame:
    """One file for each content, the smallest path."""
    first = images.groupBy("sha256").agg(F.min("path").alias("path"))
    return images.join(first, ["sha256", "path"], "left_semi")


def require_classes(images: DataFrame, least: int) -> None:
    """Every label needs at least ``least`` files."""
    from granaria.operators.summary import dense_counts

    counts = dense_counts(images, {"fruit": FRUITS, "status": STATES})
    require(counts.where(F.col("n") < least), f"fewer than {least} files")


def discover(images: DataFrame, declared: DataFrame) -> DataFrame:
    """Files found, full-outer-joined with declared metadata by path without case: ``found`` and ``declared`` say where a row is from."""
    key = F.lower(slashed(F.col("path")))
    a = images.select(key.alias("k"), F.col("path").alias("file"), F.lit(True).alias("found"))
    b = declared.withColumn("k", key).withColumn("declared", F.lit(True))
    j = a.join(b, "k", "full_outer")
    return j.select(F.coalesce("file", "path").alias("path"), *[c for c in declared.columns if c != "path"], F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("declared", F.lit(False)).alias("declared"))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Group and source from a side table (relative_path, group_id, source); the file stem and ``unknown`` where it has none."""
    from granaria.functions.paths import stem

    g = groups.select(F.lower(slashed(F.col("relative_path"))).alias("k"), F.col("group_id").alias("_g"), F.col("source").alias("_s"))
    j = rows.withColumn("k", F.lower(slashed(F.col("path")))).join(g, "k", "left")
    return j.select(*rows.columns, F.coalesce(F.nullif(F.col("_g"), F.lit("")), stem(F.col("path"))).alias("group_id"), F.coalesce(F.nullif(F.col("_s"), F.lit("")), F.lit("unknown")).alias("source"))


def resolve_roots(rows: DataFrame, roots: dict[str, str]) -> DataFrame:
    """``full_path`` of rows that name their root by ``root_id``; an unknown root fails."""
    table = F.create_map(*[F.lit(x) for kv in roots.items() for x in kv])
    root = F.try_element_at(table, F.col("root_id"))
    return rows.withColumn("full_path", F.when(root.isNull(), F.raise_error(F.concat(F.lit("unknown root "), F.coalesce("root_id", F.lit("null"))))).otherwise(F.concat_ws("/", root, "path")))


def verified(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of records against file digests: ``match``, ``mismatch`` or ``missing``."""
    j = rows.select("path", "sha256").join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    return j.select("path", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "match").otherwise("mismatch").alias("state"))


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_config(text: str, kinds: dict[str, type]) -> dict:
    """A JSON config with exactly the given keys, numbers finite and of the given kinds; no booleans for numbers."""
    values = json.loads(text.lstrip("﻿"))
    if not isinstance(values, dict) or set(values) != set(kinds):
        raise ScanError(f"config needs exactly {', '.join(kinds)}")
    for key, kind in kinds.items():
        v = values[key]
        fine = isinstance(v, (int, float) if kind is float else kind) and not (isinstance(v, bool) and kind is not bool)
        if not fine or (kind in (int, float) and v != v) or (kind in (int, float) and abs(v) == float("inf")):
            raise ScanError(f"{key}: {v!r}")
    return values


def scan_vectors(spark: SparkSession, path: str, vector: str, width: int) -> DataFrame:
    """A table of vectors; wrong lengths and values that aren't finite fail before use."""
    from granaria.operators.rules import unit_rules

    rows = spark.read.parquet(path)
    bad = {k: v for k, v in unit_rules(vector, width).items() if k != "not_unit"}
    require(rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in bad.items()]))).alias("code")), "invalid vector")
    return rows


def scan_collection(spark: SparkSession, path: str, schema: str, split: str | None = None, fruit: str | None = None) -> DataFrame:
    """A document collection kept as JSON lines, filtered; the store's own id is dropped."""
    rows = spark.read.schema(schema).json(path)
    for name, value in (("split", split), ("fruit", fruit)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.drop("_id")


def read_or_none(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame | None:
    """A table for display, or None if it can't be read."""
    try:
        return spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return None


class PagedInventory(DataSource):
    """Asset inventory that is listed in pages: option ``pages`` is the number of pages, ``folder`` holds ``page-<n>.json``
    files with ``{"resources": [{"public_id": ..., "bytes": ...}]}``. Each page is a partition, so pages are read in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_inventory"

    def schema(self) -> str:
        return "public_id string, bytes long, page int"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pages = options["folder"], int(options["pages"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json as j

        with open(f"{self.folder}/page-{partition.value}.json", encoding="utf-8") as f:
            for r in j.load(f).get("resources", []):
                yield (r.get("public_id"), r.get("bytes"), partition.value)


def scan_inventory(spark: SparkSession, folder: str, pages: int) -> DataFrame:
    """Assets by the digest in their id; two assets of one digest fail."""
    from granaria.functions.paths import asset_digest

    spark.dataSource.register(PagedInventory)
    rows = spark.read.format("paged_inventory").options(folder=folder, pages=str(pages)).load()
    rows = rows.withColumn("sha256", asset_digest(F.col("public_id")))
    require(repeated(rows, F.col("sha256"), "public_id"), "several assets of one digest")
    return rows
