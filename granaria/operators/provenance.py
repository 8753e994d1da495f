"""Where an image comes from: file-name families, named parents, references seen earlier, and the resulting class.

Odd input: rows whose name tells nothing have no family and no parent; null digests refer to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granaria.functions.paths import file_kind
from granaria.functions.tags import join_sorted
from granaria.operators.decision import provenance


def with_family(rows: DataFrame) -> DataFrame:
    """Adds family (null without one), kind and agrees."""
    k = file_kind(F.col("path"), F.col("fruit"), F.col("status"))
    return rows.withColumn("_k", k).select("*", F.nullif(F.col("_k.family"), F.lit("")).alias("family"), F.col("_k.kind").alias("kind"), F.col("_k.agrees").alias("agrees")).drop("_k")


def family_audit(rows: DataFrame, split: str) -> DataFrame:
    """One row: families told by screen-shot names, those across splits and their rows, and those without an original."""
    f = with_family(rows).where(F.startswith("family", F.lit("screen::")))
    per = f.groupBy("family", split).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("kind") == "candidate_original").cast("int")).alias("original"))
    per = per.groupBy("family").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("splits"), F.max("original").alias("original"))
    return per.agg(
        F.count(F.lit(1)).alias("families"), F.count_if(F.col("splits") > 1).alias("families_across"),
        F.coalesce(F.sum(F.when(F.col("splits") > 1, F.col("n"))), F.lit(0)).alias("rows_across"), F.count_if(F.col("original") == 0).alias("without_original"),
    )


def named_parents(rows: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, parents, splits) of rows whose name has a family of originals of the same label in the baseline.

    Parents are counted; their distinct splits are listed.
    """
    b = with_family(baseline).where("family is not null and kind = 'candidate_original'")
    per = b.groupBy("fruit", "status", "family").agg(F.count(F.lit(1)).alias("parents"), join_sorted(F.collect_set("part")).alias("splits"))
    return with_family(rows).where("family is not null").join(per, ["fruit", "status", "family"]).select(key, "parents", "splits")


def classify(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows (camera_id, path, fruit, status, decode_status, sha, pix, declared_new) with references, category and reason.

    A reference is a baseline row with the same content, for bytes the last one by row id, for pixels the first, else the
    smallest earlier row of the input; earlier is by path. First rows come from aggregates, not windows, so a hot digest is no single task.
    """
    out = with_family(rows)
    for column, name, pick in (("sha", "byte_reference", F.max), ("pix", "pixel_reference", F.min)):
        base = baseline.where(F.col(column).isNotNull()).groupBy(column).agg(pick("row_id").alias("_b"))
        seen = out.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct("path", "camera_id")).alias("_s"))
        own = F.struct("path", "camera_id")
        out = out.join(base, column, "left").join(seen, column, "left")
        earlier = F.when(F.col("_s") < own, F.concat(F.lit("camera:"), F.col("_s.camera_id").cast("string")))
        out = out.withColumn(name, F.coalesce(F.concat(F.lit("baseline:"), F.col("_b").cast("string")), earlier)).drop("_b", "_s")
    parents = with_family(baseline).where("family is not null and kind = 'candidate_original'").select("fruit", "status", "family").distinct().withColumn("_p", F.lit(True))
    out = out.join(parents, ["fruit", "status", "family"], "left")
    c = provenance(F.col("decode_status"), F.col("byte_reference"), F.col("pixel_reference"), F.col("kind") == "offline_augmentation", F.coalesce("_p", F.lit(False)), F.col("declared_new"))
    return out.withColumn("_c", c).select("camera_id", "path", "fruit", "status", "family", "kind", "byte_reference", "pixel_reference", "_c.category", "_c.reason")
