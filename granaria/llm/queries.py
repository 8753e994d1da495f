"""Queries of the training-data problems (p2, p3, p5 to p9), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.llm.fingerprints import digest, fingerprint, manifest_prints
from granaria.llm.grouping import group_links, review_links
from granaria.llm.history import open_history
from granaria.llm.leakage import find_leaks
from granaria.llm.mixing import mix_sources
from granaria.llm.overlap import find_overlap, overlap_pairs, overlap_records, overlap_report
from granaria.llm.residue import judge
from granaria.llm.splits import assign_splits, broken_groups, invariants, manifest_records, split_shares
from granaria.session import table


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    camera = table(spark, sf, "camera_manifest")
    return camera.select(F.col("camera_id").alias("id"), F.col("batch_no").alias("batch"), digest(F.col("sha256")).alias("sha"), digest(F.col("pixel_sha256")).alias("pix"), fingerprint(F.col("phash63")).alias("fp"))


def _admitted(spark: SparkSession, sf: str) -> DataFrame:
    history = open_history(spark, manifest_prints(table(spark, sf, "manifest"), table(spark, sf, "image_quality")))
    return history.admit(_batches(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _admitted(spark, sf).where("found is not null").select(F.col("id").alias("camera_id")).distinct()


def p2_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch: records, new ones, and those found in the history or in an earlier batch."""
    rows = _admitted(spark, sf).distinct()
    return rows.groupBy(F.col("batch").alias("batch_no")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("found").isNull()).alias("new_records"),
        F.count_if(F.col("found") == "history").alias("in_history"),
        F.count_if(F.col("found") == "batch").alias("in_earlier_batch"),
    )


def _targets(spark: SparkSession, sf: str) -> dict[str, float]:
    return {r["split"]: r["target_share"] for r in table(spark, sf, "split_targets").collect()}  # a row per split


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return broken_groups(manifest_records(table(spark, sf, "manifest"))).select(F.col("component").alias("first_row_id"))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(manifest_records(table(spark, sf, "manifest")), _targets(spark, sf))


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    return split_shares(p3_splits(spark, sf), _targets(spark, sf))


def p3_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each split of each stratum has its share to the nearest record, and groups stay whole."""
    return invariants(p3_splits(spark, sf), _targets(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_pairs(find_overlap(table(spark, sf, "manifest"), table(spark, sf, "image_quality")))


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_records(find_overlap(table(spark, sf, "manifest"), table(spark, sf, "image_quality")))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_report(find_overlap(table(spark, sf, "manifest"), table(spark, sf, "image_quality")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    links = review_links(table(spark, sf, "visual_review"), table(spark, sf, "manifest"))
    return group_links(links).select(F.col("group").alias("group_row_id"), F.col("v").alias("row_id"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked item: documents that hold it and the largest share of its words that one of them holds."""
    leaks = find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    per = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max(F.col("covered_words") / F.col("item_words")).alias("most"))
    return table(spark, sf, "eval_items").select("item_id", "test_set", "lang").join(per, "item_id")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source's share lies within 0.02 and two of its longest documents of its target (and what sources without
    documents leave to others), whether no document is used too often, and whether the sums of the mix agree with the report."""
    mix, shares = mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    whole = shares.agg(F.coalesce(F.sum(F.when(F.col("tokens_available") == 0, F.col("target_share"))), F.lit(0.0)).alias("lost"), F.sum("tokens_used").alias("whole"))
    summed = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("sum"), F.max("uses").alias("most"), F.max("tokens").alias("longest"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids"))
    j = shares.join(summed, "source", "left").crossJoin(F.broadcast(whole))
    has = F.col("tokens_available") > 0
    error = F.col("share") - F.col("target_share")
    slack = 0.02 + 2 * F.coalesce(F.try_divide("longest", "whole"), F.lit(0.0))
    near = F.when(has, (error > -slack) & (error < slack + F.col("lost"))).otherwise(F.col("share") == 0)
    agree = (F.coalesce("sum", F.lit(0)) == F.col("tokens_used")) & (F.coalesce("rows", F.lit(0)) == F.coalesce("ids", F.lit(0))) & (F.col("tokens_used") <= F.col("tokens_available") * F.col("max_repeats"))
    return j.select("source", "max_repeats", has.alias("has_documents"), near.alias("near_target"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), agree.alias("sums_agree"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents")).where("is_residue").select("doc_id")


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The clean corpus, whole texts."""
    documents = table(spark, sf, "documents")
    return judge(documents, *documents.columns).where("not is_residue").select(*documents.columns)


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_batches, p3_found, p3_splits, p3_shares, p3_invariants, p5_found, p5_records, p5_report, p6_found, p7_found, p7_report, p8_mix, p8_shares, p8_invariants, p9_found, p9_clean)
}
