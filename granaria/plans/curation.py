"""Queries of the summary, ordering, assignment, provenance and merge operators, over manifest, quality and camera tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.functions import paths as P
from granaria.functions.bits import parse_hex63
from granaria.functions.hashing import canonical_json_hash
from granaria.functions.tags import hard_case_tags as tags_of
from granaria.functions.tags import parse_matches
from granaria.functions.text import identity, known, norm
from granaria.operators import assignment as A
from granaria.operators import decision as D
from granaria.operators import merge, ordering, provenance
from granaria.operators import summary as S
from granaria.operators.components import connected_components
from granaria.operators.hamming import duplicates_across, near_pairs
from granaria.plans.common import fingerprints, quality, rec
from granaria.plans.curation_sql import SQL  # noqa: F401
from granaria.session import table

SPLIT_SET = (*P.SPLITS, "")


def _camera(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "camera_manifest").drop("received_at").distinct()


# ---- summaries


def label_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).select("fruit", "status", F.coalesce("part", F.lit("")).alias("part"))
    return S.dense_counts(r, {"fruit": P.FRUITS, "status": P.STATES, "part": SPLIT_SET})


def missing_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Source, label and split combinations that no record fills."""
    r = rec(spark, sf).select(F.lower(F.trim("source")).alias("source"), F.concat_ws("::", "fruit", "status").alias("label"), F.col("part"))
    sources = r.where("source is not null and source != ''").select("source").distinct()
    grid = sources.crossJoin(S.dimension(r, "label", P.CLASSES)).crossJoin(S.dimension(r, "part", P.SPLITS))
    return grid.join(r.select("source", "label", "part").distinct(), ["source", "label", "part"], "left_anti")


def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counters over all records and their latest measures, in one aggregate."""
    j = rec(spark, sf).join(quality(spark, sf), "path", "left")
    return j.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("sha").alias("digests"), F.count_distinct("grp").alias("groups"), F.count_distinct("path_k").alias("paths"),
        F.count_if(F.col("part").isNull()).alias("unassigned"), F.count_if(F.col("width").isNull()).alias("unmeasured"), F.count_if(F.col("fp").isNull()).alias("without_fingerprint"),
        F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"),
    )


def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    j = rec(spark, sf).select("path", F.concat_ws("::", "fruit", "status").alias("label")).join(quality(spark, sf), "path")
    q = S.quantile_summary(j, ["label"], ["width", "height", "brightness", "blur_score"], digits=None)
    # the nudge takes interpolated values off the rounding edge, where engines differ
    return q.select("label", "measure", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in q.columns[3:]])


def min_side_histogram(spark: SparkSession, sf: str) -> DataFrame:
    j = rec(spark, sf).select("path", "fruit").join(quality(spark, sf), "path")
    return S.edge_histogram(j, F.least("width", "height"), (96, 224, 512), ["fruit"])


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.tag_counts(_camera(spark, sf), "quality_flags")


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return S.completeness(_camera(spark, sf), ["group_id", "specimen_id", "session_id", "capture_device", "lighting", "review_status", "requested_split", "duplicate_of"])


def hard_case_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of each camera record from its lighting, and from measured flags read as annotations."""
    c = _camera(spark, sf)
    fields = {"lighting": F.when(F.col("lighting") == "lamp", "low_light").when(F.col("lighting") == "mixed", "uneven").otherwise(F.col("lighting")), "blur": F.contains("quality_flags", F.lit("BLUR")), "glare": F.contains("quality_flags", F.lit("HIGH_BRIGHTNESS"))}
    return c.select("camera_id", tags_of(fields).alias("tags"))


def inventory_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.composite_counts(_camera(spark, sf), ["requested_split", "fruit", "status"])


def count_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    c = _camera(spark, sf).withColumn("sha", identity(F.col("sha256")))
    return S.below_minimum(c, ["fruit", "status", "source"], 30, "sha")


def db_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def metric_melt(spark: SparkSession, sf: str) -> DataFrame:
    q = quality(spark, sf).select("path", F.col("brightness").cast("double").alias("brightness"), F.col("blur_score").cast("double").alias("blur_score"))
    return S.melt(q, ["path"], ["brightness", "blur_score"])


def json_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded near matches of camera records read from their JSON: number and nearest; cut-off text gives null."""
    m = _camera(spark, sf).select("camera_id", parse_matches(F.col("perceptual_candidates")).alias("m"))
    return m.where("size(m) > 0").select("camera_id", F.size("m").alias("n"), F.get("m", F.lit(0))["distance"].alias("distance"), F.get("m", F.lit(0))["reference"].alias("reference"))


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


# ---- flags and verdicts


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    q = quality(spark, sf)
    ok = F.when(F.col("width").isNull(), "DECODE_ERROR").otherwise("OK")
    return q.select("path", D.quality_flags(F.col("width"), F.col("height"), F.col("brightness"), F.col("blur_score"), ok, F.lit("MATCH")).alias("flags"))


def quality_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = D.quality_verdict(F.col("width"), F.col("height"), F.col("brightness"), F.col("blur_score"))
    return quality(spark, sf).where("width is not null").select("path", v.alias("v")).select("path", "v.passed", F.array_join("v.reasons", ";").alias("reasons"))


def plain_gate(spark: SparkSession, sf: str) -> DataFrame:
    g = D.plain_gate(F.col("width"), F.col("height"), F.col("brightness"), F.col("blur_score"), F.lit(None).cast("double"))
    return quality(spark, sf).groupBy(F.coalesce(g, F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- order-dependent


def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest records with the same pixels: the first by normalised path is kept, the others point to it."""
    r = rec(spark, sf).select("row_id", "path", norm(F.col("path")).alias("n")).join(quality(spark, sf).select("path", "pix"), "path", "left")
    return ordering.keep_first(r, "pix", ["n"], "row_id").where("not kept").select("row_id", "duplicate_of")


def first_seen_reference(spark: SparkSession, sf: str) -> DataFrame:
    c = _camera(spark, sf).select("camera_id", "batch_no", identity(F.col("sha256")).alias("sha"))
    return ordering.earlier_reference(c, "sha", ["batch_no"], "camera_id").where("reference is not null").select("camera_id", "reference")


def repeats_within_source(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.repeats_within(rec(spark, sf), "source", "sha")


def first_per_class(spark: SparkSession, sf: str) -> DataFrame:
    """The first five records of each class by path: the sampling operator of a candidate upload."""
    return ordering.first_per_class(rec(spark, sf).select("fruit", "status", "path", "row_id"), ["fruit", "status"], ["path", "row_id"], 5)


def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Early stopping over daily means of events, one series for each event type."""
    e = table(spark, sf, "events")
    day = e.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2020-01-01")).cast("long").alias("step")).agg(F.round(F.avg("value"), 6).alias("score"), F.round(F.max("value"), 6).alias("loss"))
    return ordering.early_stop(day, "event_type", "step", "score", "loss", patience=5)


# ---- assignment


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).where("grp is not null")
    return r.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("::", "fruit", "status"))), "|").alias("stratum"))


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return A.ranked_split(_groups(spark, sf), "grp", "stratum", 42)


def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    return rec(spark, sf).where("grp is not null").select("grp").distinct().select("grp", A.hash_split(F.col("grp"), 42).alias("split"))


def _linkable(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).join(quality(spark, sf).select("path", "pix"), "path", "left")
    k = P.file_kind(F.col("path"), F.col("fruit"), F.col("status"))
    return r.select("row_id", "path_k", "grp", "sha", "pix", k.alias("k")).withColumn("family", F.when(F.col("k.family") != "", F.col("k.family")))


def component_group_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest records linked by digest, pixels and file-name family; ``component_group_build`` takes the declared group too."""
    return A.component_ids(_linkable(spark, sf), "row_id", ["sha", "pix", "family"], "path_k")


def component_group_build(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest records linked by declared group, digest, pixels and file-name family."""
    return A.component_ids(_linkable(spark, sf), "row_id", ["grp", "sha", "pix", "family"], "path_k")


def component_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the near-duplicate graph of fingerprints."""
    pairs = near_pairs(fingerprints(spark, sf))
    return connected_components(pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))).select(F.col("v").alias("fp"), "root")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    ids = rec(spark, sf).where("path_k is not null").groupBy("path_k").agg(F.min("row_id").alias("row_id"))
    from granaria.functions.text import path_key

    v = table(spark, sf, "visual_review").where("action = 'keep_labels_and_coassign_group'").select(path_key(F.col("path_a")).alias("ka"), path_key(F.col("path_b")).alias("kb"))
    return v.join(ids.select(F.col("path_k").alias("ka"), F.col("row_id").alias("a")), "ka").join(ids.select(F.col("path_k").alias("kb"), F.col("row_id").alias("b")), "kb").select("a", "b")


def coassign_split(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).select("row_id", F.coalesce("grp", F.concat(F.lit("#"), "row_id")).alias("grp"), F.concat_ws("::", "fruit", "status").alias("label"))
    return A.coassign(r, "row_id", "grp", "label", _pairs(spark, sf), 42)


def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).select("row_id", F.coalesce("grp", F.concat(F.lit("#"), "row_id")).alias("grp"))
    return A.merge_report(r, coassign_split(spark, sf).select("row_id", "component"), "row_id", "grp", "component")


def freeze_and_extend(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).select("row_id", "grp", "sha", "part", F.concat_ws("::", "fruit", "status").alias("label"))
    return A.freeze_and_extend(r, "row_id", ["grp", "sha"], "part", "label", 42)


def freeze_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The older freeze: groups joined by digests keep their split, new ones go to train."""
    return A.freeze_groups(rec(spark, sf).select("row_id", "grp", "sha", "part"), "row_id", "grp", "sha", "part")


def cross_group_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate pairs of records that the pixel deduplication keeps and whose groups differ, the earlier path first."""
    seen = table(spark, sf, "image_quality").select("path", parse_hex63(identity(F.col("phash63"))).alias("fp"), identity(F.col("pixel_sha256")).alias("pix")).distinct()
    r = rec(spark, sf).select("row_id", "path", "path_k", F.coalesce("grp", F.concat(F.lit("#"), "row_id")).alias("grp")).join(seen, "path")
    kept = ordering.keep_first(r, "pix", ["path_k"], "row_id").where("kept and fp is not null").select("row_id", "path_k", "grp", "fp").distinct()
    return duplicates_across(kept)


def reviewed_split(spark: SparkSession, sf: str) -> DataFrame:
    """Camera records against the frozen manifest: linked by group, digest, pixels and specimen."""
    c = _camera(spark, sf).select(
        (F.col("camera_id") + 1_000_000_000).alias("id"), F.lit(False).alias("base"), F.lit(None).cast("string").alias("part"), identity(F.col("requested_split")).alias("requested"),
        identity(F.col("group_id")).alias("grp"), identity(F.col("sha256")).alias("sha"), identity(F.col("pixel_sha256")).alias("pix"), F.when(known(F.col("specimen_id")), F.col("specimen_id")).alias("specimen"),
    )
    m = rec(spark, sf).join(quality(spark, sf).select("path", "pix"), "path", "left").select(F.col("row_id").alias("id"), F.lit(True).alias("base"), "part", F.lit(None).cast("string").alias("requested"), "grp", "sha", "pix", F.lit(None).cast("string").alias("specimen"))
    return A.reviewed_split(c.unionByName(m), "id", ["grp", "sha", "pix", "specimen"], "base", "part", "requested", "grp", 42)


# ---- provenance


def filename_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = P.file_kind(F.col("path"), F.col("fruit"), F.col("status"))
    return rec(spark, sf).select(k.alias("k")).groupBy("k.kind", "k.reason", "k.agrees").agg(F.count(F.lit(1)).alias("n"))


def filename_families(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.family_audit(rec(spark, sf), "part")


def parent_families(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.named_parents(_camera(spark, sf).select("camera_id", "path", "fruit", "status"), rec(spark, sf), "camera_id")


def provenance_classes(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.classify(_provenance_input(spark, sf), _baseline(spark, sf)).select("camera_id", "category", "reason", "byte_reference", "pixel_reference")


def provenance_report(spark: SparkSession, sf: str) -> DataFrame:
    c = provenance.classify(_provenance_input(spark, sf), _baseline(spark, sf))
    return c.groupBy("category", "reason", "fruit", "status").agg(F.count(F.lit(1)).alias("n"))


def _provenance_input(spark: SparkSession, sf: str) -> DataFrame:
    declared = (F.col("review_status") == "APPROVED") & known(F.col("specimen_id")) & known(F.col("session_id"))
    return _camera(spark, sf).select("camera_id", "path", "fruit", "status", "decode_status", identity(F.col("sha256")).alias("sha"), identity(F.col("pixel_sha256")).alias("pix"), declared.alias("declared_new"))


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rec(spark, sf).join(quality(spark, sf).select("path", "pix"), "path", "left")


# ---- merge


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Camera records merged into the manifest by digest: split only on insert, source filled, another label refused."""
    existing, incoming = _merge_sides(spark, sf)
    return merge.upsert(existing, incoming, "sha", ["fruit", "status"], ["split"], ["source"], guard=["fruit", "status"], order=["id"])


def upsert_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Digests whose incoming labels differ from each other or from the manifest's."""
    return merge.conflicts(*_merge_sides(spark, sf), "sha", ["fruit", "status"])


def _merge_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cols = ("fruit", "status", "split", "source")
    first = F.min(F.struct("row_id", "fruit", "status", F.col("part").alias("split"), "source")).alias("r")
    existing = rec(spark, sf).where("sha is not null").groupBy("sha").agg(first).select("sha", *[f"r.{c}" for c in cols])
    incoming = _camera(spark, sf).select(F.col("camera_id").alias("id"), identity(F.col("sha256")).alias("sha"), "fruit", "status", F.col("requested_split").alias("split"), "source")
    return existing, incoming


def version_record(spark: SparkSession, sf: str) -> DataFrame:
    return merge.version_record(rec(spark, sf).withColumn("part", F.coalesce("part", F.lit("UNASSIGNED"))), "v1", ["part", "fruit", "status"])


def group_split_update(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf).select("row_id", "grp", F.col("part").alias("split"))
    return merge.update_by_group(r, split_stratified(spark, sf), "grp", "split")


def union_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest and camera rows as one table with differing columns, counted by origin and label."""
    a = rec(spark, sf).select(F.lit("manifest").alias("origin"), "fruit", "status", F.col("part").alias("split"))
    b = _camera(spark, sf).select(F.lit("camera").alias("origin"), "fruit", "status", "batch_no")
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin", "fruit", "status").agg(F.count(F.lit(1)).alias("n"), F.count("split").alias("with_split"), F.count_distinct("batch_no").alias("batches"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON hash of each record's label fields, and an exportable file name."""
    r = rec(spark, sf).select("row_id", "path", "fruit", "status")
    return r.select("row_id", canonical_json_hash(["fruit", "status"]).alias("label_hash"), P.safe_name(F.col("row_id"), F.col("path")).alias("file_name"))


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    r = rec(spark, sf)
    return r.select("row_id", P.is_safe(F.col("path")).alias("safe"), P.strip_prefix(F.col("path"), "RAW").alias("below_raw"), P.folder_labels(F.col("path"))["fruit"].alias("folder_fruit"), P.folder_labels(F.col("path"))["status"].alias("folder_status"), P.asset_digest(F.col("path")).alias("asset"))


QUERIES = {
    f.__name__: f
    for f in (
        label_split_counts, missing_buckets, audit_counts, quality_profile, min_side_histogram, tag_counts, completeness, hard_case_tags, inventory_report, count_thresholds,
        db_group_summary, metric_melt, json_matches, event_props, quality_flags, quality_verdicts, plain_gate, dedup_keep_first, first_seen_reference, repeats_within_source,
        first_per_class, best_epoch, split_stratified, split_hash, component_group_hash, component_group_build, component_ids, coassign_split, merge_report, freeze_and_extend, freeze_groups, cross_group_pairs, reviewed_split,
        filename_kinds, filename_families, parent_families, provenance_classes, provenance_report, upsert_merge, upsert_conflicts, version_record, group_split_update, union_counts, content_hashes, path_parts,
    )
}
