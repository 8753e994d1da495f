"""Queries of the identity, reconciliation and rule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.functions.bits import parse_hex63
from granaria.functions.paths import SPLITS
from granaria.functions.text import identity, known, path_key
from granaria.operators import identity as I  # noqa: E741
from granaria.operators import ordering, rules
from granaria.operators.hamming import near_pairs
from granaria.plans.common import PRINTS, QUAL, REC, fingerprints, ident, pathk, quality, rec
from granaria.session import table


def identity_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return I.duplicate_summary(rec(spark, sf))


def identity_cross_split(spark: SparkSession, sf: str) -> DataFrame:
    return I.cross_split(rec(spark, sf))


def leakage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return I.leakage_summary(rec(spark, sf))


def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return I.label_conflicts(rec(spark, sf))


def specimen_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    camera = table(spark, sf, "camera_manifest").where(known(F.col("specimen_id"))).withColumn("g", F.coalesce(identity(F.col("group_id")), F.lit("unknown")))
    return rules.spanning(camera, F.col("specimen_id"), "g")


def quality_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return I.coverage(table(spark, sf, "manifest"), table(spark, sf, "image_quality"), "path")


def catalog_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    k = lambda t: table(spark, sf, t).select(path_key(F.col("path")).alias("path_k"))
    return I.set_difference(k("manifest"), k("image_quality"), "path_k")


def shared_groups(spark: SparkSession, sf: str) -> DataFrame:
    return I.shared_groups(rec(spark, sf))


def _camera(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "camera_manifest").select(
        "camera_id", "path", "fruit", "status", "specimen_id", identity(F.col("sha256")).alias("sha"), identity(F.col("pixel_sha256")).alias("pix"),
        parse_hex63(identity(F.col("phash63"))).alias("fp"), identity(F.col("group_id")).alias("grp"), "requested_split",
    ).distinct()


def reference_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Camera records whose digest or group the manifest knows, counted by which."""
    flagged = I.overlap_flags(_camera(spark, sf), rec(spark, sf), ["sha", "grp"])
    return flagged.groupBy("has_sha", "has_grp").agg(F.count(F.lit(1)).alias("n"))


def content_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Camera records that share bytes or pixels with another camera record or a baseline record."""
    camera = _camera(spark, sf).select(F.concat(F.lit("camera:"), F.col("camera_id")).alias("ref"), "sha", "pix")
    base = rec(spark, sf).join(quality(spark, sf).select("path", "pix"), "path", "left").select(F.concat(F.lit("baseline:"), F.col("row_id")).alias("ref"), "sha", "pix")
    return I.content_matches(camera, camera.unionByName(base), {"sha": "SHA256", "pix": "DECODED_PIXEL"})


def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different fingerprints at most four bits apart, with the records that carry each (copies stay classes)."""
    q = fingerprints(spark, sf)
    size = q.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: size.select(F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}"))
    return near_pairs(q).join(side("a"), "fp_a").join(side("b"), "fp_b").select("fp_a", "fp_b", "distance", "n_a", "n_b")


def nearest_match(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest baseline fingerprint of every camera record that has one within four bits; ties by smaller fingerprint."""
    camera = _camera(spark, sf)
    close = near_pairs(camera, fingerprints(spark, sf))
    best = close.groupBy(F.col("fp_a").alias("fp")).agg(F.min(F.struct("distance", F.col("fp_b").alias("reference"))).alias("m"), F.count(F.lit(1)).alias("candidates"))
    return camera.join(best, "fp").select("camera_id", "m.distance", "m.reference", "candidates")


def review_sides(spark: SparkSession, sf: str) -> DataFrame:
    return I.pair_sides(table(spark, sf, "visual_review"), rec(spark, sf))


def pair_ordering(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed pairs in review order, the first 100 (the review page), and whether that is all of them."""
    q = quality(spark, sf)
    r = rec(spark, sf).select("row_id", "path").join(q.select("path", "fp"), "path")
    side = lambda x: r.groupBy(F.col("row_id").alias(f"row_id_{x}")).agg(F.min("fp").alias(f"fp_{x}"))
    s = review_sides(spark, sf).where("row_id_a != row_id_b").select("row_id_a", "row_id_b", "different_labels", "cross_split").distinct()
    j = s.join(side("a"), "row_id_a").join(side("b"), "row_id_b").withColumn("distance", F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))).where("distance is not null")
    return ordering.capped(j.drop("fp_a", "fp_b"), ordering.pair_order(), 100)


def catalog_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest digests against the camera table as document store and the quality table as asset inventory, by state."""
    first = lambda df: df.where("sha is not null").groupBy("sha").agg(F.min("fruit").alias("fruit"), F.min("status").alias("status"))
    assets = table(spark, sf, "image_quality").select(identity(F.col("actual_sha256")).alias("sha")).where("sha is not null")
    return I.reconcile(first(rec(spark, sf)), first(_camera(spark, sf)), assets, "sha", ["fruit", "status"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def inherit_split(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest records without a split inherit that of their group, where its records agree."""
    r = rec(spark, sf)
    out = I.inherit(r.where("part is null").select("row_id", "grp"), r.where(F.col("part").isin(*SPLITS)), "grp", "part")
    return out.select("row_id", "inherited", "conflict")


def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "manifest").drop("loaded_at").distinct()
    return rules.counts_by_code(rules.violations(rows, rules.manifest_rules(allow_unsplit=True), "row_id"))


def inventory_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "camera_manifest").drop("received_at").distinct()
    return rules.violations(rows, rules.inventory_rules(), "camera_id")


def pair_violations(spark: SparkSession, sf: str) -> DataFrame:
    return rules.violations(table(spark, sf, "visual_review"), rules.pair_rules(), "pair_id")


def repeated_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests that several records hold: the uniqueness check of a digest-keyed scan."""
    return rules.repeated(rec(spark, sf), F.col("sha"), "row_id")


def catalog_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Paths whose declared digest differs between manifest and quality table, or that only one of them has, by column."""
    a = rec(spark, sf).groupBy("path").agg(F.min("sha").alias("sha"))
    b = table(spark, sf, "image_quality").select("path", identity(F.col("sha256")).alias("sha")).groupBy("path").agg(F.min("sha").alias("sha"))
    return rules.differing(a, b, ["path"], ["sha"]).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def index_cover(spark: SparkSession, sf: str) -> DataFrame:
    return rules.covers_once(rec(spark, sf), "row_id")


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return rules.violations(e, rules.unit_rules("embedding", 64), "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        identity_duplicates, identity_cross_split, leakage_summary, label_conflicts, specimen_conflicts, quality_coverage, catalog_set_diff, shared_groups,
        reference_overlap, content_matches, near_duplicate_pairs, nearest_match, review_sides, pair_ordering, catalog_reconcile, inherit_split,
        manifest_violations, inventory_violations, pair_violations, repeated_digests, catalog_differences, index_cover, unit_vectors,
    )
}

_KEYED = """keyed AS (SELECT row_id, part, 'path' AS key_name, path_k AS key FROM rec UNION ALL SELECT row_id, part, 'sha256', sha FROM rec UNION ALL SELECT row_id, part, 'group_id', grp FROM rec)"""
_CAM = f"""cam AS (SELECT DISTINCT camera_id, path, fruit, status, specimen_id, {ident("sha256")} AS sha, {ident("pixel_sha256")} AS pix, TRY_CAST('0x' || {ident("phash63")} AS BIGINT) AS fp, {ident("group_id")} AS grp, requested_split FROM camera_manifest)"""
_SET = "('', 'UNKNOWN', 'NOT_AVAILABLE', 'UNASSIGNED', 'NONE')"
_SIDES = f"""ids AS (SELECT path_k, min(struct_pack(row_id := row_id, fruit := fruit, status := status, sha := sha, part := part)) AS r FROM rec WHERE path_k IS NOT NULL GROUP BY path_k),
sides AS (SELECT v.pair_id, a.r.row_id AS row_id_a, b.r.row_id AS row_id_b, a.r.fruit <> b.r.fruit OR a.r.status <> b.r.status AS different_labels, coalesce(a.r.part, '') <> coalesce(b.r.part, '') AS cross_split,
  coalesce({ident("v.sha256_a")} = a.r.sha, true) AND coalesce({ident("v.sha256_b")} = b.r.sha, true) AS digests_agree
  FROM visual_review v JOIN ids a ON a.path_k = {pathk("v.path_a")} JOIN ids b ON b.path_k = {pathk("v.path_b")})"""

SQL = {
    "identity_duplicates": f"""WITH {REC}, {_KEYED}, n AS (SELECT key_name, key, count(*) AS n FROM keyed WHERE key IS NOT NULL AND key_name <> 'group_id' GROUP BY ALL HAVING count(*) > 1)
SELECT key_name, count(*) AS keys, sum(n - 1)::BIGINT AS extra_records FROM n GROUP BY key_name""",
    "identity_cross_split": f"""WITH {REC}, {_KEYED} SELECT key_name, key, count(*) AS records, list_sort(list(DISTINCT part)) AS splits FROM keyed WHERE key IS NOT NULL AND part IN ('train','val','test')
GROUP BY ALL HAVING count(DISTINCT part) > 1""",
    "leakage_summary": f"""WITH {REC}, {_KEYED}, s AS (SELECT key_name, key, count(DISTINCT coalesce(part, '')) AS a, count(DISTINCT part) FILTER (part IN ('train','val','test')) AS b FROM keyed WHERE key IS NOT NULL GROUP BY ALL)
SELECT key_name, count(*) FILTER (b > 1) AS assigned_keys, count(*) FILTER (a > 1) AS all_keys FROM s GROUP BY key_name HAVING count(*) FILTER (a > 1) > 0""",
    "label_conflicts": f"""WITH {REC} SELECT sha AS key, count(*) AS records, list_sort(list(DISTINCT fruit || '::' || status)) AS labels FROM rec WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT fruit || '::' || status) > 1""",
    "specimen_conflicts": f"""SELECT specimen_id AS key, count(*) AS n, list_sort(list(DISTINCT coalesce({ident("group_id")}, 'unknown'))) AS values FROM camera_manifest
WHERE specimen_id IS NOT NULL AND upper(trim(specimen_id)) NOT IN {_SET} GROUP BY ALL HAVING count(DISTINCT coalesce({ident("group_id")}, 'unknown')) > 1""",
    "quality_coverage": """SELECT count(*) FILTER (m.path IS NOT NULL AND q.path IS NOT NULL) AS matched, count(*) FILTER (q.path IS NULL) AS left_only, count(*) FILTER (m.path IS NULL) AS right_only
FROM (SELECT DISTINCT path FROM manifest WHERE path IS NOT NULL) m FULL JOIN (SELECT DISTINCT path FROM image_quality WHERE path IS NOT NULL) q ON m.path = q.path""",
    "catalog_set_diff": f"""WITH m AS (SELECT DISTINCT {pathk("path")} AS path_k FROM manifest), q AS (SELECT DISTINCT {pathk("path")} AS path_k FROM image_quality)
(SELECT path_k, 'missing' AS side FROM m EXCEPT SELECT path_k, 'missing' FROM q) UNION ALL (SELECT path_k, 'extra' FROM q EXCEPT SELECT path_k, 'extra' FROM m)""",
    "shared_groups": f"""WITH {REC}, s AS (SELECT DISTINCT grp, part FROM rec WHERE grp IS NOT NULL AND part IN ('train','val','test'))
SELECT a.part AS split_a, b.part AS split_b, count(*) AS groups FROM s a JOIN s b ON a.grp = b.grp AND a.part < b.part GROUP BY ALL""",
    "reference_overlap": f"""WITH {REC}, {_CAM} SELECT coalesce(sha IN (SELECT sha FROM rec WHERE sha IS NOT NULL), false) AS has_sha, coalesce(grp IN (SELECT grp FROM rec WHERE grp IS NOT NULL), false) AS has_grp, count(*) AS n FROM cam GROUP BY ALL""",
    "content_matches": f"""WITH {REC}, {QUAL}, {_CAM}, refs AS (SELECT 'camera:' || camera_id AS ref, sha, pix FROM cam UNION ALL SELECT 'baseline:' || r.row_id, r.sha, q.pix FROM rec r LEFT JOIN qual q USING (path)),
m AS (SELECT c.ref, 'SHA256' AS kind, o.ref AS other FROM refs c JOIN refs o ON c.sha = o.sha AND c.ref <> o.ref WHERE c.ref LIKE 'camera:%'
 UNION SELECT c.ref, 'DECODED_PIXEL', o.ref FROM refs c JOIN refs o ON c.pix = o.pix AND c.ref <> o.ref WHERE c.ref LIKE 'camera:%')
SELECT ref, array_to_string(list_sort(list(DISTINCT kind)), ';') AS kinds, count(*) AS matches, min(other) AS first_match FROM m GROUP BY ref""",
    "near_duplicate_pairs": f"""WITH {PRINTS}, f AS (SELECT fp, count(*) AS n FROM fps WHERE fp IS NOT NULL GROUP BY fp)
SELECT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp)) AS distance, a.n AS n_a, b.n AS n_b FROM f a JOIN f b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 4""",
    "nearest_match": f"""WITH {PRINTS}, {_CAM}, f AS (SELECT DISTINCT fp FROM fps WHERE fp IS NOT NULL), c AS (SELECT DISTINCT fp FROM cam WHERE fp IS NOT NULL),
m AS (SELECT c.fp, bit_count(xor(c.fp, f.fp)) AS distance, f.fp AS reference FROM c JOIN f ON bit_count(xor(c.fp, f.fp)) <= 4),
b AS (SELECT fp, min(distance) AS distance, arg_min(reference, (distance, reference)) AS reference, count(*) AS candidates FROM m GROUP BY fp)
SELECT camera_id, distance, reference, candidates FROM cam JOIN b USING (fp)""",
    "review_sides": f"WITH {REC}, {_SIDES} SELECT * FROM sides",
    "pair_ordering": f"""WITH {REC}, {QUAL}, {_SIDES}, r AS (SELECT row_id, min(fp) AS fp FROM rec JOIN qual USING (path) GROUP BY row_id),
j AS (SELECT DISTINCT row_id_a, row_id_b, different_labels, cross_split, bit_count(xor(a.fp, b.fp)) AS distance FROM sides JOIN r a ON a.row_id = row_id_a JOIN r b ON b.row_id = row_id_b WHERE row_id_a <> row_id_b AND a.fp IS NOT NULL AND b.fp IS NOT NULL)
SELECT *, (SELECT count(*) FROM j) <= 100 AS complete FROM j ORDER BY different_labels DESC, cross_split DESC, distance, row_id_a, row_id_b LIMIT 100""",
    "catalog_reconcile": f"""WITH {REC}, {_CAM}, c AS (SELECT sha, min(fruit) AS fruit, min(status) AS status FROM rec WHERE sha IS NOT NULL GROUP BY sha), s AS (SELECT sha, min(fruit) AS fruit, min(status) AS status FROM cam WHERE sha IS NOT NULL GROUP BY sha),
a AS (SELECT DISTINCT {ident("actual_sha256")} AS sha FROM image_quality)
SELECT CASE WHEN s.sha IS NOT NULL AND (s.fruit <> c.fruit OR s.status <> c.status) THEN 'conflict' WHEN s.sha IS NOT NULL AND a.sha IS NOT NULL THEN 'complete' WHEN s.sha IS NOT NULL THEN 'record_only' WHEN a.sha IS NOT NULL THEN 'asset_only' ELSE 'absent' END AS state, count(*) AS n
FROM c LEFT JOIN s USING (sha) LEFT JOIN a USING (sha) GROUP BY ALL""",
    "inherit_split": f"""WITH {REC}, k AS (SELECT grp, min(part) AS lo, max(part) AS hi FROM rec WHERE grp IS NOT NULL AND part IN ('train','val','test') GROUP BY grp)
SELECT row_id, CASE WHEN lo = hi THEN lo END AS inherited, coalesce(lo <> hi, false) AS conflict FROM rec LEFT JOIN k USING (grp) WHERE part IS NULL""",
    "manifest_violations": r"""WITH m AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM manifest), v AS (
SELECT 'missing' AS code FROM m WHERE coalesce(trim(path), '') = '' UNION ALL SELECT 'missing' FROM m WHERE coalesce(trim(fruit), '') = '' UNION ALL SELECT 'missing' FROM m WHERE coalesce(trim(status), '') = ''
UNION ALL SELECT 'missing' FROM m WHERE coalesce(trim(source), '') = '' UNION ALL SELECT 'missing' FROM m WHERE coalesce(trim(group_id), '') = '' UNION ALL SELECT 'missing' FROM m WHERE coalesce(trim(sha256), '') = ''
UNION ALL SELECT 'unsafe_path' FROM m WHERE coalesce(path, '') = '' OR starts_with(replace(path, '\', '/'), '/') OR contains(path, ':') OR contains(path, chr(0)) OR list_contains(string_split(replace(path, '\', '/'), '/'), '..')
UNION ALL SELECT 'unsupported_label' FROM m WHERE NOT coalesce(fruit IN ('apple','banana','orange','tomato') AND status IN ('fresh','rotten'), false)
UNION ALL SELECT 'invalid_split' FROM m WHERE NOT (coalesce(split IN ('train','val','test'), false) OR coalesce(trim(split), '') = '')
UNION ALL SELECT 'invalid_sha256' FROM m WHERE NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false))
SELECT code, count(*) AS n FROM v GROUP BY code""",
    "inventory_violations": f"""WITH m AS (SELECT DISTINCT * EXCLUDE (received_at) FROM camera_manifest), k AS (SELECT *, coalesce(upper(trim(specimen_id)) NOT IN {_SET}, false) AS ks, coalesce(upper(trim(group_id)) NOT IN {_SET}, false) AS kg, coalesce(upper(trim(expected_sha256)) NOT IN {_SET}, false) AS ke, coalesce(upper(trim(requested_split)) NOT IN {_SET}, false) AS kr FROM m)
SELECT camera_id, 'label_without_kind' AS code FROM k WHERE label_type = 'SUPPORTED' AND NOT coalesce(fruit IN ('apple','banana','orange','tomato') AND status IN ('fresh','rotten'), false)
UNION ALL SELECT camera_id, 'specimen_without_group' FROM k WHERE ks AND NOT kg UNION ALL SELECT camera_id, 'group_without_specimen' FROM k WHERE kg AND NOT ks
UNION ALL SELECT camera_id, 'decode_flag' FROM k WHERE decode_ok <> (decode_status = 'OK') UNION ALL SELECT camera_id, 'digest_mismatch' FROM k WHERE ke AND lower(expected_sha256) <> lower(sha256)
UNION ALL SELECT camera_id, 'split_before_review' FROM k WHERE kr AND review_status = 'REJECTED'""",
    "pair_violations": f"""SELECT pair_id, 'invalid_pair_id' AS code FROM visual_review WHERE NOT coalesce(pair_id >= 1, false) UNION ALL SELECT pair_id, 'missing_path' FROM visual_review WHERE {pathk("path_a")} IS NULL OR {pathk("path_b")} IS NULL
UNION ALL SELECT pair_id, 'self_pair' FROM visual_review WHERE {pathk("path_a")} = {pathk("path_b")}""",
    "repeated_digests": f"""WITH {REC} SELECT row_id, sha AS key, n FROM rec JOIN (SELECT sha, count(*) AS n FROM rec WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1) USING (sha)""",
    "catalog_differences": f"""WITH {REC}, a AS (SELECT path, min(sha) AS sha FROM rec GROUP BY path), b AS (SELECT path, min({ident("sha256")}) AS sha FROM image_quality GROUP BY path),
j AS (SELECT a.path IS NULL OR b.path IS NULL AS one, a.sha IS DISTINCT FROM b.sha AS d FROM a FULL JOIN b ON a.path = b.path)
SELECT CASE WHEN one THEN '*' ELSE 'sha' END AS "column", count(*) AS n FROM j WHERE one OR d GROUP BY ALL""",
    "index_cover": f"""WITH {REC} SELECT count(row_id) AS rows, count(DISTINCT row_id) AS distinct_rows, max(row_id) + 1 AS expected, count(row_id) = count(DISTINCT row_id) AND count(row_id) = max(row_id) + 1 AS complete FROM rec""",
    "unit_vectors": """SELECT vec_id, 'wrong_length' AS code FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT vec_id, 'not_unit' FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.001""",
}
