"""Plain SQL of the curation queries."""

from granaria.plans.common import PRINTS, QUAL, REC, ident, pathk

_CAM = "cam AS (SELECT DISTINCT * EXCLUDE (received_at) FROM camera_manifest)"
_SET = "('', 'UNKNOWN', 'NOT_AVAILABLE', 'UNASSIGNED', 'NONE')"
_LABELS = "['apple::fresh','apple::rotten','banana::fresh','banana::rotten','orange::fresh','orange::rotten','tomato::fresh','tomato::rotten']"
_SCREEN = r"(?i)^((?:(?:rotated_by_-?\d+(?:\.\d+)?|saltandpepper|translation|vertical_flip|horizontal_flip)_)*)(Screen\s+Shot\s+.+)$"
_NUM = r"(?i)^(fresh|rotten)(apple|banana|orange|tomato)\s*\(\d+\)$"


def kinds(frm: str) -> str:
    """CTE ``kinds``: rows of ``frm`` with family, kind, reason and agrees."""
    norm = "regexp_replace(lower(nfc_normalize(trim({x}))), '\\s+', ' ', 'g')"
    return rf"""st AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1') AS s FROM {frm}),
kk AS (SELECT *, regexp_matches(s, '{_SCREEN}') AS scr, regexp_matches(s, '(?i)^Banana__Healthy_augmented_\d+$') AS orp, regexp_matches(s, '{_NUM}') AS num, regexp_extract(s, '{_SCREEN}', 1) <> '' AS chg FROM st),
kinds AS (SELECT *, CASE WHEN scr THEN 'screen::' || {norm.format(x=f"regexp_extract(s, '{_SCREEN}', 2)")} WHEN orp THEN NULL WHEN num THEN 'numbered::' || {norm.format(x="s")} END AS family,
  CASE WHEN scr AND chg THEN 'offline_augmentation' WHEN scr THEN 'candidate_original' WHEN orp THEN 'offline_augmentation_unknown_parent' WHEN num THEN 'candidate_original' ELSE 'unrecognized_filename' END AS kind,
  CASE WHEN scr AND chg THEN 'offline_augmentation_known_parent' WHEN orp THEN 'offline_augmentation_parent_unknown' WHEN scr OR num THEN '' ELSE 'unrecognized_filename_needs_source_mapping' END AS reason,
  CASE WHEN num AND NOT scr THEN lower(regexp_extract(s, '{_NUM}', 1)) = status AND lower(regexp_extract(s, '{_NUM}', 2)) = fruit ELSE true END AS agrees FROM kk)"""


def ranked(groups: str, key: str = "grp") -> str:
    """CTE ``rk``: the stratified assignment of ``groups`` (key, stratum)."""
    return f"""o AS (SELECT {key}, stratum, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || stratum || ':' || {key}), {key}) AS r FROM {groups}),
cut AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(round(n * 0.6), 1), n - 2) ELSE 1 END AS t FROM o),
cut2 AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(round(n * 0.2), 1), n - t - 1) ELSE 0 END AS v FROM cut),
rk AS (SELECT {key}, stratum, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'val' ELSE 'test' END AS split FROM cut2)"""


_GROUPS = "groups_ AS (SELECT grp, array_to_string(list_sort(list(DISTINCT fruit || '::' || status)), '|') AS stratum FROM rec WHERE grp IS NOT NULL GROUP BY grp)"
_REACH = """hop(v, w) AS (SELECT DISTINCT v, v FROM edge UNION SELECT h.v, e.w FROM hop h JOIN edge e ON e.v = h.w), comp AS (SELECT v, min(w) AS root FROM hop GROUP BY v)"""
_PAIRS = f"""idp AS (SELECT path_k, min(row_id) AS row_id FROM rec WHERE path_k IS NOT NULL GROUP BY path_k),
prs AS (SELECT a.row_id AS a, b.row_id AS b FROM visual_review v JOIN idp a ON a.path_k = {pathk("v.path_a")} JOIN idp b ON b.path_k = {pathk("v.path_b")} WHERE v.action = 'keep_labels_and_coassign_group')"""
_COASSIGN = f"""WITH RECURSIVE {REC}, {_PAIRS}, g AS (SELECT row_id, coalesce(grp, '#' || row_id) AS grp, fruit || '::' || status AS label FROM rec),
heads AS (SELECT grp, min(row_id) AS head FROM g GROUP BY grp),
raw AS (SELECT head AS v, head AS w FROM heads UNION ALL SELECT ha.head, hb.head FROM prs JOIN g x ON x.row_id = a JOIN heads ha ON ha.grp = x.grp JOIN g y ON y.row_id = b JOIN heads hb ON hb.grp = y.grp),
edge AS (SELECT v, w FROM raw UNION SELECT w, v FROM raw), {_REACH},
j AS (SELECT g.row_id, g.grp, g.label, c.root AS component FROM g JOIN heads USING (grp) JOIN comp c ON c.v = heads.head),
per AS (SELECT component, count(DISTINCT label) AS labels, min(label) AS stratum FROM j GROUP BY component), pure AS (SELECT component, stratum FROM per WHERE labels = 1), {ranked("pure", "component")},
done AS (SELECT row_id, grp, j.component, coalesce(rk.split, 'train') AS split FROM j LEFT JOIN rk USING (component))"""
_PROV = f"""{REC}, {QUAL}, {_CAM}, base AS (SELECT r.*, q.pix FROM rec r LEFT JOIN qual q USING (path)),
inp AS (SELECT camera_id, path, fruit, status, decode_status, {ident("sha256")} AS sha, {ident("pixel_sha256")} AS pix, review_status = 'APPROVED' AND upper(trim(specimen_id)) NOT IN {_SET} AND upper(trim(session_id)) NOT IN {_SET} AS declared FROM cam),
{kinds("inp")}, bs AS (SELECT sha, max(row_id) AS b FROM base WHERE sha IS NOT NULL GROUP BY sha), bp AS (SELECT pix, min(row_id) AS b FROM base WHERE pix IS NOT NULL GROUP BY pix),
fs AS (SELECT sha, min((path, camera_id)) AS f FROM inp WHERE sha IS NOT NULL GROUP BY sha), fpx AS (SELECT pix, min((path, camera_id)) AS f FROM inp WHERE pix IS NOT NULL GROUP BY pix),
par AS (SELECT DISTINCT fruit, status, family FROM (WITH {kinds("base")} SELECT * FROM kinds) WHERE family IS NOT NULL AND kind = 'candidate_original'),
refs AS (SELECT k.camera_id, k.fruit, k.status, k.decode_status, k.declared, k.kind,
  coalesce('baseline:' || bs.b, CASE WHEN fs.f < (k.path, k.camera_id) THEN 'camera:' || fs.f[2] END) AS byte_reference, coalesce('baseline:' || bp.b, CASE WHEN fpx.f < (k.path, k.camera_id) THEN 'camera:' || fpx.f[2] END) AS pixel_reference, par.family IS NOT NULL AS parent
  FROM kinds k LEFT JOIN bs USING (sha) LEFT JOIN bp USING (pix) LEFT JOIN fs ON fs.sha = k.sha LEFT JOIN fpx ON fpx.pix = k.pix LEFT JOIN par ON par.fruit = k.fruit AND par.status = k.status AND par.family = k.family),
cls AS (SELECT *, CASE WHEN coalesce(decode_status <> 'OK', true) THEN 'corrupt' WHEN byte_reference IS NOT NULL OR pixel_reference IS NOT NULL THEN 'exact_duplicate' WHEN kind = 'offline_augmentation' AND parent THEN 'probable_augmentation' WHEN declared THEN 'probable_new_image' ELSE 'unknown' END AS category,
  CASE WHEN coalesce(decode_status <> 'OK', true) THEN 'decode_or_read_failed' WHEN byte_reference IS NOT NULL THEN 'sha256_exact_match' WHEN pixel_reference IS NOT NULL THEN 'decoded_rgb_pixels_exact_match' WHEN kind = 'offline_augmentation' AND parent THEN 'explicit_transform_filename_and_available_named_parent' WHEN declared THEN 'declared_source_and_label_evidence_require_human_review' ELSE 'insufficient_parent_or_independent_source_evidence' END AS reason FROM refs)"""

_MERGE = f"""{REC}, {_CAM}, c AS (SELECT camera_id, {ident("sha256")} AS sha, fruit, status, requested_split AS split, source FROM cam),
e AS (SELECT sha, fruit, status, part AS split, source FROM rec WHERE sha IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha ORDER BY row_id) = 1),
i AS (SELECT sha, fruit, status, split, source FROM c WHERE sha IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha ORDER BY camera_id) = 1),
g AS (SELECT sha, min(coalesce(fruit, '')) AS f0, max(coalesce(fruit, '')) AS f1, min(coalesce(status, '')) AS s0, max(coalesce(status, '')) AS s1 FROM c WHERE sha IS NOT NULL GROUP BY sha),
j AS (SELECT e, i, f0, f1, s0, s1, coalesce(f0 <> f1 OR s0 <> s1 OR coalesce(e.fruit <> f0, false) OR coalesce(e.status <> s0, false), false) AS bad FROM e FULL JOIN i ON e.sha = i.sha LEFT JOIN g ON g.sha = i.sha)"""

_FROZEN = f"""key_ AS (SELECT row_id, 'g' || grp AS k FROM rec WHERE grp IS NOT NULL UNION ALL SELECT row_id, 's' || sha FROM rec WHERE sha IS NOT NULL),
star AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS c FROM key_), raw AS (SELECT row_id AS v, c AS w FROM star WHERE row_id <> c), edge AS (SELECT v, w FROM raw UNION SELECT w, v FROM raw), {_REACH},
j AS (SELECT row_id, part, fruit || '::' || status AS label, coalesce(root, row_id) AS component FROM rec LEFT JOIN comp ON comp.v = row_id),
per AS (SELECT component, min(part) AS lo, max(part) AS hi, count(DISTINCT label) AS labels, min(label) AS stratum FROM j GROUP BY component)"""

SQL = {
    "label_split_counts": f"""WITH {REC} SELECT f AS fruit, s AS status, p AS part, (SELECT count(*) FROM rec WHERE fruit = f AND status = s AND coalesce(rec.part, '') = p) AS n
FROM (SELECT unnest(['apple','banana','orange','tomato']) AS f) CROSS JOIN (SELECT unnest(['fresh','rotten']) AS s) CROSS JOIN (SELECT unnest(['train','val','test','']) AS p)""",
    "missing_buckets": f"""WITH {REC}, r AS (SELECT lower(trim(source)) AS source, fruit || '::' || status AS label, part FROM rec)
SELECT s.source, l.label, p.part FROM (SELECT DISTINCT source FROM r WHERE source IS NOT NULL AND source <> '') s CROSS JOIN (SELECT unnest({_LABELS}) AS label) l CROSS JOIN (SELECT unnest(['train','val','test']) AS part) p ANTI JOIN r USING (source, label, part)""",
    "audit_counts": f"""WITH {REC}, {QUAL} SELECT count(*) AS records, count(DISTINCT sha) AS digests, count(DISTINCT grp) AS groups, count(DISTINCT path_k) AS paths, count(*) FILTER (part IS NULL) AS unassigned, count(*) FILTER (width IS NULL) AS unmeasured, count(*) FILTER (fp IS NULL) AS without_fingerprint,
min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height FROM rec LEFT JOIN qual USING (path)""",
    "quality_profile": f"""WITH {REC}, {QUAL}, l AS (SELECT fruit || '::' || status AS label, unnest(['width','height','brightness','blur_score']) AS measure, unnest([width::DOUBLE, height::DOUBLE, brightness, blur_score]) AS v FROM rec JOIN qual USING (path))
SELECT label, measure, count(v) AS n, round(min(v) + 1e-9, 6) AS min, round(quantile_cont(v, 0.1) + 1e-9, 6) AS p10, round(quantile_cont(v, 0.25) + 1e-9, 6) AS p25, round(quantile_cont(v, 0.5) + 1e-9, 6) AS p50, round(quantile_cont(v, 0.75) + 1e-9, 6) AS p75, round(quantile_cont(v, 0.9) + 1e-9, 6) AS p90, round(max(v) + 1e-9, 6) AS max, round(avg(v) + 1e-9, 6) AS mean
FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL""",
    "min_side_histogram": f"""WITH {REC}, {QUAL}, j AS (SELECT fruit, least(width, height) AS m FROM rec JOIN qual USING (path) WHERE width IS NOT NULL OR height IS NOT NULL), b AS (SELECT fruit, (m >= 96)::INT + (m >= 224)::INT + (m >= 512)::INT AS bin FROM j)
SELECT f.fruit, g.bin, (SELECT count(*) FROM b WHERE b.fruit = f.fruit AND b.bin = g.bin) AS n FROM (SELECT DISTINCT fruit FROM b) f CROSS JOIN (SELECT unnest(range(4))::INT AS bin) g""",
    "tag_counts": f"WITH {_CAM} SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(quality_flags, ';')) AS tag FROM cam) WHERE tag NOT IN ('', 'NONE') GROUP BY tag",
    "completeness": f"WITH {_CAM} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (upper(trim({c})) NOT IN {_SET}) AS filled, count(*) AS rows FROM cam" for c in ("group_id", "specimen_id", "session_id", "capture_device", "lighting", "review_status", "requested_split", "duplicate_of")
    ),
    "hard_case_tags": f"""WITH {_CAM}, t AS (SELECT camera_id, [CASE lighting WHEN 'lamp' THEN 'low_light' WHEN 'mixed' THEN 'uneven_lighting' WHEN 'normal' THEN 'normal' WHEN 'low_light' THEN 'low_light' WHEN 'dark' THEN 'low_light' WHEN 'overexposed' THEN 'overexposed' END,
 CASE WHEN contains(quality_flags, 'BLUR') THEN 'blurry' END, CASE WHEN contains(quality_flags, 'HIGH_BRIGHTNESS') THEN 'glare' END] AS a FROM cam)
SELECT camera_id, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x IS NOT NULL))), ';'), ''), 'UNKNOWN') AS tags FROM t""",
    "inventory_report": f"WITH {_CAM} SELECT coalesce(requested_split, 'UNKNOWN') || '/' || coalesce(fruit, 'UNKNOWN') || '/' || coalesce(status, 'UNKNOWN') AS bucket, count(*) AS n FROM cam GROUP BY ALL",
    "count_thresholds": f"WITH {_CAM}, c AS (SELECT fruit, status, source, {ident('sha256')} AS sha FROM cam) SELECT fruit, status, source, count(*) AS n, count(sha) - count(DISTINCT sha) AS extra_copies, count(*) >= 30 AS enough FROM c GROUP BY ALL",
    "db_group_summary": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
    "metric_melt": f"WITH {QUAL} SELECT path, 'brightness' AS variable, brightness AS value FROM qual UNION ALL SELECT path, 'blur_score', blur_score FROM qual",
    "json_matches": f"""WITH {_CAM}, m AS (SELECT camera_id, list_sort(TRY_CAST(TRY_CAST(perceptual_candidates AS JSON) AS STRUCT(distance INT, reference VARCHAR)[])) AS m FROM cam)
SELECT camera_id, len(m)::INT AS n, m[1].distance AS distance, m[1].reference AS reference FROM m WHERE len(m) > 0""",
    "event_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events) GROUP BY event_type",
    "quality_flags": f"""WITH {QUAL} SELECT path, coalesce(nullif(array_to_string(list_filter([CASE WHEN least(width, height) < 96 THEN 'TOO_SMALL' END, CASE WHEN brightness < 35 THEN 'DARK' END, CASE WHEN blur_score < 50 THEN 'BLUR_CANDIDATE' END, CASE WHEN width IS NULL THEN 'DECODE_ERROR' END, CASE WHEN brightness > 220 THEN 'HIGH_BRIGHTNESS_CANDIDATE' END], lambda x: x IS NOT NULL), ';'), ''), 'NONE') AS flags FROM qual""",
    "quality_verdicts": f"""WITH {QUAL}, r AS (SELECT path, list_filter([CASE WHEN least(width, height) < 100 THEN 'too_small' END, CASE WHEN blur_score < 100 THEN 'blurry' END, CASE WHEN brightness < 40 THEN 'too_dark' END, CASE WHEN brightness > 215 THEN 'too_bright' END], lambda x: x IS NOT NULL) AS a FROM qual WHERE width IS NOT NULL)
SELECT path, len(a) = 0 AS passed, coalesce(array_to_string(a, ';'), '') AS reasons FROM r""",
    "plain_gate": f"""WITH {QUAL} SELECT CASE WHEN width IS NULL OR least(width, height) < 32 THEN 'unusable' WHEN brightness < 18 THEN 'very_dark' WHEN brightness > 244 THEN 'very_bright' WHEN coalesce(blur_score, 0) < 1 THEN 'uniform' ELSE 'usable' END AS reason, count(*) AS n FROM qual GROUP BY ALL""",
    "dedup_keep_first": rf"""WITH {REC}, {QUAL}, j AS (SELECT row_id, pix, regexp_replace(lower(nfc_normalize(trim(path))), '\s+', ' ', 'g') AS n FROM rec JOIN qual USING (path) WHERE pix IS NOT NULL), f AS (SELECT pix, min((n, row_id)) AS m FROM j GROUP BY pix)
SELECT row_id, m[2] AS duplicate_of FROM j JOIN f USING (pix) WHERE row_id <> m[2]""",
    "first_seen_reference": f"""WITH {_CAM}, c AS (SELECT camera_id, batch_no, {ident("sha256")} AS sha FROM cam), f AS (SELECT sha, min((batch_no, camera_id)) AS m FROM c WHERE sha IS NOT NULL GROUP BY sha) SELECT camera_id, m[2] AS reference FROM c JOIN f USING (sha) WHERE camera_id <> m[2]""",
    "repeats_within_source": f"WITH {REC} SELECT source, sha, count(*) AS n FROM rec WHERE sha IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "first_per_class": f"WITH {REC} SELECT fruit, status, path, row_id FROM rec QUALIFY row_number() OVER (PARTITION BY fruit, status ORDER BY path, row_id) <= 5",
    "split_stratified": f"WITH {REC}, {_GROUPS}, {ranked('groups_')} SELECT * FROM rk",
    "split_hash": f"WITH {REC} SELECT DISTINCT grp, CASE WHEN ('0x' || sha256('42:' || grp)[1:16])::UBIGINT % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM rec WHERE grp IS NOT NULL",
    "component_group_hash": f"""WITH RECURSIVE {REC}, {QUAL}, b AS (SELECT r.*, q.pix FROM rec r LEFT JOIN qual q USING (path)), {kinds("b")},
key_ AS (SELECT row_id, 's' || sha AS k FROM kinds WHERE sha IS NOT NULL UNION ALL SELECT row_id, 'p' || pix FROM kinds WHERE pix IS NOT NULL UNION ALL SELECT row_id, 'f' || family FROM kinds WHERE family IS NOT NULL),
star AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS c FROM key_), raw AS (SELECT row_id AS v, c AS w FROM star WHERE row_id <> c), edge AS (SELECT v, w FROM raw UNION SELECT w, v FROM raw), {_REACH},
j AS (SELECT row_id, path_k, coalesce(root, row_id) AS component FROM rec LEFT JOIN comp ON comp.v = row_id), h AS (SELECT component, 'v2_' || sha256(string_agg(path_k, chr(10) ORDER BY path_k))[1:32] AS group_hash FROM j GROUP BY component) SELECT row_id, component, group_hash FROM j JOIN h USING (component)""",
    "component_ids": f"""WITH RECURSIVE {PRINTS}, f AS (SELECT DISTINCT fp FROM fps WHERE fp IS NOT NULL), edge AS (SELECT a.fp AS v, b.fp AS w FROM f a JOIN f b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 4), {_REACH} SELECT v AS fp, root FROM comp""",
    "coassign_split": f"{_COASSIGN} SELECT row_id, component, split FROM done",
    "freeze_and_extend": f"""WITH RECURSIVE {REC}, {_FROZEN}, fresh AS (SELECT component, stratum FROM per WHERE lo IS NULL AND labels = 1), {ranked("fresh", "component")}
SELECT j.row_id, j.component, CASE WHEN lo = hi THEN lo WHEN lo IS NULL THEN coalesce(rk.split, 'train') END AS split, coalesce(lo <> hi, false) AS conflict FROM j JOIN per USING (component) LEFT JOIN rk USING (component)""",
    "freeze_groups": f"""WITH RECURSIVE {REC}, {_FROZEN} SELECT row_id, component, CASE WHEN lo = hi THEN lo WHEN lo IS NULL THEN 'train' END AS split, coalesce(lo <> hi, false) AS conflict FROM j JOIN per USING (component)""",
    "reviewed_split": f"""WITH RECURSIVE {REC}, {QUAL}, {_CAM},
al AS (SELECT DISTINCT camera_id + 1000000000 AS id, false AS base, NULL::VARCHAR AS part, {ident("requested_split")} AS req, {ident("group_id")} AS grp, {ident("sha256")} AS sha, {ident("pixel_sha256")} AS pix, CASE WHEN upper(trim(specimen_id)) NOT IN {_SET} THEN specimen_id END AS spec FROM cam
 UNION ALL SELECT r.row_id, true, r.part, NULL, r.grp, r.sha, q.pix, NULL FROM rec r LEFT JOIN qual q USING (path)),
key_ AS (SELECT id, 'g' || grp AS k FROM al WHERE grp IS NOT NULL UNION ALL SELECT id, 's' || sha FROM al WHERE sha IS NOT NULL UNION ALL SELECT id, 'p' || pix FROM al WHERE pix IS NOT NULL UNION ALL SELECT id, 'm' || spec FROM al WHERE spec IS NOT NULL),
star AS (SELECT id, min(id) OVER (PARTITION BY k) AS c FROM key_), raw AS (SELECT id AS v, c AS w FROM star WHERE id <> c), edge AS (SELECT v, w FROM raw UNION SELECT w, v FROM raw), {_REACH},
j AS (SELECT al.*, coalesce(root, id) AS component FROM al LEFT JOIN comp ON comp.v = id),
per AS (SELECT component, min(CASE WHEN base THEN part WHEN req IN ('train', 'val') THEN req END) AS lo, max(CASE WHEN base THEN part WHEN req IN ('train', 'val') THEN req END) AS hi, coalesce(bool_or(base AND part = 'test'), false) AS test, bool_or(NOT base) AS fresh, coalesce(min(grp), component::VARCHAR) AS g FROM j GROUP BY component),
o AS (SELECT component, CASE WHEN lo <> hi THEN 'crosses_splits' WHEN test AND fresh THEN 'touches_test' END AS problem, coalesce(lo, CASE WHEN ('0x' || sha256('42:' || g)[1:16])::UBIGINT % 5 = 0 THEN 'val' ELSE 'train' END) AS s FROM per)
SELECT id, CASE WHEN problem IS NULL THEN s END AS split, problem FROM j JOIN o USING (component) WHERE NOT base""",
    "best_epoch": """WITH RECURSIVE d0 AS (SELECT event_type, date_diff('day', DATE '2020-01-01', ts::DATE) AS step, round(avg(value), 6) AS score, round(max(value), 6) AS loss FROM events GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS rn FROM d0),
f(event_type, rn, best_step, best, tie, bad, stop) AS (SELECT DISTINCT event_type, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, 0, NULL::BIGINT FROM d
 UNION ALL SELECT f.event_type, d.rn, CASE WHEN stop IS NULL AND b THEN step ELSE best_step END, CASE WHEN stop IS NULL AND b THEN score ELSE best END, CASE WHEN stop IS NULL AND b THEN loss ELSE tie END,
  CASE WHEN stop IS NOT NULL THEN bad WHEN b THEN 0 ELSE bad + 1 END, CASE WHEN stop IS NULL AND NOT b AND bad + 1 >= 5 THEN step ELSE stop END
  FROM f JOIN d ON d.event_type = f.event_type AND d.rn = f.rn + 1, LATERAL (SELECT best IS NULL OR score > best + 1e-6 OR (abs(score - best) <= 1e-6 AND loss < tie) AS b))
SELECT event_type, best_step, best AS best_value, stop AS stopped_at FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY rn DESC) = 1""",
    "cross_group_pairs": f"""WITH {REC}, fps AS (SELECT DISTINCT path, TRY_CAST('0x' || {ident("phash63")} AS BIGINT) AS fp, {ident("pixel_sha256")} AS pix FROM image_quality),
r AS (SELECT row_id, path_k, coalesce(grp, '#' || row_id) AS grp, fp, pix FROM rec JOIN fps USING (path)), first AS (SELECT pix, min((path_k, row_id)) AS m FROM r WHERE pix IS NOT NULL GROUP BY pix),
kept AS (SELECT DISTINCT row_id, path_k, grp, fp FROM r LEFT JOIN first USING (pix) WHERE fp IS NOT NULL AND (m IS NULL OR m = (path_k, row_id)))
SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, min(bit_count(xor(a.fp, b.fp))) AS distance FROM kept a JOIN kept b ON a.grp <> b.grp AND (a.path_k, a.row_id) < (b.path_k, b.row_id) AND bit_count(xor(a.fp, b.fp)) <= 4 GROUP BY ALL""",
    "merge_report": f"""{_COASSIGN}, p AS (SELECT component, grp, count(*) AS n FROM done GROUP BY ALL), q AS (SELECT component, count(*) AS olds, sum(n) AS size FROM p GROUP BY component), og AS (SELECT grp, count(*) AS news FROM p GROUP BY grp)
SELECT (SELECT count(*) FROM q) AS new_groups, (SELECT count(*) FROM q WHERE olds > 1) AS merged_components, (SELECT max(size)::BIGINT FROM q) AS largest, (SELECT count(*) FROM og) AS old_groups, (SELECT count(*) FROM og WHERE news > 1) AS split_old_groups""",
    "filename_kinds": f"WITH {REC}, {kinds('rec')} SELECT kind, reason, agrees, count(*) AS n FROM kinds GROUP BY ALL",
    "filename_families": f"""WITH {REC}, {kinds("rec")}, f AS (SELECT family, count(*) AS n, count(DISTINCT coalesce(part, '')) AS splits, count(*) FILTER (kind = 'candidate_original') AS orig FROM kinds WHERE family LIKE 'screen::%' GROUP BY family)
SELECT count(*) AS families, count(*) FILTER (splits > 1) AS families_across, coalesce(sum(n) FILTER (splits > 1), 0)::BIGINT AS rows_across, count(*) FILTER (orig = 0) AS without_original FROM f""",
    "parent_families": f"""WITH {REC}, {_CAM}, {kinds("cam")}, b AS (WITH {kinds("rec")} SELECT fruit, status, family, count(*) AS parents, coalesce(array_to_string(list_sort(list(DISTINCT part) FILTER (part IS NOT NULL)), ';'), '') AS splits FROM kinds WHERE family IS NOT NULL AND kind = 'candidate_original' GROUP BY ALL)
SELECT camera_id, parents, splits FROM kinds JOIN b USING (fruit, status, family)""",
    "provenance_classes": f"WITH {_PROV} SELECT camera_id, category, reason, byte_reference, pixel_reference FROM cls",
    "provenance_report": f"WITH {_PROV} SELECT category, reason, fruit, status, count(*) AS n FROM cls GROUP BY ALL",
    "upsert_merge": f"""WITH {_MERGE} SELECT coalesce(e.sha, i.sha) AS sha, CASE WHEN bad THEN e.fruit ELSE coalesce(i.fruit, e.fruit) END AS fruit, CASE WHEN bad THEN e.status ELSE coalesce(i.status, e.status) END AS status,
CASE WHEN e.sha IS NULL THEN i.split ELSE e.split END AS split, CASE WHEN bad THEN e.source ELSE coalesce(e.source, i.source) END AS source,
CASE WHEN bad THEN 'conflict' WHEN e.sha IS NULL THEN 'inserted' WHEN i.sha IS NOT NULL THEN 'updated' ELSE 'kept' END AS action FROM j WHERE NOT (bad AND e.sha IS NULL)""",
    "upsert_conflicts": f"""WITH {_MERGE} SELECT i.sha AS sha, 'fruit' AS column_name, e.fruit AS existing, f0 AS least, f1 AS greatest FROM j WHERE bad AND (f0 <> f1 OR e.fruit <> f0)
UNION ALL SELECT i.sha, 'status', e.status, s0, s1 FROM j WHERE bad AND (s0 <> s1 OR e.status <> s0)""",
    "version_record": f"WITH {REC} SELECT 'v1' AS version, coalesce(part, 'UNASSIGNED') || '/' || fruit || '/' || status AS bucket, count(*) AS n FROM rec GROUP BY ALL",
    "group_split_update": f"WITH {REC}, {_GROUPS}, {ranked('groups_')} SELECT row_id, rec.grp, coalesce(rk.split, part) AS split FROM rec LEFT JOIN rk ON rk.grp = rec.grp",
    "union_counts": f"""WITH {REC}, {_CAM} SELECT 'manifest' AS origin, fruit, status, count(*) AS n, count(part) AS with_split, 0 AS batches FROM rec GROUP BY ALL UNION ALL SELECT 'camera', fruit, status, count(*), 0, count(DISTINCT batch_no) FROM cam GROUP BY ALL""",
    "content_hashes": rf"""WITH {REC} SELECT row_id, sha256('{{"fruit":"' || fruit || '","status":"' || status || '"}}') AS label_hash, (lpad(row_id::VARCHAR, greatest(6, length(row_id::VARCHAR))::INT, '0') || '_' || regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g'))[1:180] AS file_name FROM rec""",
    "path_parts": r"""WITH rec AS (SELECT DISTINCT row_id, path, replace(path, '\', '/') AS p FROM manifest), s AS (SELECT *, string_split(p, '/') AS a FROM rec)
SELECT row_id, coalesce(p <> '' AND NOT starts_with(p, '/') AND NOT contains(p, ':') AND NOT contains(p, chr(0)) AND NOT list_contains(a, '..'), false) AS safe,
 CASE WHEN len(a) > 1 AND lower(a[1]) = 'raw' THEN array_to_string(a[2:], '/') END AS below_raw,
 CASE WHEN a[-3] IN ('apple','banana','orange','tomato') AND a[-2] IN ('fresh','rotten') THEN a[-3] END AS folder_fruit, CASE WHEN a[-3] IN ('apple','banana','orange','tomato') AND a[-2] IN ('fresh','rotten') THEN a[-2] END AS folder_status,
 regexp_extract(p, '([^/.]*)(?:\.[^/]*)?$', 1) AS asset FROM s""",
}
