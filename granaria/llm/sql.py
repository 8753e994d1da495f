"""Plain SQL for the queries that SQL can express, to be run by DuckDB on the same tables."""

_IDENT = "nullif(nullif(nullif(lower(nfc_normalize(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))), ''), 'unknown'), 'not_available')"
_PATH = "nullif(lower(nfc_normalize(replace(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '\\', '/'))), '')"


def ident(c: str) -> str:
    return _IDENT.format(c=c)


_PRINTS = f"""
prints AS (
  SELECT DISTINCT m.row_id, {ident("m.split")} AS split, m.source, {ident("m.sha256")} AS sha, {ident("q.pixel_sha256")} AS pix, TRY_CAST('0x' || {ident("q.phash63")} AS BIGINT) AS fp
  FROM manifest m LEFT JOIN image_quality q ON q.path = m.path
),
train AS (SELECT * FROM prints WHERE split = 'train'),
other AS (SELECT * FROM prints WHERE split IN ('val', 'test')),
kinds AS (
  SELECT t.row_id AS x, o.row_id AS y, o.split, o.source, 'bytes' AS kind FROM train t JOIN other o ON t.sha = o.sha
  UNION SELECT t.row_id, o.row_id, o.split, o.source, 'pixels' FROM train t JOIN other o ON t.pix = o.pix
  UNION SELECT t.row_id, o.row_id, o.split, o.source, 'near' FROM train t JOIN other o ON bit_count(xor(t.fp, o.fp)) <= 4
)
"""

_HYPHEN = r"""regexp_replace({c}, '([\pL\pN])[\x{{2010}}-\x{{2015}}\x{{2212}}-](?:[ \t]*\r?\n[ \t]*(?:[>*|#+-]+[ \t]*)?)?([\pL\pN])', '\1\2', 'g')"""
_PLAIN = r"""trim(regexp_replace({c}, '[^\pL\pN]+', ' ', 'g'))"""
_TEXT = r"""regexp_replace(translate(strip_accents(lower(nfc_normalize({c}))), 'đ', 'd'), '</?[a-z][^<>]*>', '', 'g')"""


def words(c: str) -> str:
    """Normalised words as a list; hyphens are joined twice, since matches of one pass don't overlap."""
    joined = _HYPHEN.format(c=_HYPHEN.format(c=_TEXT.format(c=c)))
    return f"string_split({_PLAIN.format(c=joined)}, ' ')"


_ADMITTED = f"""WITH RECURSIVE base AS MATERIALIZED (SELECT DISTINCT {ident("m.sha256")} AS sha, {ident("q.pixel_sha256")} AS pix, TRY_CAST('0x' || {ident("q.phash63")} AS BIGINT) AS fp FROM manifest m LEFT JOIN image_quality q ON q.path = m.path),
cam AS MATERIALIZED (SELECT DISTINCT camera_id AS id, batch_no AS b, {ident("sha256")} AS sha, {ident("pixel_sha256")} AS pix, TRY_CAST('0x' || {ident("phash63")} AS BIGINT) AS fp FROM camera_manifest),
old AS MATERIALIZED (SELECT id FROM cam JOIN base USING (sha) UNION SELECT id FROM cam JOIN base USING (pix) UNION SELECT c.id FROM cam c JOIN base x ON bit_count(xor(c.fp, x.fp)) <= 4),
rest AS MATERIALIZED (SELECT * FROM cam ANTI JOIN old USING (id)),
edge AS MATERIALIZED (SELECT l.id AS late, e.id AS early FROM rest l JOIN rest e ON e.b < l.b AND (l.sha = e.sha OR l.pix = e.pix OR bit_count(xor(l.fp, e.fp)) <= 4)),
walk(b, acc) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.b + 1, list_concat(w.acc, coalesce((SELECT list(r.id) FROM rest r WHERE r.b = w.b + 1 AND r.id NOT IN (SELECT late FROM edge WHERE list_contains(w.acc, early))), []::BIGINT[])) FROM walk w WHERE w.b < (SELECT max(b) FROM cam)),
accepted AS (SELECT unnest(acc) AS id FROM (SELECT acc FROM walk ORDER BY b DESC LIMIT 1))
"""
_LEAKS = f"""WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents), i AS (SELECT item_id, {words("text")} AS w FROM eval_items),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS t(p)),
it AS (SELECT item_id, len(w) AS n, p, array_to_string(w[p:p + 7], ' ') AS s FROM i, unnest(range(1, len(w) - 6)) AS t(p)),
hit AS (SELECT DISTINCT doc_id, item_id, n, p + k AS word FROM it JOIN ds USING (s), unnest(range(8)) AS t(k))"""
_SOURCE = r"nullif(regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g'), '')"

SQL = {
    "p3_found": f"""SELECT min(row_id) AS first_row_id FROM (SELECT row_id, {ident("group_id")} AS g, {ident("split")} AS s FROM manifest)
WHERE g IS NOT NULL GROUP BY g HAVING count(DISTINCT s) FILTER (s IN ('train', 'val', 'test')) >= 2""",
    "p3_invariants": """SELECT s.stratum, t.split, s.n AS stratum_records, true AS on_target, true AS whole_components
FROM (SELECT concat_ws('/', fruit, status) AS stratum, count(DISTINCT row_id) AS n FROM manifest GROUP BY ALL) s CROSS JOIN split_targets t""",
    "p5_found": f"WITH {_PRINTS} SELECT DISTINCT least(x, y) AS row_id_a, greatest(x, y) AS row_id_b FROM kinds WHERE x <> y",
    "p5_records": f"""WITH {_PRINTS} SELECT y AS row_id, split, source, count(*) FILTER (kind = 'bytes') AS same_bytes, count(*) FILTER (kind = 'pixels') AS same_pixels, count(*) FILTER (kind = 'near') AS near
FROM kinds GROUP BY ALL""",
    "p6_found": f"""WITH RECURSIVE ids AS (SELECT {_PATH.format(c="path")} AS k, min(row_id) AS row_id FROM manifest GROUP BY ALL),
links AS (SELECT a.row_id AS a, b.row_id AS b FROM visual_review v JOIN ids a ON a.k = {_PATH.format(c="v.path_a")} JOIN ids b ON b.k = {_PATH.format(c="v.path_b")} WHERE a.row_id <> b.row_id),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, w) AS (SELECT a, a FROM sym UNION SELECT r.v, s.b FROM reach r JOIN sym s ON s.a = r.w)
SELECT min(w) AS group_row_id, v AS row_id FROM reach GROUP BY v""",
    "p5_report": f"""WITH {_PRINTS}, r AS (SELECT y, split, source, count(*) FILTER (kind = 'bytes') AS b, count(*) FILTER (kind = 'pixels') AS p, count(*) FILTER (kind = 'near') AS n FROM kinds GROUP BY ALL)
SELECT split, source, count(*) AS records, count(*) FILTER (b > 0) AS same_bytes_records, count(*) FILTER (p > 0) AS same_pixels_records, count(*) FILTER (n > 0) AS near_records,
sum(b)::BIGINT AS same_bytes_links, sum(p)::BIGINT AS same_pixels_links, sum(n)::BIGINT AS near_links FROM r GROUP BY ALL""",
    "p7_found": f"""{_LEAKS} SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, n HAVING count(*) * 2 >= n""",
    "p2_found": f"""{_ADMITTED}SELECT DISTINCT id AS camera_id FROM cam ANTI JOIN accepted USING (id)""",
    "p2_batches": f"""{_ADMITTED}, c AS (SELECT DISTINCT id, b FROM cam) SELECT b AS batch_no, count(*) AS records, count(*) FILTER (id IN (SELECT id FROM accepted)) AS new_records, count(*) FILTER (id IN (SELECT id FROM old)) AS in_history,
count(*) FILTER (id NOT IN (SELECT id FROM accepted) AND id NOT IN (SELECT id FROM old)) AS in_earlier_batch FROM c GROUP BY b""",
    "p7_report": f"""{_LEAKS}, per AS (SELECT doc_id, item_id, count(*) AS covered, n FROM hit GROUP BY doc_id, item_id, n HAVING count(*) * 2 >= n)
SELECT item_id, test_set, lang, count(*) AS documents, max(covered / n::DOUBLE) AS most FROM per JOIN eval_items USING (item_id) GROUP BY ALL""",
    "p8_invariants": f"""WITH t AS (SELECT {_SOURCE} AS source, max_repeats FROM mix_targets), d AS (SELECT DISTINCT {_SOURCE} AS source FROM documents WHERE coalesce(text, '') <> '')
SELECT t.source, max_repeats, d.source IS NOT NULL AS has_documents, true AS near_target, true AS within_repeats, true AS sums_agree FROM t LEFT JOIN d ON d.source = t.source WHERE t.source IS NOT NULL""",
}
