"""Queries of the general data problems: column profile (p1) and strict load (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.operators.column_profile import Checks, Profile, profile
from granaria.operators.strict_load import strict_load
from granaria.session import table

# Valid ranges and words of image_quality.
QUALITY = Checks(
    numeric={"brightness": (0.0, 255.0), "blur_score": (0.0, None), "width": (1.0, 20000.0)},
    words={"decode_status": ("OK", "MISSING_FILE", "READ_ERROR", "DECODE_ERROR", "NOT_AVAILABLE")},
)


def _profile(spark: SparkSession, sf: str) -> Profile:
    return profile(table(spark, sf, "image_quality"), "load_id", QUALITY)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).findings


def p1_profile(spark: SparkSession, sf: str) -> DataFrame:
    s = _profile(spark, sf).stats
    # the nudge takes interpolated values off the rounding edge, where engines differ
    q = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("q10", "q25", "q50", "q75", "q90")]
    return s.select("load_id", "column_name", "rows", "nulls", "invalid", "valid", "distinct_values", "min_value", "max_value", *q)


def p1_drift(spark: SparkSession, sf: str) -> DataFrame:
    """What changed since the load before: null share, median, exact Kolmogorov-Smirnov distance, greatest shift of a word."""
    shown = ("null_share_change", "median", "prev_median", "ks_distance", "share_shift")
    return _profile(spark, sf).drift.select("load_id", "column_name", "prev_load_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in shown], "nulls_moved", "drifted")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return strict_load(table(spark, sf, "manifest_lines")).rejected.select("line_id", "reason")


def p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    return strict_load(table(spark, sf, "manifest_lines")).rows


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_drift": p1_drift, "p4_found": p4_found, "p4_rows": p4_rows}

_LONG = """
vals AS (
  SELECT load_id, 'brightness' AS column_name, brightness::DOUBLE AS v, brightness IS NULL AS missing, NOT isnan(brightness) AND brightness BETWEEN 0 AND 255 AS ok FROM image_quality
  UNION ALL SELECT load_id, 'blur_score', blur_score, blur_score IS NULL, NOT isnan(blur_score) AND blur_score >= 0 FROM image_quality
  UNION ALL SELECT load_id, 'width', width::DOUBLE, width IS NULL, width BETWEEN 1 AND 20000 FROM image_quality
  UNION ALL SELECT load_id, 'decode_status', NULL, decode_status IS NULL, decode_status IN ('OK','MISSING_FILE','READ_ERROR','DECODE_ERROR','NOT_AVAILABLE') FROM image_quality
),
loads AS (SELECT load_id, lag(load_id) OVER (ORDER BY load_id) AS prev_load_id FROM (SELECT DISTINCT load_id FROM image_quality)),
stats AS (
  SELECT load_id, column_name, count(*) AS n_rows, count(*) FILTER (missing) AS nulls, count(*) FILTER (NOT missing AND NOT ok) AS invalid, count(*) FILTER (ok AND NOT missing) AS valid,
         median(v) FILTER (ok) AS med
  FROM vals GROUP BY ALL
),
words AS (SELECT load_id, decode_status AS word, count(*) AS n FROM image_quality WHERE decode_status IS NOT NULL GROUP BY ALL),
moved AS (
  SELECT l.load_id, max(abs(coalesce(a.n, 0) / (s.n_rows - s.nulls)::DOUBLE - coalesce(b.n, 0) / (p.n_rows - p.nulls)::DOUBLE)) AS shift
  FROM loads l
  JOIN stats s ON s.load_id = l.load_id AND s.column_name = 'decode_status'
  JOIN stats p ON p.load_id = l.prev_load_id AND p.column_name = 'decode_status'
  CROSS JOIN (SELECT DISTINCT word FROM words) w
  LEFT JOIN words a ON a.load_id = l.load_id AND a.word = w.word
  LEFT JOIN words b ON b.load_id = l.prev_load_id AND b.word = w.word
  GROUP BY ALL
)
"""

_RECORDS = r"""WITH rec AS (SELECT line_id, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^' || chr(65279), ''), chr(13) || '$', '') AS r FROM manifest_lines),
q AS (SELECT line_id, r, regexp_full_match(r, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted FROM rec),
f AS (SELECT line_id, quoted, CASE WHEN quoted THEN list_transform(regexp_extract_all(',' || r, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, chr(32) || chr(9) || chr(10) || chr(13))) END AS f FROM q),
c AS (SELECT line_id, quoted, len(f) = 7 AS seven,
  f[1] <> '' AND f[2] IN ('apple','banana','orange','tomato') AND f[3] IN ('fresh','rotten') AND f[4] <> '' AND f[5] <> '' AND regexp_full_match(f[6], '[0-9a-f]{64}') AND f[7] IN ('train','val','test','')
  AND NOT starts_with(replace(f[1], '\', '/'), '/') AND NOT list_contains(string_split(replace(f[1], '\', '/'), '/'), '..') AND NOT contains(f[1], ':') AND NOT contains(f[1], chr(0)) AS good FROM f)
"""

SQL = {
    "p1_found": f"""WITH {_LONG}
SELECT load_id, column_name, CASE WHEN column_name = 'decode_status' THEN 'pattern' ELSE 'range' END AS finding FROM stats WHERE invalid * 50 > n_rows - nulls
UNION ALL
SELECT s.load_id, s.column_name, 'nulls' FROM loads l JOIN stats s USING (load_id) JOIN stats p ON p.load_id = l.prev_load_id AND p.column_name = s.column_name
WHERE abs(s.nulls * p.n_rows - p.nulls * s.n_rows) * 10 > s.n_rows * p.n_rows
UNION ALL
SELECT s.load_id, s.column_name, 'drift' FROM loads l JOIN stats s USING (load_id) JOIN stats p ON p.load_id = l.prev_load_id AND p.column_name = s.column_name
WHERE s.med * 3 < p.med * 2 OR s.med * 2 > p.med * 3
UNION ALL
SELECT load_id, 'decode_status', 'drift' FROM moved WHERE shift > 0.1""",
    "p1_profile": f"""WITH {_LONG}
SELECT load_id, column_name, count(*) AS rows, count(*) FILTER (missing) AS nulls, count(*) FILTER (NOT missing AND NOT ok) AS invalid, count(*) FILTER (ok AND NOT missing) AS valid,
  CASE WHEN column_name = 'decode_status' THEN max(n) ELSE count(DISTINCT v) FILTER (ok) END AS distinct_values,
  min(v) FILTER (ok) AS min_value, max(v) FILTER (ok) AS max_value,
  round(quantile_cont(v, 0.1) FILTER (ok) + 1e-9, 6) AS q10, round(quantile_cont(v, 0.25) FILTER (ok) + 1e-9, 6) AS q25, round(quantile_cont(v, 0.5) FILTER (ok) + 1e-9, 6) AS q50, round(quantile_cont(v, 0.75) FILTER (ok) + 1e-9, 6) AS q75, round(quantile_cont(v, 0.9) FILTER (ok) + 1e-9, 6) AS q90
FROM vals LEFT JOIN (SELECT load_id, count(*) AS n FROM words GROUP BY ALL) USING (load_id) GROUP BY load_id, column_name""",
    "p1_drift": f"""WITH {_LONG}, pairs AS (SELECT l.load_id, l.prev_load_id, c AS column_name FROM loads l CROSS JOIN (SELECT unnest(['brightness', 'blur_score', 'width', 'decode_status']) AS c) WHERE l.prev_load_id IS NOT NULL),
steps AS (SELECT p.load_id, p.column_name, s.v, (s.load_id = p.load_id)::INT AS a, (s.load_id = p.prev_load_id)::INT AS b FROM pairs p JOIN vals s ON s.column_name = p.column_name AND s.load_id IN (p.load_id, p.prev_load_id) WHERE s.ok AND s.v IS NOT NULL),
per AS (SELECT load_id, column_name, v, sum(a) AS a, sum(b) AS b FROM steps GROUP BY ALL),
cum AS (SELECT load_id, column_name, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER x AS na, sum(b) OVER x AS nb FROM per WINDOW w AS (PARTITION BY load_id, column_name ORDER BY v), x AS (PARTITION BY load_id, column_name)),
ks AS (SELECT load_id, column_name, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS d FROM cum WHERE na > 0 AND nb > 0 GROUP BY ALL)
SELECT p.load_id, p.column_name, p.prev_load_id, round(s.nulls / s.n_rows::DOUBLE - q.nulls / q.n_rows::DOUBLE + 1e-9, 6) AS null_share_change, round(s.med + 1e-9, 6) AS median, round(q.med + 1e-9, 6) AS prev_median, round(d + 1e-9, 6) AS ks_distance,
  CASE WHEN p.column_name = 'decode_status' THEN round(shift + 1e-9, 6) END AS share_shift, abs(s.nulls * q.n_rows - q.nulls * s.n_rows) * 10 > s.n_rows * q.n_rows AS nulls_moved,
  CASE WHEN p.column_name = 'decode_status' THEN coalesce(shift > 0.1, false) ELSE coalesce(s.med * 3 < q.med * 2 OR s.med * 2 > q.med * 3, false) END AS drifted
FROM pairs p JOIN stats s ON s.load_id = p.load_id AND s.column_name = p.column_name JOIN stats q ON q.load_id = p.prev_load_id AND q.column_name = p.column_name
LEFT JOIN ks ON ks.load_id = p.load_id AND ks.column_name = p.column_name LEFT JOIN moved m ON m.load_id = p.load_id""",
    "p4_found": _RECORDS + r"""SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT seven THEN 'columns' ELSE 'value' END AS reason FROM c WHERE NOT quoted OR NOT seven OR NOT good""",
    "p4_rows": _RECORDS.replace("good FROM f)", "good, f FROM f)") + """SELECT line_id, f[1] AS path, f[2] AS fruit, f[3] AS status, f[4] AS source, f[5] AS group_id, f[6] AS sha256, nullif(f[7], '') AS split FROM c WHERE quoted AND seven AND good""",
}
