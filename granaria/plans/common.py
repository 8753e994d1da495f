"""Frames and SQL fragments that several query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.functions.paths import CLASSES
from granaria.functions.vectors import softmax
from granaria.operators.identity import records
from granaria.session import table

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"


def ident(c: str) -> str:
    return f"nullif(nullif(nullif(lower(nfc_normalize(trim({c}, {_BLANKS}))), ''), 'unknown'), 'not_available')"


def pathk(c: str) -> str:
    return f"nullif(lower(nfc_normalize(replace(trim({c}, {_BLANKS}), '\\', '/'))), '')"


REC = f"""rec AS (SELECT DISTINCT row_id, path, fruit, status, source, {pathk("path")} AS path_k, {ident("sha256")} AS sha, {ident("group_id")} AS grp, {ident("split")} AS part FROM manifest)"""

QUAL = f"""qual AS (SELECT path, arg_max(width, (inspected_at, load_id)) AS width, arg_max(height, (inspected_at, load_id)) AS height,
  arg_max(CASE WHEN NOT isnan(brightness) THEN brightness END, (inspected_at, load_id)) AS brightness, arg_max(CASE WHEN NOT isnan(blur_score) THEN blur_score END, (inspected_at, load_id)) AS blur_score,
  max({ident("pixel_sha256")}) AS pix, max(TRY_CAST('0x' || {ident("phash63")} AS BIGINT)) AS fp FROM image_quality GROUP BY path)"""


#: Every fingerprint of a path, however often it was inspected.
PRINTS = f"""fps AS (SELECT DISTINCT path, TRY_CAST('0x' || {ident("phash63")} AS BIGINT) AS fp FROM image_quality)"""


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """(path, fp) of every fingerprint that an inspection of a path gave."""
    from granaria.functions.bits import parse_hex63
    from granaria.functions.text import identity

    return table(spark, sf, "image_quality").select("path", parse_hex63(identity(F.col("phash63"))).alias("fp")).where("fp is not null").distinct()


def rec(spark: SparkSession, sf: str) -> DataFrame:
    return records(table(spark, sf, "manifest"))


def quality(spark: SparkSession, sf: str) -> DataFrame:
    """One row per path: the latest measure of each kind that is a number, and its greatest fingerprint."""
    from granaria.functions.bits import parse_hex63
    from granaria.functions.text import identity

    order = F.struct("inspected_at", "load_id")
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    latest = lambda c: F.max_by(c, F.when(number(c), order)).alias(c)
    rows = table(spark, sf, "image_quality").select(
        "path", "width", "height", "brightness", "blur_score", "inspected_at", "load_id",
        identity(F.col("pixel_sha256")).alias("pix"), parse_hex63(identity(F.col("phash63"))).alias("fp"),
    )
    return rows.groupBy("path").agg(*[latest(c) for c in ("width", "height", "brightness", "blur_score")], F.max("pix").alias("pix"), F.max("fp").alias("fp"))


# ---- predictions: the embeddings table seen as a classifier's output over eight known classes and two unknown ones

UNKNOWN_FROM = 8
PRED = """emb AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS z, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
expd AS (SELECT *, list_transform(z, lambda x: exp(20 * x - list_max(list_transform(z, lambda y: 20 * y)))) AS e FROM emb),
probs AS (SELECT vec_id, label, v, list_transform(e, lambda x: x / list_sum(e)) AS p FROM expd),
fr AS (SELECT *, [p[1] + p[2], p[3] + p[4], p[5] + p[6], p[7] + p[8]] AS fp FROM probs),
dec AS (SELECT *, list_position(fp, list_max(fp)) - 1 AS fi FROM fr),
pred AS (SELECT *, CASE WHEN p[fi * 2 + 1] >= p[fi * 2 + 2] THEN 0 ELSE 1 END AS si, label < 8 AS known, (label // 2) % 4 AS true_fi, label % 2 AS true_si FROM dec),
named AS (SELECT *, ['apple','banana','orange','tomato'][fi + 1] AS fruit, ['fresh','rotten'][si + 1] AS condition,
  CASE WHEN known THEN ['apple','banana','orange','tomato'][true_fi + 1] END AS true_fruit, CASE WHEN known THEN ['fresh','rotten'][true_si + 1] END AS true_condition,
  list_max(p) AS joint_max, p[fi * 2 + si + 1] AS joint_confidence, vec_id % 7 <> 0 AS quality_passed, fp[fi + 1] >= 0.5 AS gate_supported FROM pred),
rows_ AS (SELECT *, fruit || '::' || condition AS joint_class, true_fruit || '::' || true_condition AS true_joint, quality_passed AND gate_supported AS supported,
  CASE WHEN NOT quality_passed THEN 'quality_rejection' WHEN NOT gate_supported THEN 'openset_rejection' ELSE 'accepted' END AS status,
  CASE vec_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE '' END AS quality_label, 'm' || (vec_id % 2) AS candidate, 'g' || (vec_id % 40) AS grp FROM named)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records: probabilities from the leading dimensions, decoded, with acceptance by quality and gate."""
    from granaria.operators.decision import decision_status, decode

    e = table(spark, sf, "embeddings")
    z = F.transform(F.slice("embedding", 1, len(CLASSES)), lambda x: x.cast("double") * 20)
    x = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), softmax(z).alias("p"))
    x = x.withColumn("d", decode(F.col("p")))
    known = F.col("label") < UNKNOWN_FROM
    names = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    true_fruit = F.when(known, names(("apple", "banana", "orange", "tomato"), F.floor(F.col("label") / 2).cast("int") % 4))
    true_condition = F.when(known, names(("fresh", "rotten"), F.col("label") % 2))
    quality_ok, gate_ok = F.col("vec_id") % 7 != 0, F.get(F.col("d.fruit_probabilities"), F.col("d.fruit_index")) >= 0.5
    return x.select(
        "vec_id", "label", "v", "p", known.alias("known"),
        F.col("d.fruit_index").alias("fi"), F.col("d.status_index").alias("si"), F.col("d.fruit_probabilities").alias("fp"),
        F.col("d.fruit").alias("fruit"), F.col("d.status").alias("condition"), F.concat_ws("::", "d.fruit", "d.status").alias("joint_class"),
        true_fruit.alias("true_fruit"), true_condition.alias("true_condition"), F.concat(true_fruit, F.lit("::"), true_condition).alias("true_joint"),
        F.array_max("p").alias("joint_max"), F.col("d.joint_probability").alias("joint_confidence"),
        quality_ok.alias("quality_passed"), gate_ok.alias("gate_supported"), (quality_ok & gate_ok).alias("supported"), decision_status(quality_ok, gate_ok).alias("status"),
        F.when(F.col("vec_id") % 3 == 0, "good").when(F.col("vec_id") % 3 == 1, "bad").otherwise("").alias("quality_label"),
        F.concat(F.lit("m"), F.col("vec_id") % 2).alias("candidate"), F.concat(F.lit("g"), F.col("vec_id") % 40).alias("grp"),
    )
