"""Decisions from probabilities, embeddings and measures, as column expressions.

Ordered cascades are CASE expressions; the first condition that holds decides. A null measure fails no threshold unless
its function says otherwise. Probability vectors are validated by ``rules.probability_rules`` before they are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.paths import FRUITS, STATES
from granaria.functions.rates import sigmoid
from granaria.functions.tags import join_flags
from granaria.functions.vectors import argmax, argmax_last, certainty, dot, margin, ranked

# Thresholds of the three measuring modules.
AUDIT = {"min_side": 96, "min_brightness": 35.0, "min_blur": 50.0, "high_brightness": 220.0}
VERDICT = {"min_side": 100, "min_blur": 100.0, "dark": 40.0, "bright": 215.0}
PLAIN = {"min_side": 32, "dark": 18.0, "bright": 244.0, "min_blur": 1.0, "min_edge": 0.5}
# The default policy on class probabilities.
POLICY = {"min_probability": 0.55, "min_margin": 0.10}


def decode(p: Column) -> Column:
    """Fruit first, then status given the fruit: struct of fruit probabilities and indexes from eight joint probabilities."""
    fruit_p = F.transform(F.sequence(F.lit(0), F.lit(len(FRUITS) - 1)), lambda i: F.get(p, i * 2) + F.get(p, i * 2 + 1))
    fruit = argmax(fruit_p)
    own = F.get(fruit_p, fruit)
    given = F.array(F.get(p, fruit * 2) / F.greatest(own, F.lit(1e-12)), F.get(p, fruit * 2 + 1) / F.greatest(own, F.lit(1e-12)))
    status = argmax(given)
    return F.struct(
        fruit_p.alias("fruit_probabilities"), fruit.alias("fruit_index"), F.get(F.array(*map(F.lit, FRUITS)), fruit).alias("fruit"),
        given.alias("status_probabilities"), status.alias("status_index"), F.get(F.array(*map(F.lit, STATES)), status).alias("status"),
        (fruit * 2 + status).alias("joint_index"), F.get(p, fruit * 2 + status).alias("joint_probability"),
    )


def quality_flags(width: Column, height: Column, brightness: Column, blur: Column, decode_status: Column, digest_status: Column) -> Column:
    """``;``-joined flags of an inventory row, ``NONE`` without any."""
    return join_flags(
        {
            "TOO_SMALL": F.least(width, height) < AUDIT["min_side"],
            "DARK": brightness < AUDIT["min_brightness"],
            "BLUR_CANDIDATE": blur < AUDIT["min_blur"],
            "DECODE_ERROR": decode_status != "OK",
            "SHA256_MISMATCH": digest_status == "MISMATCH",
            "HIGH_BRIGHTNESS_CANDIDATE": brightness > AUDIT["high_brightness"],
        }
    )


def quality_verdict(width: Column, height: Column, brightness: Column, blur: Column) -> Column:
    """(passed, reasons) under the four thresholds of the input check."""
    t = VERDICT
    reasons = F.array_compact(
        F.array(
            F.when(F.least(width, height) < t["min_side"], "too_small"),
            F.when(blur < t["min_blur"], "blurry"),
            F.when(brightness < t["dark"], "too_dark"),
            F.when(brightness > t["bright"], "too_bright"),
        )
    )
    return F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def plain_gate(width: Column, height: Column, brightness: Column, blur: Column, edge: Column) -> Column:
    """First reason why an image holds nothing usable, else null."""
    t = PLAIN
    return (
        F.when(width.isNull() | (F.least(width, height) < t["min_side"]), "unusable")
        .when(brightness < t["dark"], "very_dark")
        .when(brightness > t["bright"], "very_bright")
        .when((F.coalesce(blur, F.lit(0.0)) < t["min_blur"]) & (F.coalesce(edge, F.lit(0.0)) < t["min_edge"]), "uniform")
    )


def decision_status(quality_passed: Column, gate_passed: Column) -> Column:
    return F.when(~quality_passed, "quality_rejection").when(~gate_passed, "openset_rejection").otherwise("accepted")


def open_set(p: Column, classes: list[str], min_probability: float = POLICY["min_probability"], min_margin: float = POLICY["min_margin"], other: str = "other") -> Column:
    """(state, class, confidence, margin): out of scope, low confidence or accepted. On a tie the last class leads."""
    top = F.get(F.array(*map(F.lit, classes)), argmax_last(p))
    best, gap = F.array_max(p), margin(p)
    state = F.when(top == other, "OUT_OF_SCOPE").when((best < min_probability) | (gap < min_margin), "LOW_CONFIDENCE").otherwise("ACCEPTED")
    return F.struct(state.alias("state"), top.alias("class"), best.alias("confidence"), gap.alias("margin"))


def top_classes(p: Column, classes: list[str], k: int = 3) -> Column:
    """The ``k`` most probable (probability, class), best first."""
    return F.slice(ranked(F.zip_with(p, F.array(*map(F.lit, classes)), lambda x, c: F.struct(x.alias("probability"), c.alias("class")))), 1, k)


def needs_review(fruit_score: Column, status_score: Column, threshold: float) -> Column:
    return (fruit_score < threshold) | (status_score < threshold)


def provenance(decode_status: Column, byte_reference: Column, pixel_reference: Column, transform: Column, named_parent: Column, declared_new: Column) -> Column:
    """(category, reason) of an image by the strength of the evidence; similarity alone proves nothing."""
    pick = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("reason"))
    return (
        F.when(F.coalesce(decode_status != "OK", F.lit(True)), pick("corrupt", "decode_or_read_failed"))
        .when(byte_reference.isNotNull(), pick("exact_duplicate", "sha256_exact_match"))
        .when(pixel_reference.isNotNull(), pick("exact_duplicate", "decoded_rgb_pixels_exact_match"))
        .when(transform & named_parent, pick("probable_augmentation", "explicit_transform_filename_and_available_named_parent"))
        .when(declared_new, pick("probable_new_image", "declared_source_and_label_evidence_require_human_review"))
        .otherwise(pick("unknown", "insufficient_parent_or_independent_source_evidence"))
    )


def with_gate_features(rows: DataFrame, vector: str, p: str, prototypes: DataFrame) -> DataFrame:
    """``rows`` with ``features``: fruit score, margin, joint maximum, similarity to the predicted fruit, its gap, certainty.

    ``prototypes`` holds (fruit_index, vec) unit vectors, a fixed handful for each fruit; they are turned into one array
    column of one row, so the join is with a single row.
    """
    packed = prototypes.groupBy("fruit_index").agg(F.collect_list("vec").alias("vecs")).agg(F.array_sort(F.collect_list(F.struct("fruit_index", "vecs"))).alias("protos"))
    d = decode(F.col(p))
    x = rows.crossJoin(F.broadcast(packed)).withColumn("_d", d)
    sims = F.transform("protos", lambda g: F.array_max(F.transform(g["vecs"], lambda v: dot(v, F.col(vector)))))
    x = x.withColumn("_s", sims)
    own = F.get(F.col("_s"), F.col("_d.fruit_index"))
    rest = F.array_max(F.filter(F.col("_s"), lambda s, i: i != F.col("_d.fruit_index")))
    fp = F.col("_d.fruit_probabilities")
    features = F.array(F.get(fp, F.col("_d.fruit_index")), margin(fp), F.array_max(p), own, own - rest, certainty(fp, len(FRUITS)))
    return x.select(*rows.columns, F.col("_d.fruit_index").alias("fruit_index"), features.alias("features"))


def gate_score(features: Column, mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    """Logistic score of standardised features."""
    terms = [(F.get(features, F.lit(i)) - m) / max(s, 1e-12) * w for i, (m, s, w) in enumerate(zip(mean, scale, weights, strict=True))]
    return sigmoid(sum(terms[1:], terms[0]) + bias)
