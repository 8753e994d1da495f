"""Classification, calibration and acceptance metrics, each family as one pass of conditional aggregates.

Rates over an empty population are null unless a function says "0.0"; both conventions are in use and named. Fixed label
lists keep absent labels in every matrix. ``by`` adds grouping columns (a model, a source) to any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.rates import count_if, ratio, safe_div
from granaria.operators.summary import dense_counts, dimension
from granaria.operators.quantiles import exact_quantiles


def confusion(rows: DataFrame, truth: str, predicted: str, labels: tuple) -> DataFrame:
    """(truth, predicted, n) for every pair of labels."""
    named = rows.select(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    return dense_counts(named, {"truth": labels, "predicted": labels})


def per_class(rows: DataFrame, truth: str, predicted: str, labels: tuple, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, tp, predicted_n, support, precision, recall, f1), 0.0 for undefined ratios, every label of the list."""
    ends = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(truth) == F.col(predicted)).cast("int")
    s = rows.select(*by, hit.alias("hit"), ends.alias("x")).groupBy(*by, "x.label").agg(F.sum(F.col("hit") * F.col("x.t")).alias("tp"), F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted_n"))
    grid = dimension(rows, "label", labels)
    if by:
        grid = rows.select(*by).distinct().crossJoin(F.broadcast(grid))
    s = grid.join(s, [*by, "label"], "left").na.fill(0, ["tp", "support", "predicted_n"])
    precision, recall = safe_div(F.col("tp"), F.col("predicted_n")), safe_div(F.col("tp"), F.col("support"))
    return s.select(*by, "label", "tp", "predicted_n", "support", precision.alias("precision"), recall.alias("recall"), safe_div(2 * F.col("tp"), F.col("predicted_n") + F.col("support")).alias("f1"))


def macro(rows: DataFrame, truth: str, predicted: str, labels: tuple, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, accuracy, macro_f1, balanced_all, balanced_supported): both definitions of balanced accuracy."""
    c = per_class(rows, truth, predicted, labels, by)
    s = c.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_all"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_supported"))
    a = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return a.join(s, list(by)) if by else a.crossJoin(s)


def conditional_accuracy(rows: DataFrame, correct: Column, given: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, accuracy) among the rows for which ``given`` holds; null if there are none."""
    return rows.groupBy(*by).agg(count_if(given).alias("n"), F.avg(F.when(given, correct.cast("double"))).alias("accuracy"))


def group_macro(rows: DataFrame, correct: Column, group: str) -> DataFrame:
    """(groups, mean_group_accuracy): mean over groups of their own means."""
    g = rows.groupBy(group).agg(F.avg(correct.cast("double")).alias("a"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.avg("a").alias("mean_group_accuracy"))


def policy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Acceptance policy over known and unknown rows. Rejected rows stay in the denominators of end-to-end rates."""
    known, acc = F.col("known"), F.col("supported")
    joint, fruit = F.col("true_joint") == F.col("joint_class"), F.col("true_fruit") == F.col("fruit")
    c = {
        "known": known, "unknown": ~known, "known_accepted": known & acc, "fruit_ok": known & acc & fruit, "joint_ok": known & acc & joint,
        "unknown_accepted": ~known & acc, "quality_rejected": known & (F.col("status") == "quality_rejection"), "openset_rejected": known & (F.col("status") == "openset_rejection"),
    }
    s = rows.groupBy(*by).agg(*[count_if(v).alias(k) for k, v in c.items()])
    return s.select(
        *by, "known", "unknown", "known_accepted", "quality_rejected", "openset_rejected",
        ratio(F.col("known_accepted"), F.col("known")).alias("known_coverage"),
        ratio(F.col("fruit_ok"), F.col("known")).alias("end_to_end_fruit"),
        ratio(F.col("joint_ok"), F.col("known")).alias("end_to_end_joint"),
        ratio(F.col("joint_ok"), F.col("known_accepted")).alias("accepted_only_joint"),
        ratio(F.col("unknown_accepted"), F.col("unknown")).alias("false_acceptance"),
        ratio(F.col("unknown") - F.col("unknown_accepted"), F.col("unknown")).alias("unknown_rejection"),
    )


def outcomes(rows: DataFrame) -> DataFrame:
    """(correct, accepted, n): the 2x2 table of known rows, zero cells kept."""
    k = rows.where("known").select((F.col("true_joint") == F.col("joint_class")).alias("correct"), F.col("gate_supported").alias("accepted"))
    return dense_counts(k, {"correct": (True, False), "accepted": (True, False)})


def ece_bins(rows: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, mean_confidence, weight): every bin; empty ones have null means and weight 0."""
    place = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    s = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))
    whole = rows.agg(F.count(F.lit(1)).alias("whole"))
    g = dimension(rows, "bin", tuple(range(bins))).join(s, "bin", "left").crossJoin(whole)
    return g.select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence", F.coalesce(F.try_divide("n", "whole"), F.lit(0.0)).alias("weight"))


def ece(rows: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(ece): weighted mean gap of accuracy and confidence; null without rows."""
    b = ece_bins(rows, confidence, correct, bins)
    return b.agg(F.sum(F.when(F.col("n") > 0, F.col("weight") * F.abs(F.col("accuracy") - F.col("mean_confidence")))).alias("ece"))


def quality_diagnostics(rows: DataFrame) -> DataFrame:
    """How a quality check treats rows that people labelled good or bad."""
    good, bad, passed = F.col("quality_label") == "good", F.col("quality_label") == "bad", F.col("quality_passed")
    s = rows.agg(count_if(good).alias("good"), count_if(bad).alias("bad"), count_if(good & ~passed).alias("good_rejected"), count_if(bad & ~passed).alias("bad_rejected"))
    return s.select("good", "bad", ratio(F.col("good_rejected"), F.col("good")).alias("good_false_rejection"), ratio(F.col("bad_rejected"), F.col("bad")).alias("bad_rejection"))


def latency(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, mean, p95): exact percentile with linear interpolation; null classes are left out."""
    mean = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = exact_quantiles(rows, list(by), value, (0.95,)).select(*by, F.col("q")[0].alias("p95"))
    return mean.join(q, list(by)) if by else mean.crossJoin(q)  # without classes a row each


def score_diagnostics(rows: DataFrame, score: str, flagged: Column, label: str) -> DataFrame:
    """(label, n, mean_score, max_score, flagged_rate) of unknown rows by predicted class."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.avg(flagged.cast("double")).alias("flagged_rate"))


def open_set_by(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, accepted, coverage, accepted_accuracy) under the older convention: 0.0 where undefined."""
    ok = F.col("accepted") & (F.col("truth") == F.col("class"))
    s = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("accepted")).alias("accepted"), count_if(ok).alias("correct"))
    return s.select(by, "n", "accepted", safe_div(F.col("accepted"), F.col("n")).alias("coverage"), safe_div(F.col("correct"), F.col("accepted")).alias("accepted_accuracy"))


def mean_loss(batches: DataFrame, loss: str, size: str) -> DataFrame:
    """(mean_loss): batch losses weighted by batch size."""
    return batches.agg(ratio(F.sum(F.col(loss) * F.col(size)), F.sum(size)).alias("mean_loss"))
