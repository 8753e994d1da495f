import pytest
from pyspark.sql import functions as F

from granaria.operators import decision as D
from granaria.operators import metrics as M
from granaria.operators import thresholds as T

REC = "known boolean, true_joint string, joint_class string, true_fruit string, fruit string, supported boolean, gate_supported boolean, status string, quality_label string, quality_passed boolean"


def golden(spark):
    rows = []
    for ok in (True, False):
        for acc in (True, False):
            rows.append((True, "a::x", "a::x" if ok else "b::x", "a", "a" if ok else "b", acc, acc, "accepted" if acc else "openset_rejection", "good", acc))
    rows += [(False, None, "a::x", None, "a", True, True, "accepted", "bad", True), (False, None, "a::x", None, "a", False, False, "quality_rejection", "", False)]
    return spark.createDataFrame(rows, REC)


def test_policy_golden(spark):
    p = M.policy(golden(spark)).first()
    assert (p["known_coverage"], p["end_to_end_joint"], p["accepted_only_joint"], p["false_acceptance"]) == (0.5, 0.25, 0.5, 0.5)
    assert {r["n"] for r in M.outcomes(golden(spark)).collect()} == {1}
    empty = M.policy(golden(spark).where("not known")).first()
    assert empty["known_coverage"] is None
    assert empty["accepted_only_joint"] is None
    d = M.quality_diagnostics(golden(spark)).first()
    assert (d["good_false_rejection"], d["bad_rejection"]) == (0.5, 0.0)


def test_classification_golden(spark):
    truth, pred = list(range(8)), [0, 1, 2, 2, 4, 5, 7, 7]
    df = spark.createDataFrame([(str(a), str(b), float(i % 2)) for i, (a, b) in enumerate(zip(truth, pred, strict=True))], "t string, p string, c double")
    labels = tuple(map(str, range(8)))
    m = M.macro(df, "t", "p", labels).first()
    assert m["accuracy"] == 0.75
    assert m["balanced_all"] == 0.75
    assert m["macro_f1"] == pytest.approx((4 + 2 * 2 / 3) / 8)
    half = M.macro(df.where("t in ('0', '3')"), "t", "p", labels).first()
    assert (half["balanced_all"], half["balanced_supported"]) == (0.125, 0.5)
    assert M.confusion(df, "t", "p", labels).count() == 64
    assert M.confusion(df.limit(0), "t", "p", labels).agg(F.sum("n")).first()[0] == 0
    bins = M.ece_bins(df, "c", F.col("t") == F.col("p"))
    assert [r["n"] for r in bins.orderBy("bin").collect()] == [4, 0, 0, 0, 0, 0, 0, 0, 0, 4]
    assert M.ece(df.limit(0), "c", F.lit(True)).first()["ece"] is None


def test_decode_and_policies(spark):
    p = [0.05, 0.05, 0.3, 0.25, 0.1, 0.1, 0.1, 0.05]
    d = spark.createDataFrame([(p,)], "p array<double>").select(D.decode(F.col("p")).alias("d")).first()["d"]
    assert (d["fruit"], d["status"], d["joint_index"]) == ("banana", "fresh", 2)
    assert d["status_probabilities"] == pytest.approx([0.3 / 0.55, 0.25 / 0.55])
    classes = ["a", "b", "c", "d", "other"]
    for v, want in (([0.85, 0.05, 0.04, 0.03, 0.03], "ACCEPTED"), ([0.36, 0.34, 0.12, 0.10, 0.08], "LOW_CONFIDENCE"), ([0.02, 0.03, 0.04, 0.05, 0.86], "OUT_OF_SCOPE")):
        assert spark.createDataFrame([(v,)], "p array<double>").select(D.open_set(F.col("p"), classes).alias("d")).first()["d"]["state"] == want


def test_flags_of_black_image(spark):
    df = spark.createDataFrame([(40, 30, 0.0, 0.0)], "w int, h int, b double, s double")
    c = [F.col(x) for x in ("w", "h", "b", "s")]
    r = df.select(D.quality_flags(*c, F.lit("OK"), F.lit("MATCH")).alias("f"), D.quality_verdict(*c).alias("v"), D.plain_gate(*c, F.lit(0.0)).alias("g")).first()
    assert r["f"] == "TOO_SMALL;DARK;BLUR_CANDIDATE"
    assert r["v"]["reasons"] == ["too_small", "blurry", "too_dark"]
    assert r["g"] == "unusable" or r["g"] == "very_dark"


def test_threshold_selection(spark):
    rows = [(0.1, True), (0.6, True), (0.6, True), (0.9, True), (0.2, False), (0.6, False), (0.05, False)]
    df = spark.createDataFrame(rows, "s double, k boolean")
    got = {r["threshold"]: (r["known_accept"], r["unknown_reject"]) for r in T.sweep(df, "s", "k").collect()}
    for t in {0.0, 1.0, *[s for s, _ in rows]}:
        want = (sum(s >= t for s, k in rows if k) / 4, sum(s < t for s, k in rows if not k) / 3)
        assert got[t] == pytest.approx(want)
    best = T.select_threshold(df, "s", "k", 0.75).first()
    assert (best["threshold"], best["known_accept"]) == (0.6, 0.75)
    none = T.select_threshold(df, "s", "k", 1.1).first()
    assert none["threshold"] == pytest.approx(0.1)
