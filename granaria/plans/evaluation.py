"""Queries of the decision, metric and threshold operators, over the embeddings table seen as a classifier's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granaria.functions.paths import CLASSES, FRUITS, STATES
from granaria.functions.vectors import l2
from granaria.operators import decision as D
from granaria.operators import metrics as M
from granaria.operators import thresholds as T
from granaria.operators.assignment import every_nth
from granaria.plans.common import PRED, predictions
from granaria.session import table

OPEN_CLASSES = [*FRUITS, "other"]
GATE = {"mean": [0.5, 0.2, 0.3, 0.1, 0.0, 0.2], "scale": [0.2, 0.2, 0.2, 0.1, 0.1, 0.2], "weights": [0.8, 0.4, 0.6, 1.2, 0.9, 0.3], "bias": -0.25}


def _joint_ok():
    return F.col("true_joint") == F.col("joint_class")


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).where("known")


def decode_joint(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    return p.select("vec_id", F.col("fi").alias("fruit_index"), F.col("si").alias("status_index"), "joint_class", F.round("joint_confidence", 6).alias("joint_confidence"), F.round("joint_max", 6).alias("joint_max"), "status")


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(_known(spark, sf), "true_joint", "joint_class", CLASSES)


def class_prf(spark: SparkSession, sf: str) -> DataFrame:
    return M.per_class(_known(spark, sf), "true_joint", "joint_class", CLASSES)


def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, macro-F1 and both balanced accuracies of the joint, fruit and condition tasks, per candidate model."""
    k = _known(spark, sf)
    out = None
    for task, truth, pred, labels in (("joint", "true_joint", "joint_class", CLASSES), ("fruit", "true_fruit", "fruit", FRUITS), ("condition", "true_condition", "condition", STATES)):
        one = M.macro(k, truth, pred, labels, ("candidate",)).withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out


def conditional_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return M.conditional_accuracy(_known(spark, sf), F.col("true_condition") == F.col("condition"), F.col("true_fruit") == F.col("fruit"), ("candidate",))


def group_macro_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return M.group_macro(_known(spark, sf), _joint_ok(), "grp")


def policy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.policy(predictions(spark, sf), ("candidate",))


def gate_outcomes_2x2(spark: SparkSession, sf: str) -> DataFrame:
    return M.outcomes(predictions(spark, sf))


def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    return M.ece_bins(_known(spark, sf), "joint_confidence", _joint_ok())


def ece(spark: SparkSession, sf: str) -> DataFrame:
    return M.ece(_known(spark, sf), "joint_confidence", _joint_ok()).select(F.round("ece", 9).alias("ece"))


def quality_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return M.quality_diagnostics(predictions(spark, sf))


def latency_p95(spark: SparkSession, sf: str) -> DataFrame:
    return M.latency(table(spark, sf, "events"), "value", ("event_type",)).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


def unknown_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    u = predictions(spark, sf).where("not known")
    s = M.score_diagnostics(u, "joint_confidence", D.needs_review(F.get("fp", F.col("fi")), F.col("joint_confidence"), 0.5), "joint_class")
    return s.select("joint_class", "n", F.round("mean_score", 6).alias("mean_score"), F.round("max_score", 6).alias("max_score"), F.round("flagged_rate", 6).alias("flagged_rate"))


def _open(spark: SparkSession, sf: str) -> DataFrame:
    """Five-class open-set decisions: the four fruit probabilities scaled by what the last class takes."""
    p = predictions(spark, sf)
    other = F.when(F.col("known"), F.lit(0.05)).otherwise(F.lit(0.4))
    five = F.concat(F.transform("fp", lambda x: x * (1 - other)), F.array(other))
    return p.select("vec_id", "candidate", "known", F.coalesce("true_fruit", F.lit("other")).alias("truth"), five.alias("p5")).withColumn("d", D.open_set(F.col("p5"), OPEN_CLASSES))


def open_set_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _open(spark, sf).select("vec_id", "d.state", "d.class", F.round("d.confidence", 6).alias("confidence"), F.round("d.margin", 6).alias("margin"))


def open_set_by_truth(spark: SparkSession, sf: str) -> DataFrame:
    o = _open(spark, sf).select("truth", F.col("d.class").alias("class"), (F.col("d.state") == "ACCEPTED").alias("accepted"))
    return M.open_set_by(o.withColumn("source", F.col("truth")), "source")


def top3_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    t = F.posexplode(D.top_classes(F.col("p"), list(CLASSES)))
    return p.select("vec_id", t.alias("rank", "x")).select("vec_id", "rank", F.col("x.class").alias("class"), F.round("x.probability", 6).alias("probability"))


def mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-entropy of the true class over batches of 16 rows, weighted by batch size."""
    k = _known(spark, sf)
    loss = -F.log(F.greatest(F.get("p", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("true_joint")).cast("int") - 1), F.lit(1e-15)))
    batches = k.select(F.floor(F.col("vec_id") / 16).alias("batch"), loss.alias("loss")).groupBy("batch").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("size"))
    return M.mean_loss(batches, "loss", "size").select(F.round("mean_loss", 9).alias("mean_loss"))


def _prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """One centroid for each fruit, of the unit vectors of its prototype part (three of four rows in digest order)."""
    part = every_nth(_known(spark, sf).withColumn("u", l2(F.col("v"))), "true_fruit", "vec_id").where("not calibration")
    means = part.select("true_fruit", F.posexplode("u").alias("i", "x")).groupBy("true_fruit", "i").agg(F.avg("x").alias("x"))
    vec = means.groupBy("true_fruit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    index = F.array_position(F.array(*map(F.lit, FRUITS)), F.col("true_fruit")).cast("int") - 1
    return vec.select(index.alias("fruit_index"), l2(F.col("vec")).alias("vec"))


def calibration_split(spark: SparkSession, sf: str) -> DataFrame:
    return every_nth(_known(spark, sf), "true_fruit", "vec_id").select("vec_id", "true_fruit", "calibration")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).withColumn("u", l2(F.col("v")))
    f = D.with_gate_features(p, "u", "p", _prototypes(spark, sf))
    return f.withColumn("score", D.gate_score(F.col("features"), **GATE))


def gate_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ("fruit_score", "fruit_margin", "joint_max", "similarity", "similarity_gap", "certainty")
    return _scored(spark, sf).select("vec_id", "fruit_index", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(names)], F.round("score", 6).alias("score"))


def threshold_select(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).select(F.round("score", 6).alias("score"), "known")
    return T.select_threshold(s, "score", "known", 0.9).select(*[F.round(c, 9).alias(c) for c in ("threshold", "known_accept", "unknown_reject")])


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = predictions(spark, sf).select(F.round("joint_confidence", 4).alias("score"), "known")
    return T.sweep(s, "score", "known").select(*[F.round(c, 9).alias(c) for c in ("threshold", "known_accept", "unknown_reject")])


def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _open(spark, sf).select(F.col("known").alias("in_scope"), (F.col("d.class") == F.col("truth")).alias("top_ok"), (F.col("d.class") == "other").alias("is_other"), F.round("d.confidence", 9).alias("p"), F.round("d.margin", 9).alias("margin"))
    g = T.grid_search(rows, [0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9], [0.1, 0.15, 0.2, 0.25, 0.3])
    return g.select("ordinal", "min_probability", "min_margin", *[F.round(c, 9).alias(c) for c in ("coverage", "accepted_accuracy", "false_acceptance", "score")])


def threshold_best(spark: SparkSession, sf: str) -> DataFrame:
    return T.best_point(threshold_grid(spark, sf))


def status_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    k = _known(spark, sf)
    given = F.col("joint_confidence") / F.greatest(F.get("fp", F.col("fi")), F.lit(1e-12))
    rows = k.select(F.round(given, 9).alias("p"), (F.col("true_condition") == F.col("condition")).alias("ok"))
    s = T.status_sweep(rows, [round(0.55 + 0.025 * i, 3) for i in range(11)])
    return s.select("ordinal", "threshold", *[F.round(c, 9).alias(c) for c in ("accepted_accuracy", "coverage", "score")])


QUERIES = {
    f.__name__: f
    for f in (
        decode_joint, confusion_matrix, class_prf, macro_metrics, conditional_accuracy, group_macro_accuracy, policy_metrics, gate_outcomes_2x2, ece_bins, ece,
        quality_diagnostics, latency_p95, unknown_diagnostics, open_set_decision, open_set_by_truth, top3_classes, mean_loss, calibration_split, gate_features,
        threshold_select, threshold_sweep, threshold_grid, threshold_best, status_thresholds,
    )
}

_K = f"WITH {PRED}, k AS (SELECT * FROM rows_ WHERE known)"
_LABELS = "['apple::fresh','apple::rotten','banana::fresh','banana::rotten','orange::fresh','orange::rotten','tomato::fresh','tomato::rotten']"
_OPEN = """five AS (SELECT *, coalesce(true_fruit, 'other') AS truth, list_concat(list_transform(fp, lambda x: x * (1 - CASE WHEN known THEN 0.05::DOUBLE ELSE 0.4::DOUBLE END)), [CASE WHEN known THEN 0.05::DOUBLE ELSE 0.4::DOUBLE END]) AS p5 FROM rows_),
op AS (SELECT *, ['apple','banana','orange','tomato','other'][list_position(p5, list_max(p5))] AS cls, list_max(p5) AS conf, list_reverse_sort(p5)[1] - list_reverse_sort(p5)[2] AS margin FROM five),
dc AS (SELECT *, CASE WHEN cls = 'other' THEN 'OUT_OF_SCOPE' WHEN conf < 0.55 OR margin < 0.1 THEN 'LOW_CONFIDENCE' ELSE 'ACCEPTED' END AS state FROM op)"""
_MACRO = """SELECT candidate, '{task}' AS task, count(*) AS rows, avg(({t} = {p})::INT) AS accuracy, any_value(f) AS macro_f1, any_value(ba) AS balanced_all, any_value(bs) AS balanced_supported FROM k
JOIN (SELECT candidate, avg(CASE WHEN pn + sn > 0 THEN 2.0 * tp / (pn + sn) ELSE 0 END) AS f, avg(CASE WHEN sn > 0 THEN tp::DOUBLE / sn ELSE 0 END) AS ba, avg(CASE WHEN sn > 0 THEN tp::DOUBLE / sn END) AS bs FROM
 (SELECT c.candidate, l, (SELECT count(*) FROM k WHERE k.candidate = c.candidate AND {t} = l AND {p} = l) AS tp, (SELECT count(*) FROM k WHERE k.candidate = c.candidate AND {p} = l) AS pn, (SELECT count(*) FROM k WHERE k.candidate = c.candidate AND {t} = l) AS sn
  FROM (SELECT DISTINCT candidate FROM k) c CROSS JOIN (SELECT unnest({labels}) AS l)) GROUP BY candidate) USING (candidate) GROUP BY candidate"""
_GATE = """un AS (SELECT *, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM rows_),
cal AS (SELECT *, (row_number() OVER (PARTITION BY true_fruit ORDER BY sha256(vec_id::VARCHAR), vec_id) - 1) % 4 = 0 AS calibration FROM un WHERE known),
mean_ AS (SELECT true_fruit, i, avg(u[i]) AS x FROM cal CROSS JOIN (SELECT unnest(range(1, 65)) AS i) WHERE NOT calibration GROUP BY ALL),
proto AS (SELECT true_fruit, list(x ORDER BY i) AS w FROM mean_ GROUP BY true_fruit),
protos AS (SELECT list_position(['apple','banana','orange','tomato'], true_fruit) - 1 AS pi, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS w FROM proto),
sims AS (SELECT un.vec_id, list(list_dot_product(un.u, protos.w) ORDER BY pi) AS s FROM un CROSS JOIN protos GROUP BY un.vec_id),
feat AS (SELECT un.*, s, fp[fi + 1] AS f1, list_reverse_sort(fp)[1] - list_reverse_sort(fp)[2] AS f2, joint_max AS f3, s[fi + 1] AS f4, s[fi + 1] - list_max(list_filter(s, lambda x, i: i <> fi + 1)) AS f5,
  1 + list_sum(list_transform(fp, lambda x: x * ln(greatest(x, 1e-15)))) / ln(4) AS f6 FROM un JOIN sims USING (vec_id)),
sc AS (SELECT *, 1 / (1 + exp(-greatest(-50, least(50, (f1 - 0.5) / 0.2 * 0.8 + (f2 - 0.2) / 0.2 * 0.4 + (f3 - 0.3) / 0.2 * 0.6 + (f4 - 0.1) / 0.1 * 1.2 + (f5 - 0.0) / 0.1 * 0.9 + (f6 - 0.2) / 0.2 * 0.3 - 0.25)))) AS score FROM feat)"""
_SWEEP = """cand AS (SELECT DISTINCT t FROM (SELECT score AS t FROM s UNION ALL SELECT 0.0 UNION ALL SELECT 1.0)),
sw AS (SELECT t AS threshold, (SELECT avg((score >= t)::INT) FROM s WHERE known) AS known_accept, (SELECT avg((score < t)::INT) FROM s WHERE NOT known) AS unknown_reject FROM cand)"""
_GRID = """pts AS (SELECT (row_number() OVER (ORDER BY p, m) - 1)::INT AS ordinal, p, m FROM (SELECT unnest([0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]::DOUBLE[]) AS p) CROSS JOIN (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS m)),
o AS (SELECT known AS in_scope, cls = truth AS top_ok, cls = 'other' AS is_other, round(conf, 9) AS q, round(margin, 9) AS g FROM op),
cell AS (SELECT ordinal, p, m, count(*) FILTER (in_scope) AS ni, count(*) FILTER (NOT in_scope) AS no_, count(*) FILTER (in_scope AND NOT is_other AND q >= p AND g >= m) AS a, count(*) FILTER (in_scope AND top_ok AND NOT is_other AND q >= p AND g >= m) AS c, count(*) FILTER (NOT in_scope AND NOT is_other AND q >= p AND g >= m) AS f FROM pts CROSS JOIN o GROUP BY ALL),
rates AS (SELECT ordinal, p AS min_probability, m AS min_margin, coalesce(a / nullif(ni, 0)::DOUBLE, 0) AS coverage, coalesce(c / nullif(a, 0)::DOUBLE, 0) AS accepted_accuracy, coalesce(f / nullif(no_, 0)::DOUBLE, 0) AS false_acceptance FROM cell),
grid AS (SELECT ordinal, min_probability, min_margin, round(coverage, 9) AS coverage, round(accepted_accuracy, 9) AS accepted_accuracy, round(false_acceptance, 9) AS false_acceptance, round(0.5 * accepted_accuracy + 0.3 * coverage + 0.2 * (1 - false_acceptance), 9) AS score FROM rates)"""

SQL = {
    "decode_joint": f"WITH {PRED} SELECT vec_id, fi::INT AS fruit_index, si AS status_index, joint_class, round(joint_confidence, 6) AS joint_confidence, round(joint_max, 6) AS joint_max, status FROM rows_",
    "confusion_matrix": f"{_K} SELECT t AS truth, q AS predicted, (SELECT count(*) FROM k WHERE true_joint = t AND joint_class = q) AS n FROM (SELECT unnest({_LABELS}) AS t) CROSS JOIN (SELECT unnest({_LABELS}) AS q)",
    "class_prf": f"""{_K}, c AS (SELECT l, (SELECT count(*) FROM k WHERE true_joint = l AND joint_class = l) AS tp, (SELECT count(*) FROM k WHERE joint_class = l) AS pn, (SELECT count(*) FROM k WHERE true_joint = l) AS sn FROM (SELECT unnest({_LABELS}) AS l))
SELECT l AS label, tp, pn AS predicted_n, sn AS support, coalesce(tp / nullif(pn, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(sn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(pn + sn, 0)::DOUBLE, 0) AS f1 FROM c""",
    "macro_metrics": f"{_K} "
    + " UNION ALL ".join(
        _MACRO.format(task=a, t=b, p=c, labels=d)
        for a, b, c, d in (("joint", "true_joint", "joint_class", _LABELS), ("fruit", "true_fruit", "fruit", "['apple','banana','orange','tomato']"), ("condition", "true_condition", "condition", "['fresh','rotten']"))
    ),
    "conditional_accuracy": f"{_K} SELECT candidate, count(*) FILTER (true_fruit = fruit) AS n, avg((true_condition = condition)::INT) FILTER (true_fruit = fruit) AS accuracy FROM k GROUP BY candidate",
    "group_macro_accuracy": f"{_K} SELECT count(*) AS groups, avg(a) AS mean_group_accuracy FROM (SELECT avg((true_joint = joint_class)::INT) AS a FROM k GROUP BY grp)",
    "policy_metrics": f"""WITH {PRED}, c AS (SELECT candidate, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND supported) AS ka, count(*) FILTER (known AND status = 'quality_rejection') AS qr, count(*) FILTER (known AND status = 'openset_rejection') AS orj,
 count(*) FILTER (known AND supported AND true_fruit = fruit) AS fo, count(*) FILTER (known AND supported AND true_joint = joint_class) AS jo, count(*) FILTER (NOT known AND supported) AS ua FROM rows_ GROUP BY candidate)
SELECT candidate, known, unknown, ka AS known_accepted, qr AS quality_rejected, orj AS openset_rejected, ka / nullif(known, 0)::DOUBLE AS known_coverage, fo / nullif(known, 0)::DOUBLE AS end_to_end_fruit, jo / nullif(known, 0)::DOUBLE AS end_to_end_joint, jo / nullif(ka, 0)::DOUBLE AS accepted_only_joint,
 ua / nullif(unknown, 0)::DOUBLE AS false_acceptance, (unknown - ua) / nullif(unknown, 0)::DOUBLE AS unknown_rejection FROM c""",
    "gate_outcomes_2x2": f"{_K} SELECT c AS correct, a AS accepted, (SELECT count(*) FROM k WHERE (true_joint = joint_class) = c AND gate_supported = a) AS n FROM (SELECT unnest([true, false]) AS c) CROSS JOIN (SELECT unnest([true, false]) AS a)",
    "ece_bins": f"""{_K}, b AS (SELECT least(floor(joint_confidence * 10), 9)::INT AS bin, (true_joint = joint_class)::INT AS ok, joint_confidence AS c FROM k), s AS (SELECT bin, count(*) AS n, avg(ok) AS accuracy, avg(c) AS mean_confidence FROM b GROUP BY bin)
SELECT g.bin, coalesce(n, 0) AS n, accuracy, mean_confidence, coalesce(n / (SELECT count(*) FROM k)::DOUBLE, 0) AS weight FROM (SELECT unnest(range(10))::INT AS bin) g LEFT JOIN s ON s.bin = g.bin""",
    "ece": f"""{_K}, b AS (SELECT least(floor(joint_confidence * 10), 9) AS bin, (true_joint = joint_class)::INT AS ok, joint_confidence AS c FROM k) SELECT round(sum(n / (SELECT count(*) FROM k)::DOUBLE * abs(a - m)), 9) AS ece FROM (SELECT count(*) AS n, avg(ok) AS a, avg(c) AS m FROM b GROUP BY bin)""",
    "quality_diagnostics": f"""WITH {PRED} SELECT count(*) FILTER (quality_label = 'good') AS good, count(*) FILTER (quality_label = 'bad') AS bad, avg((NOT quality_passed)::INT) FILTER (quality_label = 'good') AS good_false_rejection, avg((NOT quality_passed)::INT) FILTER (quality_label = 'bad') AS bad_rejection FROM rows_""",
    "latency_p95": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "unknown_diagnostics": f"WITH {PRED} SELECT joint_class, count(*) AS n, round(avg(joint_confidence), 6) AS mean_score, round(max(joint_confidence), 6) AS max_score, round(avg((fp[fi + 1] < 0.5 OR joint_confidence < 0.5)::INT), 6) AS flagged_rate FROM rows_ WHERE NOT known GROUP BY joint_class",
    "open_set_decision": f"WITH {PRED}, {_OPEN} SELECT vec_id, state, cls AS class, round(conf, 6) AS confidence, round(margin, 6) AS margin FROM dc",
    "open_set_by_truth": f"""WITH {PRED}, {_OPEN}, s AS (SELECT truth AS source, count(*) AS n, count(*) FILTER (state = 'ACCEPTED') AS accepted, count(*) FILTER (state = 'ACCEPTED' AND cls = truth) AS ok FROM dc GROUP BY truth)
SELECT source, n, accepted, coalesce(accepted / nullif(n, 0)::DOUBLE, 0) AS coverage, coalesce(ok / nullif(accepted, 0)::DOUBLE, 0) AS accepted_accuracy FROM s""",
    "top3_classes": f"""WITH {PRED}, x AS (SELECT vec_id, unnest(p) AS q, unnest({_LABELS}) AS class FROM rows_), r AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, class DESC) - 1)::INT AS rank FROM x)
SELECT vec_id, rank, class, round(q, 6) AS probability FROM r WHERE rank < 3""",
    "mean_loss": f"""{_K}, b AS (SELECT vec_id // 16 AS b, avg(-ln(greatest(p[list_position({_LABELS}, true_joint)], 1e-15))) AS l, count(*) AS n FROM k GROUP BY ALL) SELECT round(sum(l * n) / sum(n), 9) AS mean_loss FROM b""",
    "calibration_split": f"WITH {PRED} SELECT vec_id, true_fruit, (row_number() OVER (PARTITION BY true_fruit ORDER BY sha256(vec_id::VARCHAR), vec_id) - 1) % 4 = 0 AS calibration FROM rows_ WHERE known",
    "gate_features": f"""WITH {PRED}, {_GATE} SELECT vec_id, fi::INT AS fruit_index, round(f1, 6) AS fruit_score, round(f2, 6) AS fruit_margin, round(f3, 6) AS joint_max, round(f4, 6) AS similarity, round(f5, 6) AS similarity_gap, round(f6, 6) AS certainty, round(score, 6) AS score FROM sc""",
    "threshold_select": f"""WITH {PRED}, {_GATE}, s AS (SELECT round(score, 6) AS score, known FROM sc), {_SWEEP}
SELECT round(threshold, 9) AS threshold, round(known_accept, 9) AS known_accept, round(unknown_reject, 9) AS unknown_reject FROM sw WHERE known_accept + 1e-12 >= 0.9 ORDER BY unknown_reject DESC, known_accept DESC, threshold DESC LIMIT 1""",
    "threshold_sweep": f"""WITH {PRED}, s AS (SELECT round(joint_confidence, 4) AS score, known FROM rows_), {_SWEEP} SELECT round(threshold, 9) AS threshold, round(known_accept, 9) AS known_accept, round(unknown_reject, 9) AS unknown_reject FROM sw""",
    "threshold_grid": f"WITH {PRED}, {_OPEN}, {_GRID} SELECT * FROM grid",
    "threshold_best": f"WITH {PRED}, {_OPEN}, {_GRID} SELECT * FROM grid ORDER BY score DESC, ordinal LIMIT 1",
    "status_thresholds": f"""{_K}, r AS (SELECT round(joint_confidence / greatest(fp[fi + 1], 1e-12), 9) AS q, true_condition = condition AS ok FROM k), t AS (SELECT i::INT AS ordinal, round(0.55 + 0.025 * i, 3)::DOUBLE AS threshold FROM (SELECT unnest(range(11)) AS i)),
c AS (SELECT ordinal, threshold, count(*) AS n, count(*) FILTER (q >= threshold) AS a, count(*) FILTER (q >= threshold AND ok) AS o FROM t CROSS JOIN r GROUP BY ALL), s AS (SELECT ordinal, threshold, coalesce(o / nullif(a, 0)::DOUBLE, 0) AS acc, a / n::DOUBLE AS cov FROM c)
SELECT ordinal, threshold, round(acc, 9) AS accepted_accuracy, round(cov, 9) AS coverage, round(0.75 * acc * cov + 0.25 * cov, 9) AS score FROM s""",
}
