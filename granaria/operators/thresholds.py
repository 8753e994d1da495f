"""Choosing thresholds on scored rows.

Sweeps over every distinct score use cumulative counts instead of comparing each threshold with each row. The counts are
aggregated per score first; the running sums are taken in two levels (bucket totals, then inside each bucket), so no
task sees all scores. Ties between equally good thresholds are broken by a stated order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granaria.functions.rates import count_if, safe_div
from granaria.operators.quantiles import exact_quantiles

BUCKETS = 1024


def sweep(rows: DataFrame, score: str, known: str) -> DataFrame:
    """(threshold, known_accept, unknown_reject) for every distinct score, 0 and 1; accepting means score >= threshold.

    Scores lie in [0, 1].
    """
    s = rows.select(F.col(score).alias("t"), F.col(known).cast("long").alias("k"), (~F.col(known)).cast("long").alias("u"))
    ends = rows.sparkSession.range(1).select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("u"))
    per = s.unionByName(ends).where("t is not null").groupBy("t").agg(F.sum("k").alias("k"), F.sum("u").alias("u")).withColumn("b", F.least(F.floor(F.col("t") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    totals = per.groupBy("b").agg(F.sum("k").alias("bk"), F.sum("u").alias("bu"))
    above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over at most BUCKETS rows
    totals = totals.select("b", F.coalesce(F.sum("bk").over(above), F.lit(0)).alias("k0"), F.coalesce(F.sum("bu").over(above), F.lit(0)).alias("u0"))
    inside = Window.partitionBy("b").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.join(totals, "b").select("t", (F.col("k0") + F.sum("k").over(inside)).alias("k"), (F.col("u0") + F.sum("u").over(inside)).alias("u"))
    whole = per.agg(F.sum("k").alias("nk"), F.sum("u").alias("nu"))
    j = run.crossJoin(F.broadcast(whole))
    return j.select(F.col("t").alias("threshold"), F.try_divide("k", "nk").alias("known_accept"), (1 - F.try_divide("u", "nu")).alias("unknown_reject"))


def select_threshold(rows: DataFrame, score: str, known: str, min_known_accept: float) -> DataFrame:
    """One row: the threshold with the highest (unknown_reject, known_accept, threshold) that accepts enough known rows.

    If none does, the quantile of the known scores at ``1 - min_known_accept``.
    """
    s = sweep(rows, score, known)
    key = F.struct("unknown_reject", "known_accept", "threshold")
    best = s.where(F.col("known_accept") + 1e-12 >= min_known_accept).agg(F.max(key).alias("k"))
    spare = exact_quantiles(rows.where(known), [], score, (max(0.0, 1.0 - min_known_accept),)).select(F.col("q")[0].alias("q"))
    return best.join(spare, how="left").select(F.coalesce("k.threshold", "q").alias("threshold"), F.col("k.known_accept").alias("known_accept"), F.col("k.unknown_reject").alias("unknown_reject"))


def grid_search(rows: DataFrame, probabilities: list[float], margins: list[float]) -> DataFrame:
    """(ordinal, min_probability, min_margin, coverage, accepted_accuracy, false_acceptance, score), best grid point first
    by score, then by grid order. ``rows``: in_scope, top_ok, is_other, p, margin.

    The grid is a fixed list; every point is a set of conditional counts of one pass, so rows are not crossed with it.
    """
    points = [(i, p, m) for i, (p, m) in enumerate((p, m) for p in probabilities for m in margins)]
    aggs = [F.count_if("in_scope").alias("n_in"), F.count_if(~F.col("in_scope")).alias("n_out")]
    for i, p, m in points:
        acc = ~F.col("is_other") & (F.col("p") >= p) & (F.col("margin") >= m)
        aggs += [count_if(acc & F.col("in_scope")).alias(f"a{i}"), count_if(acc & F.col("in_scope") & F.col("top_ok")).alias(f"c{i}"), count_if(acc & ~F.col("in_scope")).alias(f"f{i}")]
    wide = rows.agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(p).alias("min_probability"), F.lit(m).alias("min_margin"), F.col(f"a{i}").alias("a"), F.col(f"c{i}").alias("c"), F.col(f"f{i}").alias("f")) for i, p, m in points]))
    x = wide.select("n_in", "n_out", cells.alias("x")).select("n_in", "n_out", "x.*")
    x = x.select("ordinal", "min_probability", "min_margin", safe_div(F.col("a"), F.col("n_in")).alias("coverage"), safe_div(F.col("c"), F.col("a")).alias("accepted_accuracy"), safe_div(F.col("f"), F.col("n_out")).alias("false_acceptance"))
    score = 0.5 * F.col("accepted_accuracy") + 0.3 * F.col("coverage") + 0.2 * (1 - F.col("false_acceptance"))
    return x.withColumn("score", score)


def best_point(grid: DataFrame) -> DataFrame:
    """The grid row with the highest score; on equal scores the first in grid order."""
    return grid.agg(F.max_by(F.struct(*grid.columns), F.struct("score", -F.col("ordinal"))).alias("b")).select("b.*")


def status_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(ordinal, threshold, accepted_accuracy, coverage, score) with score 0.75 accuracy coverage + 0.25 coverage; rows: p, ok."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        aggs += [count_if(F.col("p") >= t).alias(f"a{i}"), count_if((F.col("p") >= t) & F.col("ok")).alias(f"c{i}")]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("threshold"), F.col(f"a{i}").alias("a"), F.col(f"c{i}").alias("c")) for i, t in enumerate(thresholds)]))
    x = rows.agg(*aggs).select("n", cells.alias("x")).select("n", "x.*")
    x = x.select("ordinal", "threshold", safe_div(F.col("c"), F.col("a")).alias("accepted_accuracy"), safe_div(F.col("a"), F.col("n")).alias("coverage"))
    return x.withColumn("score", 0.75 * F.col("accepted_accuracy") * F.col("coverage") + 0.25 * F.col("coverage"))
