"""Order-dependent operators as windows and folds: first seen, running best, ranks, limits.

Every order is made total by a last key, so results don't depend on partitioning. Windows are partitioned by content
keys; where a content key may hold a third of all rows, the first row is found by an aggregate (``min`` of a struct)
instead of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granaria.session import Workspace


def ranked(rows: DataFrame, by: list[str], order: Column, tie: str) -> DataFrame:
    """``rows`` with ``_rank`` (from 1) and ``_n`` of their class, in order of a hex digest.

    The first three digits cut a class into 4096 even ranges; their counts, summed, say where a range begins, so no class is
    one task, whatever its size. Null classes are a class.
    """
    ws = Workspace(rows.sparkSession, "ranked")
    x = ws.save(rows.withColumn("_o", order).withColumn("_k", F.struct(F.lit(0).alias("_"), *by)).withColumn("_b", F.substring("_o", 1, 3)), "rows")
    w = Window.partitionBy("_k")  # at most 4096 rows for each class
    counts = x.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_k", "_b", (F.sum("n").over(w.orderBy("_b")) - F.col("n")).alias("_before"), F.sum("n").over(w).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_o", tie))
    return x.withColumn("_own", own).join(before, ["_k", "_b"]).withColumn("_rank", F.col("_own") + F.col("_before")).select(*rows.columns, "_rank", "_n")


def keep_first(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``kept`` and ``duplicate_of``: of the rows with one key only the first in order is kept.

    Rows without a key are kept. The first row comes from an aggregate and is joined back.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, name)).alias("_first"))
    j = rows.join(first, key, "left")
    mine = F.col("_first").isNull() | (F.struct(*order, name) == F.col("_first"))
    return j.select(*rows.columns, mine.alias("kept"), F.when(~mine, F.col(f"_first.{name}")).alias("duplicate_of"))


def earlier_reference(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """(columns, reference): the first row in order with the same key, null for that row itself."""
    return keep_first(rows, key, order, name).withColumnRenamed("duplicate_of", "reference").drop("kept")


def repeats_within(rows: DataFrame, source: str, key: str) -> DataFrame:
    """(source, key, n) of keys that occur more than once in a source."""
    return rows.where(F.col(key).isNotNull()).groupBy(source, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_per_class(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each class in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def capped(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows in order with ``complete``: whether that is all of them. Reads cap + 1 rows."""
    some = rows.orderBy(*order).limit(cap + 1)
    w = Window.orderBy(*order)  # over at most cap + 1 rows
    return some.select("*", F.row_number().over(w).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n")).where(F.col("_r") <= cap).withColumn("complete", F.col("_n") <= cap).drop("_r", "_n")


def pair_order() -> list[Column]:
    """Review order of candidate pairs: other labels first, then other splits, then distance and ids."""
    return [F.col("different_labels").desc(), F.col("cross_split").desc(), F.col("distance").asc(), F.col("row_id_a").asc(), F.col("row_id_b").asc()]


def early_stop(history: DataFrame, run: str, step: str, value: str, tie: str, patience: int, tolerance: float = 1e-6) -> DataFrame:
    """(run, best_step, best_value, stopped_at) of metric series.

    A step is better if its value exceeds the best by more than ``tolerance``, or equals it within the tolerance with a
    smaller ``tie`` value. A series stops after ``patience`` steps without a better one (null if it runs to its end). The
    fold runs over a series' own steps.
    """
    start = F.struct(F.lit(None).cast("long").alias("best_step"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("tie"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def fold(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (x["v"] > s["best"] + tolerance) | ((F.abs(x["v"] - s["best"]) <= tolerance) & (x["t"] < s["tie"]))
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        moved = F.struct(
            F.when(better, x["s"]).otherwise(s["best_step"]).alias("best_step"),
            F.when(better, x["v"]).otherwise(s["best"]).alias("best"),
            F.when(better, x["t"]).otherwise(s["tie"]).alias("tie"),
            bad.alias("bad"),
            F.when(bad >= patience, x["s"]).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    steps = F.array_sort(F.collect_list(F.struct(F.col(step).cast("long").alias("s"), F.col(value).cast("double").alias("v"), F.col(tie).cast("double").alias("t"))))
    folded = history.groupBy(run).agg(F.aggregate(steps, start, fold).alias("f"))
    return folded.select(run, F.col("f.best_step").alias("best_step"), F.col("f.best").alias("best_value"), F.col("f.stop").alias("stopped_at"))
