"""Exact quantiles of any number of values, by range sort and prefix counts.

Values are counted first, so that copies travel as one row, then range-sorted by class and value. Counts of the partitions
before it tell which partition holds a rank; only there running counts find the value. No class is ever gathered in one
task, whatever its size.

Odd input: null and NaN are no values; a null class is a class; a class without values, or an empty table, gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granaria.session import Workspace


def exact_quantiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """(by, q): an array with the quantile at each point, linear between neighbours."""
    spark = rows.sparkSession
    ws = Workspace(spark, "quantiles")
    key = F.struct(F.lit(0).alias("_"), *by).alias("k")  # structs compare null-safely
    v = F.col(value).cast("double")
    counts = ws.save(rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(key, F.when(v == 0, F.lit(0.0)).otherwise(v).alias("v")).agg(F.count(F.lit(1)).alias("n")), "counts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ws.save(counts.repartitionByRange(parts, "k", "v").withColumn("part", F.spark_partition_id()), "placed")
    # at most a row for each class and partition
    w = Window.partitionBy("k")
    sums = placed.groupBy("k", "part").agg(F.sum("n").alias("n"))
    sums = sums.select("k", "part", "n", (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for i, p in enumerate(points)]))
    aim = sums.select("k", "part", "n", "before", at.alias("p")).select("k", "part", "n", "before", "p.i", "p.at", F.explode(F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at")))).alias("rank"))
    aim = aim.where("rank >= before and rank < before + n").select("k", "part", "i", "at", "rank", (F.col("rank") - F.col("before")).alias("local"))
    running = placed.select("k", "part", "v", "n", F.sum("n").over(Window.partitionBy("k", "part").orderBy("v")).alias("cum"))
    hits = running.join(ws.save(aim, "aim"), ["k", "part"]).where("local < cum and local >= cum - n")
    share = F.when(F.col("rank") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    found = hits.groupBy("k", "i").agg(F.sum(share * F.col("v")).alias("v"))
    return found.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q")).select(*[f"k.{c}" for c in by], "q")
