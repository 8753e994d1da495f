"""Summaries: dense grids, exact quantiles, histograms, tag counts, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.tags import split_tags
from granaria.functions.text import known
from granaria.operators.quantiles import exact_quantiles


def dimension(df: DataFrame, name: str, values: tuple) -> DataFrame:
    """A small fixed dimension as a table."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def dense_counts(rows: DataFrame, dims: dict[str, tuple]) -> DataFrame:
    """Counts of every combination of the dimensions' fixed values; absent ones are 0.

    The grid has as many rows as the dimensions' product, so crossing it is free of the data's size.
    """
    grid = reduce(lambda a, b: a.crossJoin(b), [dimension(rows, n, v) for n, v in dims.items()])
    counted = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, list(dims), "left").select(*dims, F.coalesce("n", F.lit(0)).alias("n"))


def quantile_summary(rows: DataFrame, by: list[str], measures: list[str], points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), digits: int | None = 6) -> DataFrame:
    """(by, measure, n, min, p10, ..., max, mean): exact quantiles with linear interpolation, rounded unless ``digits`` is None.

    The values are unpivoted, so all measures share one range sort.
    """
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select(*by, "x.*").where("v is not null and not isnan(v)")
    keys = [*by, "measure"]
    s = long.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m")).alias("s")
    q = exact_quantiles(long, keys, "v", points).alias("q")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in keys])
    s = s.join(q, same).select(*[f"s.{c}" for c in (*keys, "n", "lo", "hi", "m")], "q.q")
    rnd = lambda c: c if digits is None else F.round(c, digits)
    return s.select(*by, "measure", "n", rnd(F.col("lo")).alias("min"), *[rnd(F.col("q")[i]).alias(f"p{round(p * 100):02d}") for i, p in enumerate(points)], rnd(F.col("hi")).alias("max"), rnd(F.col("m")).alias("mean"))


def edge_histogram(rows: DataFrame, value: Column, edges: tuple[float, ...], by: list[str]) -> DataFrame:
    """(by, bin, n): counts below the first edge, between edges (lower edge included), and from the last on; dense bins."""
    place = reduce(lambda c, e: c + F.when(value >= e, 1).otherwise(0), edges, F.lit(0))
    counts = [F.count_if(place == i).alias(f"b{i}") for i in range(len(edges) + 1)]
    wide = rows.where(value.isNotNull()).groupBy(*by).agg(*counts)
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"b{i}").alias("n")) for i in range(len(edges) + 1)]))
    return wide.select(*by, bins.alias("x")).select(*by, "x.*")


def tag_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(split_tags(F.col(column))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, rows): values that are set, for each column, in one aggregate."""
    s = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(known(F.col(c).cast("string"))).alias(c) for c in columns])
    return s.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("x.*", "rows")


def below_minimum(rows: DataFrame, by: list[str], least: int, key: str) -> DataFrame:
    """(by, n, extra_copies, enough): rows and repeated keys by group against a minimum."""
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(key) - F.count_distinct(key)).alias("extra_copies"))
    return s.withColumn("enough", F.col("n") >= least)


def composite_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, n) over ``a/b/c``; null parts count as ``UNKNOWN``."""
    key = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in columns])
    return rows.groupBy(key.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def melt(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return rows.unpivot(ids, columns, "variable", "value")
