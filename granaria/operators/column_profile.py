"""Column-level data quality profile of a table that arrives in loads, and what changed from load to load.

Method. The checked columns are unpivoted to (column, load, value) and counted, so that copies of one value, however
many, travel as one row. The counts are range-sorted by (column, value). Each partition keeps running counts per
(column, load) and the extremes of the difference of neighbouring loads' cumulative curves; adding the counts of the
partitions before it turns those into exact quantiles, distinct counts and Kolmogorov-Smirnov distances. No value list
is ever gathered in one task.

Results for odd input: a null is missing; NaN, a value outside the range or a word outside the allowed set is invalid;
quantiles, distances and distinct numeric counts are of valid values and null where there are none; an empty table gives
empty results; rows repeated in a load count again; a null load is a load of its own, before all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granaria.functions.rates import count_if, ratio
from granaria.session import Workspace

PARTS = "kind int, part int, col int, seq int, value double, n long, cum long, before long, low double, high double"


@dataclass(frozen=True)
class Checks:
    """What to profile: numeric columns with their valid range (None: open), categorical ones with their allowed words."""

    numeric: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.words]

    def valid(self, name: str) -> Column:
        """True for a valid value, false for an invalid one, null for null."""
        c = F.col(name)
        if name in self.words:
            return c.isin(*self.words[name])
        v, (low, high) = c.cast("double"), self.numeric[name]
        ok = ~F.isnan(v) & F.when(c.isNotNull(), F.lit(True))
        if low is not None:
            ok = ok & (v >= low)
        if high is not None:
            ok = ok & (v <= high)
        return ok


@dataclass(frozen=True)
class Profile:
    stats: DataFrame  # one row per load and column
    drift: DataFrame  # one row per load, but the first, and column
    findings: DataFrame


def load_stats(df: DataFrame, load: str, checks: Checks) -> DataFrame:
    """(load_id, column_name, rows, nulls, invalid, valid, min_value, max_value) by one map-side-combined aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(checks.names):
        ok, v = checks.valid(name), F.col(name)
        number = F.when(ok, v.cast("double")) if name in checks.numeric else F.lit(None).cast("double")
        aggs += [
            count_if(v.isNull()).alias(f"nulls_{i}"),
            count_if(~ok).alias(f"invalid_{i}"),
            count_if(ok).alias(f"valid_{i}"),
            F.min(number).alias(f"min_{i}"),
            F.max(number).alias(f"max_{i}"),
        ]
    wide = df.groupBy(F.col(load).alias("load_id")).agg(*aggs)
    long = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("col"),
                    F.lit(name).alias("column_name"),
                    *[F.col(f"{k}_{i}").alias(a) for k, a in (("nulls", "nulls"), ("invalid", "invalid"), ("valid", "valid"), ("min", "min_value"), ("max", "max_value"))],
                )
                for i, name in enumerate(checks.names)
            ]
        )
    )
    return wide.select("load_id", "rows", long.alias("x")).select("load_id", "rows", "x.*")


def with_previous(stats: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds ``seq`` (order of the load) and ``prev_*`` columns of the load before; the table has one row per load and column."""
    w = Window.partitionBy(*keys).orderBy(F.col("load_id").asc_nulls_first())
    return stats.select("*", F.row_number().over(w).alias("seq"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def _curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over one partition sorted by (col, value): the value rows with running counts, then one summary row per (col, load).

    A summary holds the rows of the load (``n``), of the load before (``before``) and the least and greatest difference
    of their local cumulative shares, taken after each distinct value.
    """
    part = TaskContext.get().partitionId()
    own: dict[tuple, int] = {}
    seen: dict[tuple, list] = {}  # (col, seq): rows of seq, rows of seq - 1, least, greatest
    rest: pd.DataFrame | None = None

    def running(keys: np.ndarray, amounts: np.ndarray, start: dict) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        k = keys[:, order]
        total = np.cumsum(amounts[order])
        first = np.r_[True, np.any(k[:, 1:] != k[:, :-1], axis=0)] if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        base = np.array([start.get(tuple(k[:, i]), 0) for i in at]) - (total[at] - amounts[order][at])
        total = total + np.repeat(base, np.diff(np.r_[at, len(order)]))
        for i, e in zip(at, np.r_[at[1:], len(order)], strict=True):
            start[tuple(k[:, i])] = total[e - 1]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def process(x: pd.DataFrame) -> pd.DataFrame:
        col, seq, n, value = (x[c].to_numpy() for c in ("col", "seq", "n", "value"))
        cum = running(np.stack([col, seq]), n, own)
        # each row moves the curve of its own load and, as the earlier one, that of the next load
        c2, s2 = np.r_[col, col], np.r_[seq, seq + 1]
        a, b = np.r_[n, np.zeros_like(n)], np.r_[np.zeros_like(n), n]
        v2 = np.r_[value, value]
        na, nb = np.r_[x["total"], x["next_total"]], np.r_[x["prev_total"], x["total"]]
        order = np.lexsort((v2, s2, c2))
        c2, s2, a, b, v2, na, nb = (y[order] for y in (c2, s2, a, b, v2, na, nb))
        edge = np.r_[np.flatnonzero((c2[1:] != c2[:-1]) | (s2[1:] != s2[:-1])) + 1, len(c2)]
        begin = 0
        for end in edge:
            if begin == end:
                continue
            key = (c2[begin], s2[begin])
            state = seen.setdefault(key, [0, 0, 0.0, 0.0])
            ca, cb = state[0] + np.cumsum(a[begin:end]), state[1] + np.cumsum(b[begin:end])
            last = np.r_[v2[begin + 1 : end] != v2[begin : end - 1], True]
            if na[begin] > 0 and nb[begin] > 0:
                gap = ca[last] / na[begin] - cb[last] / nb[begin]
                state[2], state[3] = min(state[2], gap.min()), max(state[3], gap.max())
            state[0], state[1] = ca[-1], cb[-1]
            begin = end
        return pd.DataFrame({"kind": 0, "part": part, "col": col, "seq": seq, "value": value, "n": n, "cum": cum, "before": 0, "low": 0.0, "high": 0.0})

    for batch in batches:
        x = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        same = (x["col"] == x["col"].iloc[-1]) & (x["value"] == x["value"].iloc[-1]) if len(x) else None
        if same is None:
            continue
        rest = x[same]
        if not same.all():
            yield process(x[~same].reset_index(drop=True))
    if rest is not None and len(rest):
        yield process(rest.reset_index(drop=True))
    if seen:
        rows = [(1, part, int(c), int(s), 0.0, int(v[0]), 0, int(v[1]), float(v[2]), float(v[3])) for (c, s), v in seen.items()]
        yield pd.DataFrame(rows, columns=["kind", "part", "col", "seq", "value", "n", "cum", "before", "low", "high"])


def profile(df: DataFrame, load: str, checks: Checks, quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> Profile:
    """Profiles every load of ``df`` and compares it with the load of the next smaller ``load``."""
    spark = df.sparkSession
    ws = Workspace(spark, "column-profile")
    numeric = list(checks.numeric)
    prev = ["load_id", "rows", "nulls", "valid"]
    base = ws.save(with_previous(load_stats(df, load, checks), ["col", "column_name"], prev), "base")

    # ---- values of numeric columns, counted, range-sorted, folded once per partition
    number = F.col("x.value")
    counts = (
        df.select(F.col(load).alias("load_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.when(checks.valid(c), F.col(c).cast("double")).alias("value")) for i, c in enumerate(numeric)])).alias("x"))
        .where(number.isNotNull())
        .groupBy("load_id", "x.col", F.when(number == 0, F.lit(0.0)).otherwise(number).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        if numeric
        else spark.createDataFrame([], f"load_id {df.schema[load].dataType.simpleString()}, col int, value double, n long")
    )
    w = Window.partitionBy("col").orderBy("seq")
    totals = base.select(F.col("load_id"), "col", "seq", F.col("valid").alias("total"), F.coalesce("prev_valid", F.lit(0)).alias("prev_total"), F.coalesce(F.lead("valid").over(w), F.lit(0)).alias("next_total"))
    counts = ws.save(counts, "counts")  # the range sort reads them twice, once to sample its bounds
    keyed = counts.alias("c").join(totals.alias("t"), F.col("c.load_id").eqNullSafe(F.col("t.load_id")) & (F.col("c.col") == F.col("t.col")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.select("c.col", "seq", "value", "n", "total", "prev_total", "next_total").repartitionByRange(parts, "col", "value").sortWithinPartitions("col", "value", "seq")
    folded = ws.save(ordered.mapInPandas(_curves, PARTS), "folded", partition_by=["kind"])

    w = Window.partitionBy("col", "seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    curve = ws.save(
        folded.where("kind = 1").select("part", "col", "seq", "n", "before", "low", "high", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("before").over(w), F.lit(0)).alias("before0")),
        "curve",
    )
    lag = F.col("n0") / F.col("total") - F.col("before0") / F.col("prev_total")
    ks = (
        curve.join(totals.where("total > 0 and prev_total > 0").select("col", "seq", "total", "prev_total"), ["col", "seq"])
        .groupBy("col", "seq")
        .agg(F.max(F.greatest(F.abs(lag), F.abs(lag + F.col("low")), F.abs(lag + F.col("high")))).alias("ks_distance"))
    )
    places = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.lit(q) * (F.col("total") - 1)).alias("at")) for q in quantiles]))
    ranks = totals.where("total > 0").select("col", "seq", places.alias("p")).select("col", "seq", "p.q", "p.at", F.explode(F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at")))).alias("rank"))
    aim = ws.save(
        ranks.join(curve.select("part", "col", "seq", "n", "n0"), ["col", "seq"]).where((F.col("rank") >= F.col("n0")) & (F.col("rank") < F.col("n0") + F.col("n"))).select("part", "col", "seq", "q", "at", "rank", (F.col("rank") - F.col("n0")).alias("local")),
        "aim",
    )
    values = folded.where("kind = 0").select("part", "col", "seq", "value", "n", "cum")
    hits = aim.join(values, ["part", "col", "seq"]).where((F.col("local") < F.col("cum")) & (F.col("local") >= F.col("cum") - F.col("n")))
    # linear interpolation between the two neighbours of the place
    share = F.when(F.col("rank") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    quantile = hits.groupBy("col", "seq", "q").agg(F.sum(share * F.col("value")).alias("v"))
    curve_stats = quantile.groupBy("col", "seq").agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"q{round(q * 100):02d}") for q in quantiles])
    distinct = values.groupBy("col", "seq").agg(F.count(F.lit(1)).alias("numbers"))

    # ---- words of categorical columns
    words = [(len(numeric) + i, c) for i, c in enumerate(checks.words)]
    spread = (
        df.select(F.col(load).alias("load_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("word")) for i, c in words])).alias("x"))
        .where(F.col("x.word").isNotNull())
        .groupBy("load_id", "x.col", "x.word")
        .agg(F.count(F.lit(1)).alias("n"))
        if words
        else spark.createDataFrame([], f"load_id {df.schema[load].dataType.simpleString()}, col int, word string, n long")
    )
    seqs = base.select("load_id", "col", "seq", (F.col("rows") - F.col("nulls")).alias("filled"), (F.col("prev_rows") - F.col("prev_nulls")).alias("prev_filled"))
    spread = ws.save(spread.alias("c").join(seqs.alias("t"), F.col("c.load_id").eqNullSafe(F.col("t.load_id")) & (F.col("c.col") == F.col("t.col"))).select("c.col", "seq", "word", "n"), "words")
    moved = spread.select("col", "seq", "word", "n", F.lit(0).cast("long").alias("n_prev")).unionByName(spread.select("col", (F.col("seq") + 1).alias("seq"), "word", F.lit(0).cast("long").alias("n"), F.col("n").alias("n_prev")))
    moved = moved.groupBy("col", "seq", "word").agg(F.sum("n").alias("n"), F.sum("n_prev").alias("n_prev"))
    # |n/N - m/M| > 1/10 in whole numbers: 10 |nM - mN| > NM
    big = lambda c: F.col(c).cast("decimal(19,0)")
    tenth = F.abs(big("n") * big("prev_filled") - big("n_prev") * big("filled")) * 10 > big("filled") * big("prev_filled")
    shift = (
        moved.join(seqs.where("filled > 0 and prev_filled > 0").select("col", "seq", "filled", "prev_filled"), ["col", "seq"])
        .groupBy("col", "seq")
        .agg(F.max(F.abs(F.col("n") / F.col("filled") - F.col("n_prev") / F.col("prev_filled"))).alias("share_shift"), F.max(tenth).alias("shifted"))
    )
    distinct = distinct.unionByName(spread.groupBy("col", "seq").agg(F.count(F.lit(1)).alias("numbers")))

    joined = base.join(curve_stats, ["col", "seq"], "left").join(distinct, ["col", "seq"], "left")
    middle = "q50" if 0.5 in quantiles else None
    median = F.col(middle) if middle else F.lit(None).cast("double")
    stats = ws.save(
        joined.select(
            "load_id", "col", "column_name", "seq", "rows", "nulls", "invalid", "valid",
            ratio(F.col("nulls"), F.col("rows")).alias("null_share"),
            ratio(F.col("invalid"), F.col("rows") - F.col("nulls")).alias("invalid_share"),
            F.coalesce("numbers", F.lit(0)).alias("distinct_values"), "min_value", "max_value",
            *[f"q{round(q * 100):02d}" for q in quantiles],
            median.alias("median"), "prev_load_id", "prev_rows", "prev_nulls",
        ),
        "stats",
    )
    w = Window.partitionBy("col").orderBy("seq")
    change = stats.select("*", F.lag("median").over(w).alias("prev_median")).where("seq > 1").join(ks, ["col", "seq"], "left").join(shift, ["col", "seq"], "left")
    nulls_moved = F.abs(big("nulls") * big("prev_rows") - big("prev_nulls") * big("rows")) * 10 > big("rows") * big("prev_rows")
    median_moved = (F.col("median") * 3 < F.col("prev_median") * 2) | (F.col("median") * 2 > F.col("prev_median") * 3)
    drift = change.select(
        "load_id", "column_name", "prev_load_id",
        (ratio(F.col("nulls"), F.col("rows")) - ratio(F.col("prev_nulls"), F.col("prev_rows"))).alias("null_share_change"),
        "median", "prev_median", "ks_distance", "share_shift",
        F.coalesce(nulls_moved, F.lit(False)).alias("nulls_moved"),
        F.coalesce(median_moved, F.col("shifted"), F.lit(False)).alias("drifted"),
    )
    out_of_range = stats.where(big("invalid") * 50 > big("rows") - big("nulls")).select("load_id", "column_name", F.when(F.col("col") < len(numeric), "range").otherwise("pattern").alias("finding"))
    findings = out_of_range.unionByName(drift.where("nulls_moved").select("load_id", "column_name", F.lit("nulls").alias("finding"))).unionByName(drift.where("drifted").select("load_id", "column_name", F.lit("drift").alias("finding")))
    return Profile(stats.drop("col", "seq", "median", "prev_load_id", "prev_rows", "prev_nulls"), drift, findings)
