"""Splits that keep related records together.

Method. Records that share a key value (group, and any further keys asked for) are linked; hooking and shortcutting over
parent tables gives components. Components that span strata are placed first, by what they add to each stratum: largest
first, where they push the strata least over their targets, then single moves and exchanges while those lessen what lies
over a target. Within each stratum the sizes of the remaining components are counted with their multiplicities, and a
subset-sum bitset over them picks, split by split, the total closest to what is left of the target.

A bitset over every copy isn't needed. Filling one size after the other up to the target is a vertex of the relaxed
problem, and a best whole solution lies within 2 * largest + 1 copies of a vertex (proximity of integer programs with one
constraint, Eisenbrand and Weismantel); so only that many copies of a size stay open, and the bitset's length depends on
the sizes that occur, and on the number of records only while that is smaller.

The tables that reach one task are histograms: distinct sizes of a stratum, and distinct vectors of sizes over strata.
Ranks within a size come from salted counts, so a size that a third of all records have is no window of its own.

Odd input: a record without a key value is a component of its own; a component larger than a target goes where it
distorts least; repeated rows of an id are one record; null strata are strata; no records give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granaria.functions.text import identity
from granaria.operators.components import find_hubs, join_hubs, link_by_keys, save_counted
from granaria.session import Workspace

SALT = 256
#: Shapes tried against each other in one exchange step; the best of either split.
TRIED = 300


def subset_near(items: list[tuple[int, int]], target: float) -> dict[int, int]:
    """Copies of each size whose sum comes closest to ``target`` (the smaller sum on a tie); items: (size, copies)."""
    if target <= 0 or not items:
        return {}
    open_ = 3 * max(s for s, _ in items) + 2
    left, out, choice = target, {}, []
    for size, copies in sorted(items, reverse=True):
        filled = min(copies, int(max(0.0, left) // size))
        left -= filled * size
        low = max(0, filled - open_)
        out[size] = low
        choice.append((size, min(copies, filled + open_) - low))
    target -= sum(s * n for s, n in out.items())
    for size, n in _closest(choice, target).items():
        out[size] += n
    return {s: n for s, n in out.items() if n}


def _closest(items: list[tuple[int, int]], target: float) -> dict[int, int]:
    """The same by a bitset over all sums of the copies, by halves of their numbers."""
    reach, trail = 1, []
    total = sum(s * m for s, m in items)
    mask = (1 << (min(total, int(2 * target) + 2 + max(s for s, _ in items)) + 1)) - 1
    for size, copies in items:
        step = 1
        while copies:
            take = min(step, copies)
            trail.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            copies -= take
            step *= 2
    down = int(target)
    below = (reach & ((1 << (down + 1)) - 1)).bit_length() - 1
    rest = reach >> (down + 1)
    above = down + 1 + (rest & -rest).bit_length() - 1 if rest else None
    goal = below if above is None or target - below <= above - target else above
    out: dict[int, int] = {}
    for size, take, before in reversed(trail):
        if not before >> goal & 1:
            out[size] = out.get(size, 0) + take
            goal -= size * take
    return out


def deal(sizes: dict[int, int], targets: dict[str, float]) -> dict[str, dict[int, int]]:
    """Copies of each size for each split so that the sums come near the targets: the smallest target first, the last
    split takes the rest."""
    left = dict(sizes)
    order = sorted(targets, key=lambda s: (targets[s], s))
    given: dict[str, dict[int, int]] = {s: {} for s in targets}
    for name in order[:-1]:
        given[name] = subset_near([(s, m) for s, m in left.items() if m], targets[name])
        for size, n in given[name].items():
            left[size] -= n
    given[order[-1]] = {s: m for s, m in left.items() if m}
    return given


def place_vectors(vectors: np.ndarray, copies: np.ndarray, wants: np.ndarray) -> np.ndarray:
    """Copies of each vector for each split. vectors: (shapes, strata), wants: (strata, splits).

    What lies over a target is the sum over strata and splits of the records beyond it. Copies of a shape go one by one,
    the largest shape first, where that grows least, then where the fullest stratum stays least full.
    """
    splits = wants.shape[1]
    given = np.zeros((len(vectors), splits), np.int64)
    used = np.zeros(wants.shape)
    room = np.maximum(wants, 1e-9)

    def over(u: np.ndarray) -> np.ndarray:
        return np.maximum(u - wants, 0).sum(-2)

    for i in np.lexsort((np.arange(len(vectors)), -vectors.sum(1))):
        v, left = vectors[i][:, None].astype(float), int(copies[i])
        at = v[:, 0] > 0
        while left:
            then = used + v
            excess = over(then) - over(used)
            fullest = (then[at] / room[at]).max(0)
            best = min(range(splits), key=lambda k: (round(excess[k], 9), fullest[k], k))
            # copies that go the same way: as long as the split stays the least full one after a tenth of them
            n = max(1, left // 10) if (then[at, best] + (left // 10) * v[at, 0] <= wants[at, best]).all() else 1
            given[i, best] += n
            used[:, best] += n * v[:, 0]
            left -= n
    while True:
        now = over(used)
        gain, step = 1e-9, None
        for a in range(splits):
            for b in range(splits):
                if a == b:
                    continue
                own = np.flatnonzero(given[:, a])
                if not len(own):
                    continue
                away = np.maximum(used[:, a] - vectors[own] - wants[:, a], 0).sum(1) - now[a]
                here = np.maximum(used[:, b] + vectors[own] - wants[:, b], 0).sum(1) - now[b]
                k = int((away + here).argmin())
                if -(away + here)[k] > gain:
                    gain, step = -(away + here)[k], [(own[k], a, b)]
                if a < b:
                    other = np.flatnonzero(given[:, b])
                    if not len(other):
                        continue
                    back = np.maximum(used[:, b] - vectors[other] - wants[:, b], 0).sum(1)
                    x, y = own[np.argsort(away, kind="stable")[:TRIED]], other[np.argsort(back, kind="stable")[:TRIED]]
                    move = vectors[y][None, :, :] - vectors[x][:, None, :]
                    change = np.maximum(used[:, a] + move - wants[:, a], 0).sum(2) - now[a] + np.maximum(used[:, b] - move - wants[:, b], 0).sum(2) - now[b]
                    k = int(change.argmin())
                    if -change.flat[k] > gain:
                        gain, step = -change.flat[k], [(x[k // len(y)], a, b), (y[k % len(y)], b, a)]
        if step is None:
            return given
        for i, a, b in step:
            given[i, a] -= 1
            given[i, b] += 1
            used[:, a] -= vectors[i]
            used[:, b] += vectors[i]


def _ranges(shape: str, given: Iterable[tuple[str, int]]) -> list[tuple]:
    """(shape, split, low, high): ranks of the copies that each split takes."""
    rows, at = [], 0
    for name, n in given:
        if n:
            rows.append((shape, name, at, at + n))
            at += n
    return rows


QUOTA = "shape string, split string, low long, high long"


def _dealer(names: list[str]):
    """Quotas of one stratum: rows (shape, stratum, size, copies, want_0, ...)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        targets = {n: float(pdf[f"want_{i}"].iloc[0]) for i, n in enumerate(names)}
        sizes = pdf["size"].astype(int)
        dealt = deal(dict(zip(sizes, pdf["copies"].astype(int), strict=True)), targets)
        rows = [r for shape, size in zip(pdf["shape"], sizes, strict=True) for r in _ranges(shape, [(n, dealt[n].get(size, 0)) for n in names])]
        return pd.DataFrame(rows, columns=["shape", "split", "low", "high"])

    return run


def _placer(names: list[str]):
    """Quotas of all spanning shapes: rows (shape, copies, strata, sizes, wants), wants a list by split for each stratum."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shape")
        place, targets = {}, []
        for strata, wants in zip(pdf["strata"], pdf["wants"], strict=True):
            for s, w in zip(strata, wants, strict=True):
                if s not in place:
                    place[s] = len(place)
                    targets.append(list(w))
        vectors = np.zeros((len(pdf), len(place)))
        for i, (strata, sizes) in enumerate(zip(pdf["strata"], pdf["sizes"], strict=True)):
            vectors[i, [place[s] for s in strata]] = sizes
        given = place_vectors(vectors, pdf["copies"].to_numpy(), np.array(targets, dtype=float))
        rows = [r for shape, g in zip(pdf["shape"], given, strict=True) for r in _ranges(shape, zip(names, map(int, g), strict=True))]
        return pd.DataFrame(rows, columns=["shape", "split", "low", "high"])

    return run


def _ranked(ws: Workspace, comps: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(comps with a rank within their shape, (shape, copies)) for comps (component, shape, ...)."""
    comps = comps.withColumn("salt", F.pmod(F.xxhash64("component"), F.lit(SALT)))
    salted = ws.save(comps.groupBy("shape", "salt").agg(F.count(F.lit(1)).alias("n")), f"{name}_salted")
    before = Window.partitionBy("shape").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most SALT rows
    offset = salted.select("shape", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shape", "salt").orderBy(F.xxhash64("component", F.lit(1)), "component")
    ranked = comps.withColumn("rank", F.row_number().over(own) - 1).join(offset, ["shape", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    return ranked, salted.groupBy("shape").agg(F.sum("n").alias("copies"))


def _chosen(ranked: DataFrame, quota: DataFrame) -> DataFrame:
    return ranked.join(quota, "shape").where("rank >= low and rank < high").select("component", "split")


def assign_splits(records: DataFrame, targets: dict[str, float], keys: Iterable[str] = ("group",)) -> DataFrame:
    """(row_id, stratum, component, old_split, split) for records (row_id, stratum, split, *keys)."""
    ws = Workspace(records.sparkSession, "splits")
    names, keys = list(targets), list(keys)
    whole = sum(targets.values())
    shares = [targets[n] / whole for n in names]
    records = ws.save(records.select("row_id", F.coalesce("stratum", F.lit("")).alias("stratum"), F.col("split").alias("old_split"), *keys).distinct(), "records")
    linked, total = save_counted(ws, records.join(link_by_keys(records, "row_id", keys), "row_id"), "linked")
    cells = ws.save(linked.groupBy("component", "stratum").agg(F.count_distinct("row_id").alias("size")), "cells")
    sizes = ws.save(cells.groupBy("stratum").agg(F.sum("size").alias("all")), "sizes")  # a row for each stratum
    form = cells.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("stratum", "size"))).alias("cells"))
    form = ws.save(form.select("component", "n", "cells", F.to_json("cells").alias("shape")), "form")

    mixed, shapes = _ranked(ws, form.where("n > 1"), "mixed")
    wants = F.array(*[F.col("all") * s for s in shares])
    open_ = form.where("n > 1").select("shape", "cells").distinct().select("shape", F.explode("cells").alias("c")).select("shape", "c.stratum", "c.size").join(sizes, "stratum")
    open_ = open_.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("stratum", "size", wants.alias("w")))).alias("x"))
    open_ = open_.join(shapes, "shape").select("shape", "copies", F.col("x.stratum").alias("strata"), F.col("x.size").alias("sizes"), F.col("x.w").alias("wants"))
    quota = ws.save(open_.groupBy(F.lit("*").alias("all")).applyInPandas(_placer(names), QUOTA), "mixed_quota")
    placed = ws.save(_chosen(mixed, quota), "placed")

    used = cells.join(placed, "component").groupBy("stratum").agg(*[F.sum(F.when(F.col("split") == n, F.col("size")).otherwise(0)).alias(f"used_{i}") for i, n in enumerate(names)])
    wants = sizes.join(used, "stratum", "left").select("stratum", *[(F.col("all") * s - F.coalesce(f"used_{i}", F.lit(0))).alias(f"want_{i}") for i, s in enumerate(shares)])
    single, shapes = _ranked(ws, form.where("n = 1").select("component", "shape"), "single")
    part = F.from_json("shape", "array<struct<stratum:string,size:bigint>>")[0]
    open_ = shapes.select("shape", "copies", part["stratum"].alias("stratum"), part["size"].alias("size")).join(wants, "stratum")
    quota = ws.save(open_.groupBy("stratum").applyInPandas(_dealer(names), QUOTA), "single_quota")
    placed = ws.save(placed.unionByName(_chosen(single, quota)), "all_placed")
    return join_hubs(linked, placed, "component", find_hubs(ws, linked, "component", total, "hubs")).select("row_id", "stratum", "component", "old_split", "split")


def manifest_records(manifest: DataFrame) -> DataFrame:
    """The records as the operator takes them; a stratum is a fruit and a status."""
    return manifest.select("row_id", F.concat_ws("/", "fruit", "status").alias("stratum"), identity(F.col("split")).alias("split"), identity(F.col("group_id")).alias("group")).distinct()


def broken_groups(records: DataFrame, keys: Iterable[str] = ("group",), splits: Iterable[str] = ("train", "val", "test")) -> DataFrame:
    """(component, records, splits) of the components whose records lie in two or more of the splits today."""
    keys = list(keys)
    keyed = records.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    linked = keyed.join(link_by_keys(keyed, "row_id", keys), "row_id")
    flags = [F.max(F.col("split") == s).alias(s) for s in splits]
    found = linked.groupBy("component").agg(F.count_distinct("row_id").alias("records"), *flags)
    present = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in splits]))
    return found.select("component", "records", present.alias("splits")).where(F.size("splits") >= 2)


def split_shares(assigned: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(stratum, split, records, share, target_share)."""
    whole = sum(targets.values())
    per = assigned.groupBy("stratum").agg(*[F.count_if(F.col("split") == n).alias(f"n_{i}") for i, n in enumerate(targets)], F.count(F.lit(1)).alias("all"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.col(f"n_{i}").alias("records"), F.lit(t / whole).alias("target_share")) for i, (n, t) in enumerate(targets.items())]))
    return per.select("stratum", "all", rows.alias("x")).select("stratum", "x.split", "x.records", (F.col("x.records") / F.col("all")).alias("share"), "x.target_share")


def invariants(assigned: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(stratum, split, stratum_records, on_target, whole_components): whether the split holds its share of the stratum to
    one record (strata of fewer than 100 records, whose groups are too coarse for that, are not held to it), and whether no
    component of the stratum lies in two splits."""
    per = assigned.groupBy("component").agg(F.count_distinct("split").alias("splits"))
    broken = assigned.select("stratum", "component").distinct().join(per.where("splits != 1"), "component", "left_semi").groupBy("stratum").agg(F.count(F.lit(1)).alias("broken"))
    shares = split_shares(assigned, targets).join(assigned.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_records")), "stratum").join(broken, "stratum", "left")
    near = F.abs(F.col("records") - F.col("target_share") * F.col("stratum_records")) <= 1
    near = near | (F.col("stratum_records") < 100)
    return shares.select("stratum", "split", "stratum_records", near.alias("on_target"), F.col("broken").isNull().alias("whole_components"))
