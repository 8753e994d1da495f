"""Reproducible split assignment by hash order, with links, frozen splits and group identifiers.

Hash orders make assignments independent of row order and partitioning. Components come from shared keys and pair lists
by hooking and shortcutting. Odd input: rows without any key are components of their own; an empty table assigns nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.hashing import bucket, digest
from granaria.operators.components import connected_components, link_by_keys
from granaria.operators.ordering import ranked


def ranked_split(groups: DataFrame, group: str, stratum: str, seed: int) -> DataFrame:
    """(group, stratum, split): groups of a stratum in order of ``sha256(seed:stratum:group)``, cut at 60/20/20.

    Three groups or more leave no split empty; two go to train and test; one to train.
    """
    order = digest(F.concat_ws(":", F.lit(str(seed)), F.col(stratum), F.col(group)))
    n, r = F.col("_n"), F.col("_rank")
    train = F.when(n >= 3, F.least(F.greatest(F.round(n * 0.6), F.lit(1)), n - 2)).otherwise(1)
    val = F.when(n >= 3, F.least(F.greatest(F.round(n * 0.2), F.lit(1)), n - train - 1)).otherwise(0)
    return ranked(groups.select(group, stratum), [stratum], order, group).select(group, stratum, F.when(r <= train, "train").when(r <= train + val, "val").otherwise("test").alias("split"))


def hash_split(c: Column, seed: int, share: int = 5) -> Column:
    """``val`` for one of ``share`` hash buckets, else ``train``; needs no window and no count."""
    return F.when(bucket(c, seed, share) == 0, "val").otherwise("train")


def every_nth(rows: DataFrame, by: str, key: str, n: int = 4) -> DataFrame:
    """``rows`` with ``calibration``: every n-th row of a class in order of the key's digest, the first included."""
    placed = ranked(rows, [by], digest(F.col(key).cast("string")), key)
    return placed.withColumn("calibration", (F.col("_rank") - 1) % n == 0).drop("_rank", "_n")


def component_ids(rows: DataFrame, id_col: str, keys: list[str], name: str, prefix: str = "v2_") -> DataFrame:
    """(id, component, group_hash): linked rows and a group id made of their sorted names.

    The names are sorted and fed to the hash one by one, so a component of any size needs no list of its names.
    """
    linked = rows.select(id_col, name).distinct().join(link_by_keys(rows, id_col, keys), id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h, empty = None, None, True
        for x in batches:
            done = []
            for component, text in zip(x["component"], x["name"], strict=True):
                if h is None or component != at:
                    if h is not None:
                        done.append((at, prefix + h.hexdigest()[:32]))
                    at, h, empty = component, hashlib.sha256(), True
                if isinstance(text, str):
                    h.update(text.encode() if empty else b"\n" + text.encode())
                    empty = False
            yield pd.DataFrame(done, columns=["component", "group_hash"])
        if h is not None:
            yield pd.DataFrame([(at, prefix + h.hexdigest()[:32])], columns=["component", "group_hash"])

    ordered = linked.select("component", F.col(name).alias("name")).repartition("component").sortWithinPartitions("component", "name")
    named = ordered.mapInPandas(run, f"component {linked.schema['component'].dataType.simpleString()}, group_hash string")
    return linked.join(named, "component").select(id_col, "component", "group_hash")


def coassign(rows: DataFrame, id_col: str, group: str, label: str, pairs: DataFrame, seed: int) -> DataFrame:
    """(id, component, split): groups merged along pairs (a, b of ids); components of several labels go to train."""
    head = rows.groupBy(group).agg(F.min(id_col).alias("head"))
    star = rows.join(head, group).select(F.col(id_col).alias("a"), F.col("head").alias("b"))
    roots = connected_components(star.unionByName(pairs.select("a", "b"))).select(F.col("v").alias(id_col), "root")
    j = rows.join(roots, id_col, "left").select(id_col, label, F.coalesce("root", id_col).alias("component"))
    per = j.groupBy("component").agg(F.count_distinct(label).alias("labels"), F.min(label).alias("stratum"))
    pure = ranked_split(per.where("labels = 1").select("component", "stratum"), "component", "stratum", seed).select("component", "split")
    mixed = per.where("labels > 1").select("component", F.lit("train").alias("split"))
    return j.select(id_col, "component").join(pure.unionByName(mixed), "component").select(id_col, "component", "split")


def freeze_and_extend(rows: DataFrame, id_col: str, keys: list[str], frozen: str, label: str, seed: int) -> DataFrame:
    """(id, component, split, conflict): a component takes the split its frozen rows have; several are a conflict (null).

    Components without a frozen row: mixed labels go to train, the others are ranked within their label.
    """
    j = rows.select(id_col, frozen, label).join(link_by_keys(rows, id_col, keys), id_col)
    per = j.groupBy("component").agg(F.min(frozen).alias("lo"), F.max(frozen).alias("hi"), F.count_distinct(label).alias("labels"), F.min(label).alias("stratum"))
    fresh = ranked_split(per.where("lo is null and labels = 1").select("component", "stratum"), "component", "stratum", seed).select("component", F.col("split").alias("ranked"))
    out = per.join(fresh, "component", "left").select("component", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), None).otherwise(F.coalesce("ranked", F.lit("train"))).alias("split"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))
    return j.select(id_col, "component").distinct().join(out, "component").select(id_col, "component", "split", "conflict")


def freeze_groups(rows: DataFrame, id_col: str, group: str, digest_col: str, split: str) -> DataFrame:
    """(id, component, split, conflict): the older freeze. Groups that share a digest are one; a component keeps the split it
    has (several are a conflict, null), and one without any goes to train."""
    j = rows.select(id_col, split).join(link_by_keys(rows, id_col, [group, digest_col]), id_col)
    per = j.groupBy("component").agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    out = per.select("component", F.when(F.col("lo").isNull(), "train").when(F.col("lo") == F.col("hi"), F.col("lo")).alias("split"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))
    return j.select(id_col, "component").distinct().join(out, "component").select(id_col, "component", "split", "conflict")


def reviewed_split(rows: DataFrame, id_col: str, keys: list[str], baseline: str, split: str, requested: str, group: str, seed: int) -> DataFrame:
    """(id, split, problem) for new rows linked to a baseline.

    A component keeps its one frozen or requested split; without any the hash of its smallest group decides 80/20 between
    train and val. ``problem``: ``crosses_splits`` or ``touches_test`` where no split may be given.
    """
    j = rows.select(id_col, baseline, split, requested, group).join(link_by_keys(rows, id_col, keys), id_col)
    seen = F.when(F.col(baseline), F.col(split)).when(F.col(requested).isin("train", "val"), F.col(requested))
    per = j.groupBy("component").agg(
        F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.max(F.col(baseline) & (F.col(split) == "test")).alias("test"),
        F.max(~F.col(baseline)).alias("fresh"), F.min(group).alias("g"),
    )
    problem = F.when(F.col("lo") != F.col("hi"), "crosses_splits").when(F.col("test") & F.col("fresh"), "touches_test")
    out = per.select("component", problem.alias("problem"), F.coalesce("lo", hash_split(F.coalesce("g", F.col("component").cast("string")), seed)).alias("new_split"))
    return j.where(~F.col(baseline)).join(out, "component").select(id_col, F.when(F.col("problem").isNull(), F.col("new_split")).alias("split"), "problem")


def merge_report(old: DataFrame, new: DataFrame, id_col: str, old_group: str, new_group: str) -> DataFrame:
    """(old_groups, new_groups, merged_components, largest, split_old_groups) of a regrouping."""
    j = old.select(id_col, old_group).join(new.select(id_col, new_group), id_col)
    pairs = j.groupBy(new_group, old_group).agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy(new_group).agg(F.count(F.lit(1)).alias("olds"), F.sum("n").alias("size"))
    a = per.agg(F.count(F.lit(1)).alias("new_groups"), F.count_if(F.col("olds") > 1).alias("merged_components"), F.max("size").alias("largest"))
    b = pairs.groupBy(old_group).agg(F.count(F.lit(1)).alias("news")).agg(F.count(F.lit(1)).alias("old_groups"), F.count_if(F.col("news") > 1).alias("split_old_groups"))
    return a.crossJoin(b)
