"""Identity audits and reconciliation of catalogs: duplicates, keys across splits, matches between tables.

Keys without a value never match. Repeated deliveries of a record are one record. Member lists are built from values made
distinct first; where a list could grow with the data (all paths of a hot key), counts are returned instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.paths import SPLITS
from granaria.functions.text import identity, path_key


def records(manifest: DataFrame) -> DataFrame:
    """One row per manifest record with comparable identities: path_k, sha, grp, part (split or null)."""
    return manifest.select(
        "row_id", "path", "fruit", "status", "source",
        path_key(F.col("path")).alias("path_k"), identity(F.col("sha256")).alias("sha"),
        identity(F.col("group_id")).alias("grp"), identity(F.col("split")).alias("part"),
    ).distinct()


KEYS = {"path": "path_k", "sha256": "sha", "group_id": "grp"}


def _keyed(rows: DataFrame) -> DataFrame:
    """(key_name, key, part): the identity keys of all rows, in one pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("key_name"), F.col(c).alias("key")) for n, c in KEYS.items()]))
    return rows.select("row_id", F.coalesce("part", F.lit("")).alias("part"), stacked.alias("x")).select("row_id", "part", "x.*").where("key is not null")


def duplicate_summary(rows: DataFrame) -> DataFrame:
    """(key_name, keys, extra_records) of keys that more than one record holds."""
    n = _keyed(rows).where("key_name != 'group_id'").groupBy("key_name", "key").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").groupBy("key_name").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("extra_records"))


def cross_split(rows: DataFrame, assigned_only: bool = True) -> DataFrame:
    """(key_name, key, records, splits) of keys whose records lie in more than one split.

    Without ``assigned_only`` an unassigned record counts as lying in the split ``''``.
    """
    keyed = _keyed(rows)
    if assigned_only:
        keyed = keyed.where(F.col("part").isin(*SPLITS))
    n = keyed.groupBy("key_name", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("key_name", "key").agg(F.sum("n").alias("records"), F.array_sort(F.collect_set("part")).alias("splits"))
    return per.where(F.size("splits") > 1)


def leakage_summary(rows: DataFrame) -> DataFrame:
    """(key_name, assigned_keys, all_keys): keys across splits among assigned records, and counting unassigned ones."""
    a = cross_split(rows).groupBy("key_name").agg(F.count(F.lit(1)).alias("assigned_keys"))
    b = cross_split(rows, assigned_only=False).groupBy("key_name").agg(F.count(F.lit(1)).alias("all_keys"))
    return b.join(a, "key_name", "left").select("key_name", F.coalesce("assigned_keys", F.lit(0)).alias("assigned_keys"), "all_keys")


def label_conflicts(rows: DataFrame, key: str = "sha") -> DataFrame:
    """(key, records, labels) of content that carries more than one label."""
    keyed = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.concat_ws("::", "fruit", "status").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy("key").agg(F.sum("n").alias("records"), F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matched, left_only, right_only) of two key sets: one full outer join of distinct keys."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): ``missing`` keys of expected that actual lacks, ``extra`` ones the other way round."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    missing = e.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two tables differ as multisets; empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shared_groups(rows: DataFrame, group: str = "grp", part: str = "part") -> DataFrame:
    """(split_a, split_b, groups): groups that two splits share, each pair once."""
    s = rows.where(F.col(group).isNotNull() & F.col(part).isin(*SPLITS)).select(group, part).distinct()
    pairs = s.select(group, F.col(part).alias("split_a")).join(s.select(group, F.col(part).alias("split_b")), group).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("groups"))


def overlap_flags(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``has_<key>`` for each key the reference holds: one join per key with its distinct values (no OR join)."""
    out = rows
    for k in keys:
        there = reference.select(F.col(k)).where(F.col(k).isNotNull()).distinct().withColumn(f"has_{k}", F.lit(True))
        out = out.join(there, k, "left").withColumn(f"has_{k}", F.coalesce(f"has_{k}", F.lit(False)))
    return out


def content_matches(own: DataFrame, others: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(ref, kinds, matches, first_match) for own rows that share content with other references.

    ``own`` and ``others`` hold ``ref`` and the key columns; ``keys`` maps a column to the name of the match kind. A
    reference never matches itself. Values are classes: a row gets the number of matches and the smallest reference.
    """
    out = None
    for column, kind in keys.items():
        refs = others.where(F.col(column).isNotNull()).select(column, "ref").distinct()
        classes = refs.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("m1"))
        second = refs.join(classes.select(column, "m1"), column).where("ref != m1").groupBy(column).agg(F.min("ref").alias("m2"))
        mine = own.where(F.col(column).isNotNull()).select("ref", column).distinct()
        one = mine.join(classes.join(second, column, "left"), column).join(refs.withColumn("inside", F.lit(1)), [column, "ref"], "left")
        first = F.when(F.col("m1") == F.col("ref"), F.col("m2")).otherwise(F.col("m1"))
        one = one.select("ref", F.lit(kind).alias("kind"), (F.col("n") - F.coalesce("inside", F.lit(0))).alias("n"), first.alias("first")).where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"), F.sum("n").alias("matches"), F.min("first").alias("first_match"))


def inherit(rows: DataFrame, earlier: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``inherited``: the value earlier records of the key agree on; conflicting keys give null and ``conflict``."""
    known = earlier.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = rows.join(known, key, "left")
    return joined.select(*rows.columns, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("inherited"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))


def reconcile(catalog: DataFrame, store: DataFrame, assets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """State of every catalog key against a document store and an asset inventory.

    ``conflict``: the store's metadata differ; ``complete``: in both; ``record_only``; ``asset_only``; ``absent``.
    """
    s = store.select(key, F.struct(*columns).alias("theirs"))
    a = assets.select(key).distinct().withColumn("asset", F.lit(True))
    j = catalog.select(key, F.struct(*columns).alias("ours")).join(s, key, "left").join(a, key, "left")
    state: Column = (
        F.when(F.col("theirs").isNotNull() & ~F.col("theirs").eqNullSafe(F.col("ours")), "conflict")
        .when(F.col("theirs").isNotNull() & F.col("asset").isNotNull(), "complete")
        .when(F.col("theirs").isNotNull(), "record_only")
        .when(F.col("asset").isNotNull(), "asset_only")
        .otherwise("absent")
    )
    return j.select(key, state.alias("state"))


def pair_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs joined with the records of both sides: ids, flags for other label and other split, and known digests agreeing."""
    side = lambda x: rows.where("path_k is not null").groupBy("path_k").agg(F.min(F.struct("row_id", "fruit", "status", "sha", "part")).alias(f"r{x}")).withColumnRenamed("path_k", f"k{x}")
    keyed = pairs.select("pair_id", path_key(F.col("path_a")).alias("ka"), path_key(F.col("path_b")).alias("kb"), identity(F.col("sha256_a")).alias("sa"), identity(F.col("sha256_b")).alias("sb"))
    j = keyed.join(side("a"), "ka").join(side("b"), "kb")
    return j.select(
        "pair_id", F.col("ra.row_id").alias("row_id_a"), F.col("rb.row_id").alias("row_id_b"),
        ((F.col("ra.fruit") != F.col("rb.fruit")) | (F.col("ra.status") != F.col("rb.status"))).alias("different_labels"),
        (F.coalesce("ra.part", F.lit("")) != F.coalesce("rb.part", F.lit(""))).alias("cross_split"),
        (F.coalesce(F.col("sa") == F.col("ra.sha"), F.lit(True)) & F.coalesce(F.col("sb") == F.col("rb.sha"), F.lit(True))).alias("digests_agree"),
    )


def distinct_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs as a set."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
