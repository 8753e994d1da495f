"""Exact joins of 63-bit fingerprints by Hamming distance.

The bits are cut into ``distance + 2`` blocks. Two fingerprints within the distance agree on at least two of them, so
they meet under at least one of the keys "pair of blocks and their bits"; each pair is verified, and kept only under the
first pair of blocks on which it agrees, which makes a distinct over candidates unnecessary. Fingerprints are made
distinct before, so any number of copies is one row; callers expand through membership.

Odd input: null fingerprints match nothing; an empty side gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.bits import block, block_layout, hamming

KEY_BITS = 40


def pair_keys(fp: Column, distance: int) -> Column:
    """Array of keys, one for each pair of blocks: the pair's number, then the bits of the two blocks."""
    layout = block_layout(distance + 2)
    out = []
    for n, (i, j) in enumerate(combinations(range(len(layout)), 2)):
        bits = F.shiftleft(block(fp, *layout[i]), layout[j][1]).bitwiseOR(block(fp, *layout[j]))
        out.append(bits.bitwiseOR(F.lit(n << KEY_BITS)))
    return F.array(*out)


def first_mask(difference: Column, distance: int) -> Column:
    """Mask of the two lowest blocks in which the xor of two fingerprints is zero."""
    layout = block_layout(distance + 2)
    equal = None
    for i, (low, width) in enumerate(layout):
        bit = F.when(block(difference, low, width) == 0, F.lit(1 << i)).otherwise(F.lit(0))
        equal = bit if equal is None else equal.bitwiseOR(bit)
    low1 = equal.bitwiseAND(-equal)
    rest = equal.bitwiseXOR(low1)
    return low1.bitwiseOR(rest.bitwiseAND(-rest))


def keyed(prints: DataFrame, fp: str, distance: int) -> DataFrame:
    return prints.select(F.col(fp).alias("fp")).where(F.col("fp").isNotNull()).distinct().select("fp", F.explode(pair_keys(F.col("fp"), distance)).alias("key"))


def near_pairs(left: DataFrame, right: DataFrame | None = None, fp: str = "fp", distance: int = 4) -> DataFrame:
    """(fp_a, fp_b, distance) of distinct fingerprints within the distance.

    With one side: unordered pairs of different fingerprints, fp_a < fp_b. With two: fp_a of the left, fp_b of the
    right, equal ones included.
    """
    # of a self-join both sides are the same columns, so that one exchange serves both
    a = keyed(left, fp, distance).select(F.col("fp").alias("fp_a"), "key")
    b = keyed(left if right is None else right, fp, distance).select(F.col("fp").alias("fp_b"), "key")
    difference = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    masks = F.array(*[F.lit(1 << i | 1 << j) for i, j in combinations(range(distance + 2), 2)])  # a constant
    mask = F.get(masks, F.shiftrightunsigned("key", KEY_BITS).cast("int"))
    pairs = a.join(b, "key").where((F.bit_count(difference) <= distance) & (mask == first_mask(difference, distance)))
    if right is None:
        pairs = pairs.where("fp_a < fp_b")
    return pairs.select("fp_a", "fp_b", hamming(F.col("fp_a"), F.col("fp_b")).alias("distance"))


def duplicates_across(rows: DataFrame, distance: int = 4) -> DataFrame:
    """(row_id_a, row_id_b, distance): pairs of records (row_id, path_k, grp, fp) of different groups within the distance, the
    one earlier by path first. Fingerprints meet as distinct values; only found pairs are expanded to their records."""
    near = near_pairs(rows, distance=distance)
    same = rows.select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"), F.lit(0).alias("distance")).distinct()
    side = lambda x: rows.select(F.col("fp").alias(f"fp_{x}"), F.col("row_id").alias(f"row_{x}"), F.col("grp").alias(f"grp_{x}"), F.struct("path_k", "row_id").alias(f"at_{x}"))
    j = near.unionByName(same).join(side("a"), "fp_a").join(side("b"), "fp_b").where("grp_a != grp_b and (fp_a != fp_b or at_a < at_b)")
    first = F.col("at_a") < F.col("at_b")
    return j.groupBy(F.when(first, F.col("row_a")).otherwise(F.col("row_b")).alias("row_id_a"), F.when(first, F.col("row_b")).otherwise(F.col("row_a")).alias("row_id_b")).agg(F.min("distance").cast("long").alias("distance"))
