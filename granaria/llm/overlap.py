"""Same or near-same records across splits.

Method: a weighted cosine join between the train records and the others. The 63 bits are cut into eight blocks (bytes),
and a fingerprint is a vector of 56 terms, one for each three of its blocks; a block value weighs more the rarer it is, and a
term's squared weight is the sum of its three block weights. Two vectors have equal weights on what they share, so with k
shared blocks of total weight s their dot product is (k - 1)(k - 2) / 2 * s.

Fingerprints within four bits share four blocks or more, so their dot product is at least three times the weight of the
four lightest blocks of either: a threshold for each vector. Inverted lists are kept short by three bounds on it:

* residual: 36 of the 56 terms stay out of the lists. They hold no four blocks completely (the lists keep Turan's 20
  threes), so a pair that meets in residual terms only shares one term, and its dot product stays below the threshold of
  any pair that is asked for;
* maximum weight: a block value that the other side doesn't have has maximum weight 0 there. Terms that hold one are
  left out, and a vector whose remaining norm can't reach its threshold is left out whole;
* of all lists in which a pair meets only the first counts it, so no candidate is compared or shuffled twice.

Candidates are kept if their exact dot product reaches both thresholds; an exact check of the bits decides. Block counts
are a table of at most 8 * 256 rows, whatever the input. The two content hashes are terms of their own that decide alone.

All joins run over distinct values (classes); records are attached through membership, and counts come from the counts of
classes, without expanding copies into pairs.

Odd input: values that mean "no value" match nothing; records without one of the three splits take no part; repeated
deliveries of a row are one record; empty sides give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.bits import hamming
from granaria.functions.text import identity
from granaria.llm.fingerprints import BLOCKS, DISTANCE, TERMS, VALUES, WIDTH, manifest_prints, term_key, terms
from granaria.session import Workspace

SHARED = BLOCKS - DISTANCE
#: Greatest block weight; above it in an entry of the weight table: whether train and the other side have the value.
HEAVIEST, IN_TRAIN, IN_OTHER = 127, 1 << 7, 1 << 8
FLAGS = 0x0101010101010101


@dataclass(frozen=True)
class Overlap:
    prints: DataFrame  # row_id, split, source, sha, pix, fp
    links: DataFrame  # fp_a (train), fp_b (val or test), distance, cosine


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit(VALUES - 1)).cast("int")


def _folded(x: Column, *shifts: int) -> Column:
    for n in shifts:
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return x


def block_weights(sided: DataFrame) -> list[int]:
    """Entries by block and value, BLOCKS * VALUES whole numbers: the weight, and which sides have the value.
    ``sided``: fp, in_train, in_eval."""
    pieces = F.explode(F.array(*[F.lit(i * VALUES) + _block(F.col("fp"), i) for i in range(BLOCKS)]))
    counted = sided.select(pieces.alias("b"), "in_train", "in_eval").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.max("in_train").alias("t"), F.max("in_eval").alias("e"))
    rows = counted.collect()  # at most BLOCKS * VALUES rows
    total = sum(r["n"] for r in rows) / BLOCKS
    out = [0] * (BLOCKS * VALUES)
    for r in rows:
        out[r["b"]] = min(HEAVIEST, 1 + round(5 * math.log(1 + total / r["n"]))) | IN_TRAIN * r["t"] | IN_OTHER * r["e"]
    return out


def _entries(fp: Column) -> Column:
    """A fingerprint's eight entries in the one-row table's array ``entries``."""
    return F.array(*[F.get("entries", F.lit(i * VALUES) + _block(fp, i)) for i in range(BLOCKS)])


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, w: s + w)


def _factor(k: Column) -> Column:
    """Threes among k blocks that hold a given one."""
    return ((k - 1) * (k - 2) / 2).cast("int")


def index_terms(prints: DataFrame, weights: DataFrame, other: int) -> DataFrame:
    """(fp, key, term, packed, least) for the listed terms of each fingerprint. ``other`` is the mark of the other side;
    ``packed`` holds the block weights in bytes, ``least`` is the dot product that a pair must reach."""
    x = prints.crossJoin(F.broadcast(weights)).select("fp", F.explode(F.array(_entries(F.col("fp")))).alias("e"))
    w, there = F.transform("e", lambda v: v.bitwiseAND(F.lit(HEAVIEST))), F.transform("e", lambda v: v.bitwiseAND(F.lit(other)) != 0)
    x = x.select("fp", F.explode(F.array(F.struct(w.alias("w"), F.zip_with(w, there, lambda a, t: F.when(t, a).otherwise(0)).alias("m")))).alias("x")).select("fp", "x.w", "x.m")
    packed = F.aggregate(F.reverse("w"), F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, WIDTH).bitwiseOR(v.cast("long")))
    present = F.aggregate("m", F.lit(0), lambda s, v: F.shiftleft(s, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0)))
    least = _sum(F.slice(F.sort_array("w"), 1, SHARED)) * _factor(F.lit(SHARED))
    x = x.select("fp", packed.alias("packed"), least.alias("least"), present.alias("present"), _sum(F.col("m")).alias("heaviest"))
    k = F.bit_count("present")
    x = x.where((k >= SHARED) & (_factor(k) * F.col("heaviest") >= F.col("least")))
    x = x.select("fp", "packed", "least", "present", F.explode(terms()).alias("t")).where("(present & t.mask) = t.mask")
    return x.select("fp", term_key(F.col("fp"), F.col("t")).alias("key"), "t.term", "packed", "least")


def _equal_blocks(a: Column, b: Column) -> Column:
    """A 1 in each byte in which two fingerprints agree."""
    d = a.bitwiseXOR(b)
    d = d.bitwiseOR(F.shiftrightunsigned(d, 4).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F)))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 2).bitwiseAND(F.lit(0x0303030303030303)))
    return F.bitwise_not(_folded(d, 1)).bitwiseAND(F.lit(FLAGS))


def _shared_weight(packed: Column, flags: Column) -> Column:
    """Sum of the bytes of ``packed`` that are flagged."""
    mask = flags
    for n in (1, 2, 4):
        mask = mask.bitwiseOR(F.shiftleft(mask, n))
    x, half = packed.bitwiseAND(mask), F.lit(0x00FF00FF00FF00FF)
    x = x.bitwiseAND(half) + F.shiftrightunsigned(x, 8).bitwiseAND(half)
    x = x + F.shiftrightunsigned(x, 16)
    return (x + F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _first_term(flags: Column) -> Column:
    """The first listed term inside the flagged blocks, -1 without one; the list of 256 answers is a constant."""
    first = [next((n for n, t in enumerate(TERMS) if all(m >> i & 1 for i in t)), -1) for m in range(1 << BLOCKS)]
    return F.get(F.array(*map(F.lit, first)), _folded(flags, 7, 14, 28).bitwiseAND(F.lit(VALUES - 1)).cast("int"))


def candidates(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """(fp_a, fp_b, dot): pairs that meet in a list, each once, whose exact dot product reaches the thresholds of both."""
    a = lists.select(F.col("fp").alias("fp_a"), "key", "term", "packed", F.col("least").alias("least_a"))
    b = queries.select(F.col("fp").alias("fp_b"), "key", F.col("least").alias("least_b"))
    flags = _equal_blocks(F.col("fp_a"), F.col("fp_b"))
    met = a.join(b, "key").where((F.bit_count(flags) >= SHARED) & (_first_term(flags) == F.col("term")))
    dot = _factor(F.bit_count(flags)) * _shared_weight(F.col("packed"), flags)
    return met.select("fp_a", "fp_b", "least_a", "least_b", dot.alias("dot")).where(F.col("dot") >= F.greatest("least_a", "least_b")).select("fp_a", "fp_b", "dot")


def with_cosine(links: DataFrame, weights: DataFrame) -> DataFrame:
    """Exact cosine of pairs (fp_a, fp_b, dot, ...): the dot product over the product of the norms."""
    square = lambda fp: _sum(F.transform(_entries(F.col(fp)), lambda v: v.bitwiseAND(F.lit(HEAVIEST)))) * _factor(F.lit(BLOCKS))
    x = links.crossJoin(F.broadcast(weights)).select(*links.columns, square("fp_a").alias("na"), square("fp_b").alias("nb"))
    return x.select(*[c for c in links.columns if c != "dot"], (F.col("dot") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("cosine"))


def find_overlap(manifest: DataFrame, quality: DataFrame) -> Overlap:
    spark = manifest.sparkSession
    ws = Workspace(spark, "overlap")
    prints = manifest_prints(manifest, quality, identity(F.col("split")).alias("split"), "source")
    prints = ws.save(prints.where(F.col("split").isin("train", "val", "test")), "prints")
    sided = ws.save(prints.where("fp is not null").groupBy("fp").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval")), "sided")
    # one row of BLOCKS * VALUES numbers
    weights = ws.save(spark.createDataFrame([(block_weights(sided),)], "entries array<int>"), "weights")
    lists, queries = index_terms(sided.where("in_train"), weights, IN_OTHER), index_terms(sided.where("in_eval"), weights, IN_TRAIN)
    met = candidates(lists, queries).withColumn("distance", hamming(F.col("fp_a"), F.col("fp_b"))).where(F.col("distance") <= DISTANCE)
    return Overlap(prints, ws.save(with_cosine(met, weights), "links"))


def overlap_pairs(o: Overlap) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: every pair of records, copies expanded."""
    train, other = o.prints.where("split = 'train'"), o.prints.where("split != 'train'")

    def side(rows: DataFrame, value: str, name: str) -> DataFrame:
        return rows.where(F.col(value).isNotNull()).select(F.col(value).alias("k"), F.col("row_id").alias(name)).distinct()

    found = [side(train, v, "x").join(side(other, v, "y"), "k").select("x", "y") for v in ("sha", "pix")]
    near = o.links.select("fp_a", "fp_b").join(side(train, "fp", "x").withColumnRenamed("k", "fp_a"), "fp_a").join(side(other, "fp", "y").withColumnRenamed("k", "fp_b"), "fp_b")
    pairs = found[0].unionByName(found[1]).unionByName(near.select("x", "y"))
    return pairs.where("x != y").select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def overlap_records(o: Overlap) -> DataFrame:
    """One row for each val or test record that meets a train record: how many share its bytes, its pixels, or lie near."""
    train, other = o.prints.where("split = 'train'"), o.prints.where("split != 'train'")
    out = None
    for value, name in (("sha", "same_bytes"), ("pix", "same_pixels"), ("fp", "near")):
        sizes = train.where(F.col(value).isNotNull()).select(value, "row_id").distinct().groupBy(value).agg(F.count(F.lit(1)).alias("n"))
        if value == "fp":
            sizes = o.links.join(sizes.withColumnRenamed("fp", "fp_a"), "fp_a").groupBy(F.col("fp_b").alias("fp")).agg(F.sum("n").alias("n"))
        one = other.select("row_id", "split", "source", value).distinct().join(sizes, value).groupBy("row_id", "split", "source").agg(F.sum("n").alias("n"))
        one = one.select("row_id", "split", "source", *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in ("same_bytes", "same_pixels", "near")])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("row_id", "split", "source").agg(*[F.sum(c).alias(c) for c in ("same_bytes", "same_pixels", "near")])


def overlap_report(o: Overlap) -> DataFrame:
    """Per split and source: records that meet train, by kind, and their links."""
    rows = overlap_records(o)
    kinds = ("same_bytes", "same_pixels", "near")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(c) > 0).alias(f"{c}_records") for c in kinds], *[F.sum(c).alias(f"{c}_links") for c in kinds])
