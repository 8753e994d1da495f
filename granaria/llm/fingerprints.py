"""Content identities of manifest and camera records, and the block keys of fingerprints.

A fingerprint's 63 bits are cut into eight blocks of eight bits. Two fingerprints within four bits agree on four blocks or
more, and of any four blocks the ``TERMS`` hold at least one three completely (Turan's system of 20 threes on three groups
in a ring); so they share the key of at least one of the 20 threes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.bits import parse_hex63
from granaria.functions.text import identity

BLOCKS, WIDTH, DISTANCE = 8, 8, 4
VALUES = 1 << WIDTH


def turan_threes(n: int) -> list[tuple[int, int, int]]:
    """Threes of ``n`` things of which any four things hold at least one: three groups on a ring, threes inside a group,
    and two of a group with one of the next."""
    group = [i % 3 for i in range(n)]

    def kept(three: tuple[int, int, int]) -> bool:
        a, b, c = sorted(group[i] for i in three)
        if a == c:
            return True
        if a == b or b == c:
            pair, single = (a, c) if a == b else (c, a)
            return single == (pair + 1) % 3
        return False

    return [t for t in combinations(range(n), 3) if kept(t)]


TERMS = turan_threes(BLOCKS)


def term_key(fp: Column, term: Column) -> Column:
    """The key of a fingerprint under a term, a struct (term, i, j, k): the term's number, then the three blocks' bits."""
    bits = F.shiftleft(term["term"].cast("long"), 3 * WIDTH)
    for name, low in zip("ijk", (2 * WIDTH, WIDTH, 0), strict=True):
        piece = F.call_function("shiftrightunsigned", fp, term[name] * WIDTH).bitwiseAND(F.lit(VALUES - 1))
        bits = bits.bitwiseOR(F.shiftleft(piece, low))
    return bits


def terms() -> Column:
    """All terms as a constant array of structs (term, i, j, k, mask); bit i of the mask, from the left, is block i."""
    rows = [F.struct(F.lit(n).alias("term"), *[F.lit(i).alias(c) for c, i in zip("ijk", t, strict=True)], F.lit(sum(1 << (BLOCKS - 1 - i) for i in t)).alias("mask")) for n, t in enumerate(TERMS)]
    return F.array(*rows)


def digest(c: Column) -> Column:
    """A hash column as bytes (half the size of its hex text), null where it holds no value."""
    v = identity(c)
    plain = F.when(v.rlike("^[0-9a-f]{64}$"), F.unhex(v)).otherwise(F.encode(v, "UTF-8"))
    return F.when(c.rlike("^[0-9a-fA-F]{64}$"), F.unhex(c)).otherwise(plain)


def fingerprint(c: Column) -> Column:
    return F.coalesce(parse_hex63(c), parse_hex63(identity(c)))


def manifest_prints(manifest: DataFrame, quality: DataFrame, *extra: Column) -> DataFrame:
    """(row_id, sha, pix, fp, *extra) of every manifest record; a record whose inspections disagree has several rows.

    Manifest and image_quality join on the path as spelled. Both sides are placed by path once and made distinct in
    place, so the join needs no further exchange.
    """
    seen = quality.select("path", digest(F.col("pixel_sha256")).alias("pix"), fingerprint(F.col("phash63")).alias("fp")).where("pix is not null or fp is not null")
    rows = manifest.select("row_id", "path", digest(F.col("sha256")).alias("sha"), *extra)
    return rows.repartition("path").distinct().join(seen.repartition("path").distinct(), "path", "left").drop("path")
