"""Digests, hash buckets and reproducible hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def bucket(c: Column, seed: int, modulus: int) -> Column:
    """``int(sha256(f"{seed}:{c}")[:16], 16) % modulus``; the 64-bit number is unsigned, so it is taken as a decimal."""
    h = digest(F.concat(F.lit(f"{seed}:"), c))
    return (F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def pixel_digest(width: Column, height: Column, pixels: Column) -> Column:
    """Identity of decoded content: the size in text, then the RGB bytes."""
    head = F.concat(F.lit("RGB:"), width.cast("string"), F.lit(":"), height.cast("string"), F.lit(":"))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), pixels), 256)


def canonical_json_hash(names: list[str]) -> Column:
    """Hash of a row's JSON with sorted keys and no blanks."""
    return digest(F.to_json(F.struct(*sorted(names))))
