"""63-bit fingerprints: parsing, printing, bands and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 63


def parse_hex63(c: Column) -> Column:
    """16 hex digits as a non-negative long; anything else, or a set top bit, is null."""
    ok = c.rlike("^[0-7][0-9a-fA-F]{15}$")
    return F.when(ok, F.conv(c, 16, 10).cast("long"))


def to_hex63(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_layout(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``blocks`` disjoint blocks that cover the 63 bits."""
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def block(c: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << width) - 1))
