"""Text and identity normalisation as JVM-side column functions.

Spark SQL has no Unicode normalisation, but ships ICU; it is reached by reflection, only for values that hold
anything beyond ASCII. Every function maps null to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ASCII = r"[^\x00-\x7F]"
# Spellings that mean "no value".
NO_VALUE = ("", "unknown", "not_available")
SENTINELS = ("", "UNKNOWN", "NOT_AVAILABLE", "UNASSIGNED", "NONE")


def _icu(cls: str, method: str, c: Column, flag: bool) -> Column:
    # the argument is never null, also where the optimizer pulls the call out of its condition
    return F.java_method(F.lit(cls), F.lit(method), F.coalesce(c, F.lit("")), F.lit(flag))


def nfc(c: Column) -> Column:
    return F.when(c.rlike(NON_ASCII), _icu("com.ibm.icu.text.Normalizer", "compose", c, False)).otherwise(c)


def nfkd(c: Column) -> Column:
    return F.when(c.rlike(NON_ASCII), _icu("com.ibm.icu.text.Normalizer", "decompose", c, True)).otherwise(c)


def fold(c: Column) -> Column:
    """Full case folding (``ß`` becomes ``ss``)."""
    return F.when(c.rlike(NON_ASCII), _icu("com.ibm.icu.lang.UCharacter", "foldCase", c, True)).otherwise(F.lower(c))


def strip(c: Column) -> Column:
    """Outer white space of every kind, tabs and no-break spaces too."""
    return F.regexp_replace(c, r"(?U)^[\s ]+|[\s ]+$", "")


def clean(c: Column) -> Column:
    """``trim`` with null as the empty string, as every text column of a scan is read."""
    return F.coalesce(strip(c), F.lit(""))


def _folded(c: Column) -> Column:
    """NFC and case folding, with the reflective calls only for values beyond ASCII."""
    beyond = _icu("com.ibm.icu.lang.UCharacter", "foldCase", _icu("com.ibm.icu.text.Normalizer", "compose", c, False), True)
    return F.when(c.rlike(NON_ASCII), beyond).otherwise(F.lower(c))


def identity(c: Column) -> Column:
    """Comparable form of group_id, split, sha256, pixel_sha256 and phash63; null where there is no value."""
    s = strip(c)
    return F.when(~F.lower(s).isin(*NO_VALUE), _folded(s))


def path_key(c: Column) -> Column:
    """Path identity: ``\\`` as ``/``, letter case, Unicode composition and outer white space ignored; empty is null."""
    s = F.translate(strip(c), "\\", "/")
    return F.when(s != "", _folded(s))


def norm(c: Column) -> Column:
    """Path identity that also collapses inner white space."""
    return F.regexp_replace(_folded(strip(c)), r"(?U)\s+", " ")


def known(c: Column) -> Column:
    """Whether a text value is set: not null, empty or one of the sentinel words."""
    return F.coalesce(~F.upper(strip(c)).isin(*SENTINELS), F.lit(False))


def strict_bool(c: Column) -> Column:
    """``true``/``false`` text as a boolean, empty or null as null; anything else raises."""
    v = F.lower(strip(c))
    return (
        F.when(v == "true", F.lit(True))
        .when(v == "false", F.lit(False))
        .when(v.isNull() | (v == ""), F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), v)).cast("boolean"))
    )
