"""Strict load of raw CSV records, with the records that can't be loaded set apart with their reason.

Method. The raw offsets (line ids, and a hash of the delivered text) are kept; only records that conform in dialect, width
and values are loaded, typed; the loaded offsets are subtracted from the raw ones (anti-join of offsets, no text is
shuffled for it), and only the texts of that remainder are read again and diagnosed.

Dialect: comma, fields optionally in double quotes, a quote inside written twice, commas and line breaks allowed inside
quotes; a byte order mark at the start and a carriage return at the end are no part of the record. Cut at its quotes, a
record's pieces lie in turn outside and inside of quotes; it is well quoted if their number is odd and each outer piece
touches its quotes with a comma, or is an empty one between two inner pieces (a doubled quote). That needs no
backtracking, so very long records are safe.

Odd input: a null record has one empty field and fails for its columns; empty text likewise; records repeated under
their id are judged by delivery: a broken one is rejected also where another one of its id loads. Deliveries of one id
and the same text share their fate, and each is in the output it belongs to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granaria.functions.text import strip

FIELDS = ("path", "fruit", "status", "source", "group_id", "sha256", "split")
# The allowed words of a manifest row.
FRUITS = ("apple", "banana", "orange", "tomato")
STATES = ("fresh", "rotten")
SPLITS = ("train", "val", "test", "")


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    rejected: DataFrame


def _record(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), "^\\uFEFF|\\r\\z", "")


def _pieces(rows: DataFrame) -> DataFrame:
    """Adds ``_p``, the record cut at its quotes, as a generated column: it is computed once for each record."""
    return rows.select("_key", "_text", F.explode(F.array(F.split(_record(F.col("_text")), '"', -1))).alias("_p"))


def _well_quoted(pieces: Column) -> Column:
    last = F.size(pieces) - 1
    bad = F.transform(
        pieces,
        lambda s, i: F.when(i % 2 == 1, F.lit(False))
        .when((i > 0) & (i < last) & (s == ""), F.lit(False))
        .otherwise(((i > 0) & (s != "") & ~s.startswith(",")) | ((i < last) & (s != "") & ~s.endswith(","))),
    )
    return (last % 2 == 0) & ~F.exists(bad, lambda b: b)


def _fields(pieces: Column) -> Column:
    """Fields of a well-quoted record. Inner commas are carried over the split under an escape of their own."""
    last = F.size(pieces) - 1
    mark = lambda s: F.replace(s, F.lit("\x01"), F.lit("\x01a"))
    joined = F.array_join(
        F.transform(
            pieces,
            lambda s, i: F.when(i % 2 == 1, F.replace(mark(s), F.lit(","), F.lit("\x01b")))
            .when((i > 0) & (i < last) & (s == ""), F.lit('"'))
            .otherwise(mark(s)),
        ),
        "",
    )
    return F.transform(F.split(joined, ",", -1), lambda f: strip(F.replace(F.replace(f, F.lit("\x01b"), F.lit(",")), F.lit("\x01a"), F.lit("\x01"))))


def valid_values(f: Column) -> Column:
    """Rules on the seven trimmed fields."""
    path = F.replace(f[0], F.lit("\\"), F.lit("/"))
    return (
        ~F.exists(F.slice(f, 1, 6), lambda x: x == "")
        & f[1].isin(*FRUITS)
        & f[2].isin(*STATES)
        & f[6].isin(*SPLITS)
        & f[5].rlike("^[0-9a-f]{64}$")
        & ~path.startswith("/")
        & ~F.array_contains(F.split(path, "/", -1), "..")
        & ~path.rlike("[:\\x00]")
    )


def strict_load(raw: DataFrame, key: str = "line_id", text: str = "raw_line") -> Loaded:
    """``rows``: the key and the seven typed fields of every record that conforms; ``rejected``: key, text and reason."""
    kept = raw.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    cut = _pieces(kept)
    fields = F.when(_well_quoted(F.col("_p")), _fields(F.col("_p")))
    # one-element arrays: a filter on what they hold is not pushed below them, where it would repeat their work
    cut = cut.select("_key", "_text", F.explode(F.array(fields)).alias("_f"))
    conforms = F.coalesce((F.size("_f") == len(FIELDS)) & valid_values(F.col("_f")), F.lit(False))
    rows = cut.where(conforms).select(F.col("_key").alias(key), *[F.col("_f")[i].alias(name) for i, name in enumerate(FIELDS)])
    rows = rows.withColumn("split", F.when(F.col("split") != "", F.col("split")))

    offset = F.struct(F.col("_key").alias("key"), F.xxhash64("_text", F.length("_text")).alias("delivery"))
    loaded = cut.where(conforms).select(offset.alias("_at"))
    left = kept.select(offset.alias("_at")).join(loaded, "_at", "left_anti").distinct()
    remainder = _pieces(kept.withColumn("_at", offset).join(left, "_at", "left_semi"))
    rejected = remainder.select(
        F.col("_key").alias(key),
        F.col("_text").alias(text),
        F.when(~_well_quoted(F.col("_p")), "quoting").when(F.size(_fields(F.col("_p"))) != len(FIELDS), "columns").otherwise("value").alias("reason"),
    )
    return Loaded(rows, rejected)
