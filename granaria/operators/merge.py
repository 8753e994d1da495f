"""Keyed merges without a table format that has MERGE: one full outer join, columns combined by their role.

Odd input: a null key never matches, so its rows are kept as they are; of incoming rows with one key the first in order
counts, as a whole; incoming rows that differ in a guarded column from each other or from the existing row change
nothing, and ``conflicts`` reports them; an empty side leaves the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicting(incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Keys for which incoming rows disagree on ``column``."""
    return incoming.groupBy(key).agg(F.count_distinct(column).alias("values")).where("values > 1").select(key)


def record_key(digest: Column, url: Column, path: Column) -> Column:
    """The key of a record: its digest, without one its address, without both its path; null without any."""
    named = [F.when(c != "", F.concat(F.lit(kind), c)) for kind, c in (("sha256:", digest), ("url:", url), ("path:", path))]
    return F.coalesce(*named)


def _met(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str], guard: list[str], order: list[str]) -> DataFrame:
    """Existing and incoming rows side by side: ``_row`` is the first incoming row, ``_lo_``/``_hi_`` the extremes of the
    guarded columns, ``_conflict`` whether they forbid the merge."""
    row = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_new_{c}") for c in columns]))
    ends = [f(F.coalesce(F.col(c), F.lit(""))).alias(f"{n}{c}") for c in guard for n, f in (("_lo_", F.min), ("_hi_", F.max))]
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_row"), *ends)
    j = existing.select(key, *dict.fromkeys([*columns, *guard])).withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    differs = F.lit(False)
    for c in guard:
        differs = differs | (F.col(f"_lo_{c}") != F.col(f"_hi_{c}")) | F.coalesce(F.col(c) != F.col(f"_lo_{c}"), F.lit(False))
    return j.withColumn("_conflict", F.col("_row").isNotNull() & F.coalesce(differs, F.lit(False)))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, always: list[str], once: list[str], keep: list[str] = (), guard: list[str] = (), order: list[str] = ()) -> DataFrame:
    """The merged table with ``action`` (inserted, updated, kept, conflict).

    ``always`` columns take the incoming value if there is one, ``once`` columns only on insert, ``keep`` columns are
    filled from the incoming row only where they are empty (curated fields are never overwritten). Where a ``guard``
    column differs, an existing row stays as it is (conflict), and a new key isn't inserted.
    """
    columns = [*always, *once, *keep]
    j = _met(existing, incoming, key, columns, list(guard), list(order)).where("not (_conflict and _old is null)")
    new = lambda c: F.when(~F.col("_conflict"), F.col(f"_row._new_{c}"))
    out = [F.coalesce(new(c), c).alias(c) for c in always]
    out += [F.when(F.col("_old").isNull(), new(c)).otherwise(F.col(c)).alias(c) for c in once]
    out += [F.coalesce(c, new(c)).alias(c) for c in keep]
    action = F.when(F.col("_conflict"), "conflict").when(F.col("_old").isNull(), "inserted").when(F.col("_row").isNotNull(), "updated").otherwise("kept")
    return j.select(key, *out, action.alias("action"))


def conflicts(existing: DataFrame, incoming: DataFrame, key: str, guard: list[str]) -> DataFrame:
    """(key, column_name, existing, least, greatest): guarded columns that differ among incoming rows or from the existing one."""
    j = _met(existing, incoming, key, list(guard), list(guard), []).where("_conflict")
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("existing"), F.col(f"_lo_{c}").alias("least"), F.col(f"_hi_{c}").alias("greatest")) for c in guard]
    x = j.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")
    return x.where((F.col("least") != F.col("greatest")) | (F.col("existing") != F.col("least")))


def update_by_group(rows: DataFrame, groups: DataFrame, group: str, column: str) -> DataFrame:
    """``rows`` with ``column`` set from (group, column) where the group has a value there."""
    new = groups.select(group, F.col(column).alias("_new"))
    return rows.join(new, group, "left").select(*[F.coalesce("_new", c).alias(c) if c == column else F.col(c) for c in rows.columns])


def version_record(rows: DataFrame, version: str, by: list[str]) -> DataFrame:
    """(version, bucket, n): the counts a version record holds."""
    return rows.groupBy(F.concat_ws("/", *by).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), "bucket", "n")
