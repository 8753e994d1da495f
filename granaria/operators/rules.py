"""Row and table rules as violation tables.

A rule is a code and a condition that says when a row breaks it. ``violations`` evaluates all rules in one pass over the
rows and keeps every message of a row; ``require`` turns a violation table into an error before dependent work starts.
A condition that is null counts as not broken. An empty table breaks no row rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granaria.functions.paths import CLASSES, SPLITS, is_safe, label
from granaria.functions.text import known, path_key
from granaria.functions.vectors import is_distribution

Rules = dict[str, Column]


class RuleError(ValueError):
    """A table breaks a rule that must hold before work goes on."""


def codes(rules: Rules) -> Column:
    """Codes of the rules a row breaks, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def violations(rows: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """(keys, code), one row for each rule each row breaks."""
    return rows.select(*keys, F.explode(codes(rules)).alias("code"))


def counts_by_code(found: DataFrame) -> DataFrame:
    """Violations by the part of the code before ``:``."""
    return found.groupBy(F.split("code", ":")[0].alias("code")).agg(F.count(F.lit(1)).alias("n"))


def require(found: DataFrame, what: str) -> None:
    """Raises with an example if there is any violation. Reads one row."""
    first = found.take(1)
    if first:
        raise RuleError(f"{what}: {first[0].asDict()}")


def empty(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def bad_sha(c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def manifest_rules(allow_unsplit: bool = False) -> Rules:
    """Required fields, safe path, supported labels, split and digest of manifest rows."""
    split_set = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    return {
        **{f"missing:{c}": empty(c) for c in ("path", "fruit", "status", "source", "group_id", "sha256")},
        **({} if allow_unsplit else {"missing:split": empty("split")}),
        "unsafe_path": ~is_safe(F.col("path")),
        "unsupported_label": ~F.coalesce(label(F.col("fruit"), F.col("status")).isin(*CLASSES), F.lit(False)),
        "invalid_split": ~(split_set | empty("split")) if allow_unsplit else ~split_set,
        "invalid_sha256": bad_sha("sha256"),
    }


def other_rules(categories: tuple[str, ...] = ("other_fruit", "non_fruit", "multiple")) -> Rules:
    """Rules of out-of-scope rows."""
    return {
        **{f"missing:{c}": empty(c) for c in ("path", "category", "subcategory", "source", "group_id", "sha256", "split")},
        "unsafe_path": ~is_safe(F.col("path")),
        "invalid_category": ~F.coalesce(F.col("category").isin(*categories), F.lit(False)),
        "invalid_split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "invalid_sha256": bad_sha("sha256"),
    }


def inventory_rules() -> Rules:
    """Consistency of measured inventory rows: labels by kind, evidence for specimens, decode and digest agreement."""
    supported = F.col("label_type") == "SUPPORTED"
    return {
        "label_without_kind": supported & ~F.coalesce(label(F.col("fruit"), F.col("status")).isin(*CLASSES), F.lit(False)),
        "specimen_without_group": known(F.col("specimen_id")) & ~known(F.col("group_id")),
        "group_without_specimen": known(F.col("group_id")) & ~known(F.col("specimen_id")),
        "decode_flag": F.col("decode_ok") != (F.col("decode_status") == "OK"),
        "digest_mismatch": known(F.col("expected_sha256")) & (F.lower("expected_sha256") != F.lower("sha256")),
        "split_before_review": known(F.col("requested_split")) & (F.col("review_status") == "REJECTED"),
    }


def pair_rules() -> Rules:
    """Rules of a candidate pair table: positive id, two different known paths, distance within the radius."""
    return {
        "invalid_pair_id": ~F.coalesce(F.col("pair_id") >= 1, F.lit(False)),
        "missing_path": path_key(F.col("path_a")).isNull() | path_key(F.col("path_b")).isNull(),
        "self_pair": F.coalesce(path_key(F.col("path_a")) == path_key(F.col("path_b")), F.lit(False)),
    }


def probability_rules(p: str, width: int) -> Rules:
    return {"not_a_distribution": ~is_distribution(F.col(p), width)}


def unit_rules(v: str, width: int, tolerance: float = 1e-3) -> Rules:
    """Stored vectors: right length, finite, unit norm."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return {"wrong_length": F.size(v) != width, "not_finite": F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_unit": F.abs(norm - 1) > tolerance}


def repeated(rows: DataFrame, key: Column, *keep: str) -> DataFrame:
    """Rows whose key occurs more than once. Counts first, so a key of any size stays distributed."""
    keyed = rows.withColumn("_k", key).where("_k is not null")
    many = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(many, "_k").select(*keep, F.col("_k").alias("key"), "n")


def spanning(rows: DataFrame, key: Column, over: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, values): keys whose rows hold more than one value of ``over`` (among ``allowed``, if given)."""
    keyed = rows.select(key.alias("key"), F.col(over).alias("v")).where("key is not null and v is not null")
    if allowed:
        keyed = keyed.where(F.col("v").isin(*allowed))
    # distinct values first: a set per key then is as small as the domain of ``over``
    counted = keyed.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("v")).alias("values")).where(F.size("values") > 1)


def differing(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column): where two tables disagree, or one lacks the row (column ``*``). Null equals null."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    b = right.select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, keys, "full_outer")
    one_sided = F.col("a").isNull() | F.col("b").isNull()
    cells = [F.when(~one_sided & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]
    return both.select(*keys, F.explode(F.array_compact(F.array(F.when(one_sided, F.lit("*")), *cells))).alias("column"))


def covers_once(rows: DataFrame, index: str) -> DataFrame:
    """One row (rows, distinct_rows, expected, complete): whether 0..max of ``index`` occur exactly once each."""
    s = rows.agg(F.count(index).alias("rows"), F.count_distinct(index).alias("distinct_rows"), (F.coalesce(F.max(index), F.lit(-1)) + 1).alias("expected"))
    return s.withColumn("complete", (F.col("rows") == F.col("distinct_rows")) & (F.col("rows") == F.col("expected")))


def file_state(now: Column, base: Column, new: Column) -> Column:
    """Three-way state of a patched file: already new, still base, or in conflict."""
    return F.when(now.eqNullSafe(new), "new").when(now.eqNullSafe(base), "base").otherwise("conflict")


def compare_locks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, problem) for two inventories (file, sha256): missing, extra or changed files."""
    both = expected.select("file", F.col("sha256").alias("want")).join(actual.select("file", F.col("sha256").alias("have")), "file", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def compare_counts(found: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose recomputed count ``n`` differs from the reported one; a missing cell counts as 0."""
    both = found.select(*keys, F.col("n").alias("found")).join(reported.select(*keys, F.col("n").alias("reported")), keys, "full_outer").na.fill(0, ["found", "reported"])
    return both.where("found != reported")


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
