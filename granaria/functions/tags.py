"""Multi-value text (``a;b;c``), flags and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<distance:int,reference:string>>"
# Annotation values and the hard-case tags they stand for.
HARD_CASES = {
    "lighting": {"normal": "normal", "low_light": "low_light", "dark": "low_light", "uneven": "uneven_lighting", "uneven_lighting": "uneven_lighting", "overexposed": "overexposed"},
    "distance": {"far": "far", "small_object": "small_object"},
    "angle": {"tilted": "tilted"},
    "background": {"complex": "complex_background"},
    "occlusion": {"hand_held": "hand_held", "partial": "occlusion", "true": "occlusion"},
    "multiple_objects": {"true": "multiple_objects"},
    "noise": {"true": "noisy", "noisy": "noisy"},
    "blur": {"true": "blurry", "blurry": "blurry"},
    "glare": {"true": "glare"},
    "severity": {"small_defect": "small_defect", "severe_rotten": "severe_rotten"},
}


def split_tags(c: Column) -> Column:
    """The tags of ``a;b``, none for null, empty and ``NONE``."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: ~t.isin("", "NONE"))


def join_flags(flags: dict[str, Column], empty: str = "NONE") -> Column:
    """Names of the flags that hold, in order, joined by ``;``."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))
    return F.when(F.size(names) > 0, F.array_join(names, ";")).otherwise(empty)


def join_sorted(values: Column, empty: str = "") -> Column:
    """Distinct values in order, joined by ``;``."""
    v = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.when(F.size(v) > 0, F.array_join(v, ";")).otherwise(empty)


def hard_case_tags(fields: dict[str, Column]) -> Column:
    """Tags of the annotated fields that are present, sorted and distinct; ``UNKNOWN`` without any."""
    found = []
    for name, c in fields.items():
        pairs = [F.lit(x) for kv in HARD_CASES[name].items() for x in kv]
        found.append(F.try_element_at(F.create_map(*pairs), F.lower(F.coalesce(c.cast("string"), F.lit("")))))
    return join_sorted(F.array(*found), "UNKNOWN")


def parse_matches(c: Column) -> Column:
    """A JSON list of (distance, reference), nearest first; null where the text is missing or cut off."""
    return F.array_sort(F.filter(F.from_json(c, MATCHES), lambda m: m["reference"].isNotNull()))
