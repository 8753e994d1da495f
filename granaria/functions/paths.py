"""Paths: safety, prefixes, labels in folder names, and what file names say about an image's origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granaria.functions.text import norm

# The label sets.
FRUITS = ("apple", "banana", "orange", "tomato")
STATES = ("fresh", "rotten")
SPLITS = ("train", "val", "test")
CLASSES = tuple(f"{f}::{s}" for f in FRUITS for s in STATES)
# File name patterns (transform prefixes, numbered originals, augmented copies without a known parent).
TRANSFORMED = r"(?i)^((?:(?:rotated_by_-?\d+(?:\.\d+)?|saltandpepper|translation|vertical_flip|horizontal_flip)_)*)(Screen\s+Shot\s+.+)$"
NUMBERED = r"(?i)^(fresh|rotten)(apple|banana|orange|tomato)\s*\(\d+\)$"
ORPHANED = r"(?i)^Banana__Healthy_augmented_\d+$"


def slashed(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def is_safe(c: Column) -> Column:
    """Relative, not empty, and free of ``..`` steps, colons and NUL; null counts as empty."""
    p = slashed(F.coalesce(c, F.lit("")))
    return (p != "") & ~p.startswith("/") & ~p.rlike("[:\\x00]") & ~F.array_contains(F.split(p, "/", -1), "..")


def strip_prefix(c: Column, prefix: str) -> Column:
    """Removes the steps of ``prefix``, compared without case; null where the path doesn't continue after it."""
    steps = [s for s in prefix.replace("\\", "/").split("/") if s]
    parts = F.split(slashed(c), "/", -1)
    if not steps:
        return slashed(c)
    head = F.transform(F.slice(parts, 1, len(steps)), F.lower)
    matches = (F.size(parts) > len(steps)) & (head == F.array(*[F.lit(s.lower()) for s in steps]))
    return F.when(matches, F.array_join(F.slice(parts, F.lit(len(steps) + 1), F.size(parts)), "/"))


def below_root(c: Column, root: str) -> Column:
    """A catalog path relative to ``root``: either below it, or starting with a fruit folder already; else null."""
    p = slashed(c)
    inside = F.substring(p, len(root) + 2, 1 << 20)
    return F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), inside).when(F.split(p, "/")[0].isin(*FRUITS), p)


def file_name(c: Column) -> Column:
    return F.element_at(F.split(slashed(c), "/", -1), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def folder_labels(c: Column) -> Column:
    """(fruit, status) from the two folders above the file, null where they are none of the labels."""
    parts = F.split(slashed(c), "/", -1)
    fruit, status = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    return F.when(fruit.isin(*FRUITS) & status.isin(*STATES), F.struct(fruit.alias("fruit"), status.alias("status")))


def other_category(c: Column) -> Column:
    """(category, subcategory) of an out-of-scope path: ``[other/]fruit|non_fruit|multiple/<sub>/<file>``."""
    p = F.split(F.regexp_replace(slashed(c), "^other/", ""), "/", -1)
    # Folder names and their categories.
    names = F.create_map(*[F.lit(x) for x in ("fruit", "other_fruit", "other_fruit", "other_fruit", "non_fruit", "non_fruit", "multiple", "multiple")])
    return F.when((F.size(p) >= 3) & names[p[0]].isNotNull(), F.struct(names[p[0]].alias("category"), p[1].alias("subcategory")))


def label(fruit: Column, status: Column) -> Column:
    return F.concat_ws("::", fruit, status)


def file_kind(path: Column, fruit: Column, status: Column) -> Column:
    """(family, kind, reason, agrees) told by the file name; ``agrees`` is false where its labels contradict the row."""
    s = stem(path)
    screen, numbered, orphan = s.rlike(TRANSFORMED), s.rlike(NUMBERED), s.rlike(ORPHANED)
    changed = F.regexp_extract(s, TRANSFORMED, 1) != ""
    family = F.when(screen, F.concat(F.lit("screen::"), norm(F.regexp_extract(s, TRANSFORMED, 2)))).when(orphan, "").when(numbered, F.concat(F.lit("numbered::"), norm(s))).otherwise("")
    kind = F.when(screen & changed, "offline_augmentation").when(screen, "candidate_original").when(orphan, "offline_augmentation_unknown_parent").when(numbered, "candidate_original").otherwise("unrecognized_filename")
    reason = (
        F.when(screen & changed, "offline_augmentation_known_parent")
        .when(orphan, "offline_augmentation_parent_unknown")
        .when(screen | numbered, "")
        .otherwise("unrecognized_filename_needs_source_mapping")
    )
    same = (F.lower(F.regexp_extract(s, NUMBERED, 1)) == status) & (F.lower(F.regexp_extract(s, NUMBERED, 2)) == fruit)
    return F.struct(family.alias("family"), kind.alias("kind"), reason.alias("reason"), F.when(numbered & ~screen, F.coalesce(same, F.lit(False))).otherwise(F.lit(True)).alias("agrees"))


def safe_name(number: Column, c: Column) -> Column:
    """File name for an exported sample: a six-digit number and the path with all but word characters replaced."""
    return F.substring(F.concat(F.format_string("%06d_", number), F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")), 1, 180)


def asset_digest(c: Column) -> Column:
    """The digest in a stored asset's id: its base name up to the first dot."""
    return F.regexp_extract(c, r"([^/.]*)(?:\.[^/]*)?$", 1)
