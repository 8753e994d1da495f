"""Mixing sources to target weights.

Method: hierarchical budgeting over a tree domain - language - source. A source's target share is divided over its
languages in proportion to their tokens; weights add up towards the root. The budget flows down: each node divides it
among its children by weight, a child never gets more than its documents can give (tokens times allowed repeats), and
what a child can't use goes to its siblings, and only if all of them are full to the other children of the ancestor.
Each leaf then takes whole epochs of its documents, and of the last, seeded epoch the prefix whose tokens come closest
to its budget. Prefixes are found from token sums of hash buckets, so a leaf of any size is never one task.

Without a budget the mix is the largest in which every source that has documents can still reach its share.

The driver handles one row per leaf (sources times languages), no documents. Tokens are counted with a byte-level BPE of
a public vocabulary, whole texts.

Odd input: documents of a source without a target, or without a source, are left out; an empty or null text has no
tokens and is left out; a source without documents reaches a share of 0 and its share goes to its siblings.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granaria.session import Workspace

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the public byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Domains of the known sources; others form a domain of their own.
DOMAINS = {
    "capture": ("capture_notes", "web_captions", "field_radio_log", "sensor_digests"),
    "evidence": ("review_evidence", "label_evidence", "audit_reports", "licence_notices"),
    "guidance": ("storage_guides", "training_handouts", "model_cards", "defence_qa", "grower_letters"),
}
BUCKETS = 4096
PIECE = 200_000


def source_key(c: Column) -> Column:
    """Sources however spelled: case, outer blanks, and ``-`` or a blank for ``_`` make no difference."""
    v = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    return F.when(v != "", v)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces of at most ``size`` characters, cut before blanks, where the tokenizer starts anew anyway.

    Only a run of ``size`` characters without a blank, or of nothing but blanks, is cut inside.
    """
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        while cut > at + 1 and text[cut - 1].isspace():
            cut -= 1
        if cut <= at + 1:
            cut = at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(documents: DataFrame, path: str = TOKENIZERS, *keep: Column) -> DataFrame:
    """(doc_id, tokens, *keep); tokens of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(f"{path}/{VOCABULARY}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for x in batches:
            x["tokens"] = [sum(len(encoder.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in x["text"]]
            yield x.drop(columns="text")

    chosen = documents.select("doc_id", "text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return chosen.mapInPandas(run, f"{schema}, tokens long")


def fill(budget: float, weights: dict, caps: dict) -> dict:
    """Divides ``budget`` by weight under caps; what a full child leaves goes to the others by weight."""
    out = dict.fromkeys(weights, 0.0)
    active = {k for k, w in weights.items() if w > 0 and caps[k] > 0}
    left = budget
    while active and left > 1e-9:
        whole = sum(weights[k] for k in active)
        full = {k for k in active if out[k] + left * weights[k] / whole >= caps[k]}
        if not full:
            for k in active:
                out[k] += left * weights[k] / whole
            return out
        for k in full:
            left -= caps[k] - out[k]
            out[k] = caps[k]
        active -= full
    return out


def budgets(leaves: dict[tuple[str, str, str], tuple[float, float]], total: float) -> dict[tuple[str, str, str], float]:
    """Token budget for each leaf (domain, language, source); leaves hold (weight, cap)."""

    def down(prefix: tuple, amount: float, depth: int) -> dict:
        groups: dict = defaultdict(list)
        for leaf in leaves:
            if leaf[:depth] == prefix:
                groups[leaf[: depth + 1]].append(leaf)
        given = fill(amount, {g: sum(leaves[x][0] for x in xs) for g, xs in groups.items()}, {g: sum(leaves[x][1] for x in xs) for g, xs in groups.items()})
        if depth == 2:
            return given
        out: dict = {}
        for g, a in given.items():
            out |= down(g, a, depth + 1)
        return out

    return down((), total, 0)


def largest_total(leaves: dict[tuple[str, str, str], tuple[float, float]]) -> float:
    """The largest budget under which no leaf that has documents and a weight is full."""
    low, high = 0.0, sum(cap for _, cap in leaves.values())
    for _ in range(60):
        mid = (low + high) / 2
        given = budgets(leaves, mid)
        if any(w > 0 and 0 < cap <= given[leaf] * (1 + 1e-12) for leaf, (w, cap) in leaves.items()):
            high = mid
        else:
            low = mid
    return low


def _unit(epoch: Column, seed: int) -> Column:
    return F.xxhash64("doc_id", epoch, F.lit(seed))


def mix_sources(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 42, path: str = TOKENIZERS, domains: dict[str, tuple[str, ...]] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): mix is (doc_id, source, lang, tokens, uses) of the chosen documents; shares has a row per target source."""
    spark = documents.sparkSession
    ws = Workspace(spark, "mixing")
    home = {s: d for d, sources in domains.items() for s in sources}
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").collect()  # a row per source
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted}

    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("und"))
    sized = count_tokens(documents, path, source_key(F.col("source")).alias("source"), lang.alias("lang")).where("tokens > 0")
    sized = ws.save(sized.join(F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string")), "source"), "sized")
    stats = {(home.get(r["source"], r["source"]), r["lang"], r["source"]): r["tokens"] for r in sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()}
    have: dict[str, float] = defaultdict(float)
    for (_, _, source), tokens in stats.items():
        have[source] += tokens
    leaves = {leaf: (goal[leaf[2]][0] * tokens / have[leaf[2]], float(tokens * goal[leaf[2]][1])) for leaf, tokens in stats.items()}
    # a source without documents keeps its weight in its domain, so that its share goes to its siblings first
    for source, (share, _) in goal.items():
        if source not in have:
            langs = {leaf[1]: sum(v for k, v in stats.items() if k[:2] == leaf[:2]) for leaf in stats if leaf[0] == home.get(source, source)}
            for name, tokens in langs.items():
                leaves[(home.get(source, source), name, source)] = (share * tokens / sum(langs.values()), 0.0)
    total = largest_total(leaves) if budget is None else budget
    given = budgets(leaves, total) if leaves else {}

    plan = [(leaf[2], leaf[1], min(int(given[leaf] // stats[leaf]), goal[leaf[2]][1]), float(given[leaf] - stats[leaf] * (given[leaf] // stats[leaf]))) for leaf in stats]
    plan_df = spark.createDataFrame(plan, "source string, lang string, epochs int, rest double")  # a row per leaf
    keyed = sized.join(F.broadcast(plan_df), ["source", "lang"]).withColumn("u", _unit(F.col("epochs"), seed)).withColumn("bucket", F.shiftrightunsigned("u", 64 - BUCKETS.bit_length() + 1).cast("int"))
    keyed = ws.save(keyed, "keyed")
    w = Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "lang", "bucket").agg(F.sum("tokens").alias("inside")).withColumn("before", F.coalesce(F.sum("inside").over(w), F.lit(0)))
    sums = ws.save(sums, "sums")
    placed = keyed.join(sums, ["source", "lang", "bucket"])
    # whole buckets before the boundary; inside the boundary bucket the running sum decides
    clear = placed.where("before + inside <= rest or before > rest").select("doc_id", "source", "lang", "tokens", "epochs", (F.col("before") + F.col("inside") <= F.col("rest")).alias("more"))
    w = Window.partitionBy("source", "lang", "bucket").orderBy(F.shiftleft("u", 13), "u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("before + inside > rest and before <= rest").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    edge = edge.select("doc_id", "source", "lang", "tokens", "epochs", (F.col("start") + F.col("tokens") / 2 <= F.col("rest")).alias("more"))
    caps = spark.createDataFrame([(s, r) for s, (_, r) in goal.items()], "source string, max_repeats int")
    used = clear.unionByName(edge).join(F.broadcast(caps), "source").withColumn("uses", F.least(F.col("epochs") + F.col("more").cast("int"), "max_repeats"))
    mix = ws.save(used.where("uses > 0").select("doc_id", "source", "lang", "tokens", "uses"), "mix")

    reached = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    reached = ws.save(reached, "reached")
    whole = reached.agg(F.sum("tokens_used").alias("whole"))
    goals = spark.createDataFrame([(s, t, r, int(have.get(s, 0))) for s, (t, r) in goal.items()], "source string, target_share double, max_repeats int, tokens_available long")
    shares = goals.join(reached, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "tokens_available",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens_used", "most_uses")],
        F.coalesce(F.try_divide("tokens_used", "whole"), F.lit(0.0)).alias("share"),
    )
    return mix, shares
