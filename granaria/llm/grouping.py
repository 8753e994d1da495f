"""Consolidating pairwise matches into groups.

Method. The link graph is reduced round by round: maximal chains of degree-two vertices are ranked by pointer doubling
(list ranking from both ends) and replaced by one link between their ends, and degree-one vertices are stripped onto
their neighbour. What resists (the core) is solved by hooking and shortcutting. Removed vertices remember a vertex that
stayed longer; pointer jumping over that table restores all labels. Trees, brooms and long chains, the usual shape of
match results, vanish in a logarithmic number of rounds.

Odd input: links that name the same record twice, or a record that is unknown or missing, link nothing; repeated and
mirrored links count once; rings of degree-two vertices have no end and go to the core; no links give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granaria.functions.text import path_key
from granaria.operators.components import both_ways, canonical_edges, connected_components, find_hubs, join_hubs, save_counted, shortcut
from granaria.session import Workspace


def _compress(ws: Workspace, edges: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(edges without the ranked chains, (v, p) of the chain vertices with p an end of their chain)."""
    sym = both_ways(edges)
    around = sym.groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("n0"), F.max("w").alias("n1"))
    chain = ws.save(around.where("deg = 2").select("v", "n0", "n1"), f"chain_{step}")
    # a dart leaves chain vertex v on side s towards h; if h is in a chain too, it goes on from h on the other side
    darts = chain.select("v", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("n0").alias("h")), F.struct(F.lit(1).alias("s"), F.col("n1").alias("h")))).alias("d")).select("v", "d.s", "d.h")
    ahead = chain.select(F.col("v").alias("h"), F.col("n0").alias("h0"))
    state = darts.join(ahead, "h", "left").select("v", "s", "h", F.when(F.col("h0").isNotNull(), F.when(F.col("h0") == F.col("v"), 1).otherwise(0)).alias("t"))
    state, open_ = save_counted(ws, state, f"rank_{step}_0", F.col("t").isNotNull())
    jump = 0
    while open_:
        to = state.select(F.col("v").alias("h"), F.col("s").alias("t"), F.col("h").alias("h2"), F.col("t").alias("t2"))
        jumped = state.where("t is not null").join(to, ["h", "t"]).select("v", "s", F.col("h2").alias("h"), F.col("t2").alias("t"))
        before = open_
        state, open_ = save_counted(ws, state.where("t is null").unionByName(jumped), f"rank_{step}_{jump + 1}", F.col("t").isNotNull())
        ws.drop(f"rank_{step}_{jump}")
        jump += 1
        if open_ == before:  # only rings are left
            break
    ends = state.where("t is null").groupBy("v").agg(F.min("h").alias("p"), F.max("h").alias("q"), F.count(F.lit(1)).alias("n")).where("n = 2")
    ends = ws.save(ends.select("v", "p", "q"), f"ends_{step}")
    gone = ends.select("v")
    kept = edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
    bridges = ends.where("p != q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    out = ws.save(canonical_edges(kept.unionByName(bridges)), f"chained_{step}")
    ws.drop(f"rank_{step}_{jump}", f"chain_{step}")
    return out, ends.select("v", "p")


def _strip(ws: Workspace, edges: DataFrame, step: int) -> tuple[DataFrame, DataFrame, int]:
    """(edges without leaves, (v, p) of the leaves, edges left). Of a link between two leaves the smaller vertex stays."""
    leaves = both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("p")).where("deg = 1").select("v", "p")
    leaves = ws.save(leaves, f"leaves_{step}")
    twin = leaves.select(F.col("v").alias("p"), F.col("p").alias("v"))
    lone = leaves.join(twin, ["v", "p"], "left_semi").where("v < p")
    leaves = ws.save(leaves.join(lone, ["v", "p"], "left_anti"), f"stripped_{step}")
    gone = leaves.select("v")
    kept = edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
    out, n = save_counted(ws, kept, f"core_{step}")
    ws.drop(f"leaves_{step}")
    return out, leaves, n


def group_links(links: DataFrame, enough: float = 0.125) -> DataFrame:
    """(v, group) for each vertex of ``links`` (a, b); group is the smallest vertex linked directly or through others.

    Reduction goes on while a round removes at least the share ``enough`` of the links.
    """
    ws = Workspace(links.sparkSession, "group-links")
    edges, n = save_counted(ws, canonical_edges(links), "links")
    removed: list[DataFrame] = []
    step = 0
    while n:
        before = n
        edges, chained = _compress(ws, edges, step)
        edges, leaves, n = _strip(ws, edges, step)
        removed += [chained, leaves]
        step += 1
        if n > before * (1 - enough):
            break
    if not removed:
        return links.sparkSession.createDataFrame([], f"v {edges.schema['a'].dataType.simpleString()}, group {edges.schema['a'].dataType.simpleString()}")
    parents = removed[0]
    for more in removed[1:]:
        parents = parents.unionByName(more)
    if n:
        parents = parents.unionByName(connected_components(edges, Workspace(links.sparkSession, "core")).select("v", F.col("root").alias("p")))
    parents = ws.save(parents, "parents")
    # a vertex that others point to and that was never removed is its own root
    tops = parents.select(F.col("p").alias("v")).distinct().join(parents.select("v"), "v", "left_anti").select("v", F.col("v").alias("p"))
    forest, total = save_counted(ws, parents.unionByName(tops), "forest")
    rooted = shortcut(ws, forest, "restore", total)
    smallest = rooted.groupBy("p").agg(F.min("v").alias("group"))
    return join_hubs(rooted, smallest, "p", find_hubs(ws, rooted, "p", total, "hubs")).select("v", "group")


def review_links(review: DataFrame, manifest: DataFrame) -> DataFrame:
    """(a, b) row ids of every reviewed pair whose two paths name two different manifest records under path identity."""
    ids = manifest.select(path_key(F.col("path")).alias("k"), "row_id").where("k is not null").groupBy("k").agg(F.min("row_id").alias("row_id"))
    pairs = review.select(path_key(F.col("path_a")).alias("ka"), path_key(F.col("path_b")).alias("kb")).where("ka != kb").distinct()
    one = pairs.join(ids.select(F.col("k").alias("ka"), F.col("row_id").alias("a")), "ka")
    return one.join(ids.select(F.col("k").alias("kb"), F.col("row_id").alias("b")), "kb").select("a", "b")
