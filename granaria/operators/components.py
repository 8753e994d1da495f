"""Connected components by hooking and shortcutting over a parent table.

Each round hooks every vertex to its smallest neighbour (or itself), shortcuts the parent table by pointer jumping until
all trees are stars, and contracts the edges to the roots. A round leaves at most half of the vertices that still have
edges, so rounds grow with the logarithm of the graph; the smallest vertex of a component is its root. All state lives
in written tables. Aggregates on a hub combine on the map side. Joins that would meet a hub (a vertex that ``HUB`` rows or
more point to) are split: the hubs' rows of the smaller side, at most ``HUBS`` of them, are broadcast, and only the others
are shuffled, so a vertex that a third of all rows point to is no single task.

Odd input: null ends and self-links are ignored, repeated and mirrored edges count once, an empty edge table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from granaria.session import Workspace

#: Rows that make a key a hub, at least, and the most keys that can be hubs (the bound of what is broadcast).
HUB = 200_000
HUBS = 50_000


def find_hubs(ws: Workspace, rows: DataFrame, key: str, total: int, name: str) -> DataFrame | None:
    """(hub) the keys that many of ``total`` rows share, at most ``HUBS``; None where the rows are too few for one."""
    if total < HUB:
        return None
    least = max(HUB, total // HUBS + 1)
    return ws.save(rows.groupBy(F.col(key).alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("hub"), name)


def join_hubs(rows: DataFrame, table: DataFrame, key: str, hubs: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``table``, in which ``key`` is unique; rows of hubs meet a broadcast copy of theirs."""
    if hubs is None:
        return rows.join(table, key)
    few = F.broadcast(hubs.withColumnRenamed("hub", key))
    hot = rows.join(F.broadcast(table.join(few, key, "left_semi")), key)
    return hot.unionByName(rows.join(few, key, "left_anti").join(table, key))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once; self-links and null ends fall away."""
    return edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") != F.col("b")).alias("ok")).where("ok").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")


def save_counted(ws: Workspace, df: DataFrame, name: str, count=None) -> tuple[DataFrame, int]:
    """Writes ``df`` and returns it with its rows, or the rows that satisfy ``count``, counted on the way."""
    seen = Observation()
    amount = F.count(F.lit(1)) if count is None else F.count_if(count)
    out = ws.save(df.observe(seen, amount.alias("n")), name)
    return out, int(seen.get["n"])


def shortcut(ws: Workspace, parents: DataFrame, name: str, total: int = 0) -> DataFrame:
    """Pointer jumping: (v, p) with p a parent within the table becomes (v, root). ``total``: its rows, to look for hubs."""
    depth = 0
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
        hubs = find_hubs(ws, parents, "p", total, f"{name}_hubs_{depth}")
        jumped = join_hubs(parents, up, "p", hubs).select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
        out, moved = save_counted(ws, jumped, f"{name}_{depth}", F.col("moved"))
        if depth:
            ws.drop(f"{name}_{depth - 1}")
        parents = out.select("v", "p")
        if not moved:
            return parents
        depth += 1


def connected_components(edges: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a, b); root is the smallest vertex of its component."""
    ws = ws or Workspace(edges.sparkSession, "components")
    left, n = save_counted(ws, canonical_edges(edges), "edges_0")
    labels = None
    step = 0
    while n:
        hooked = both_ways(left).groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        hooked, vertices = save_counted(ws, hooked, f"hook_{step}")
        parents = shortcut(ws, hooked, f"star_{step}", vertices)
        moved = left
        for side in ("a", "b"):
            root = parents.select(F.col("v").alias(side), F.col("p").alias(f"r{side}"))
            moved = join_hubs(moved, root, side, find_hubs(ws, left, side, n, f"hubs_{side}_{step}"))
        moved = moved.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        left, n = save_counted(ws, canonical_edges(moved), f"edges_{step + 1}")
        if labels is None:
            labels = parents.select("v", F.col("p").alias("root"))
        else:
            new = parents.select(F.col("v").alias("root"), F.col("p").alias("top"))
            labels = ws.save(labels.join(new, "root", "left").select("v", F.coalesce("top", "root").alias("root")), f"labels_{step}")
        ws.drop(f"edges_{step}", f"hook_{step}")
        step += 1
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"v {kind}, root {kind}")
    return labels


def link_by_keys(rows: DataFrame, id_col: str, keys: list[str], ws: Workspace | None = None) -> DataFrame:
    """(id, component) for every row: rows that share a value of any key column, directly or through others, are one
    component, named by its smallest id.

    Each key value is a star around its smallest id; hooking and shortcutting over the stars gives the components. A null
    key value links nothing.
    """
    ws = ws or Workspace(rows.sparkSession, "link-keys")
    stars = None
    for i, key in enumerate(keys):
        filled = rows.where(F.col(key).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).alias("k"))
        filled, n = save_counted(ws, filled, f"keyed_{i}")
        centre = filled.groupBy("k").agg(F.min("id").alias("c"))
        one = join_hubs(filled, centre, "k", find_hubs(ws, filled, "k", n, f"hot_{i}")).select("id", "c")
        stars = one if stars is None else stars.unionByName(one)
    ids = rows.select(F.col(id_col).alias("id")).distinct()
    found = connected_components(stars.select(F.col("id").alias("a"), F.col("c").alias("b")), ws)
    return ids.join(found.withColumnRenamed("v", "id"), "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("component"))
