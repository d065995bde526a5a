"""Bounded reachability over dependency edges, for many start nodes at once.

Parts of a graph that no edge leaves are searched within tasks (``parts``), so that what is reached is only returned. Where a part is too large for a
task, the search is level-synchronous: each level joins the frontier of all targets with the edges, drops what was visited and keeps
the first predecessor in queue order. Levels are cut by reliable checkpoints, so plans stay flat and a lost executor
costs nothing but a level. Nodes carry their predecessor only; the few paths that are asked for are put together by walking it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators import parts
from strataforge.runtime import cut

DEFAULT_DEPTH, DEFAULT_ENTITIES, DEFAULT_PATHS = 8, 500, 1
HARD_DEPTH, HARD_ENTITIES, HARD_PATHS = 32, 5000, 3
NODE = ("target", "id", "depth", "predecessor", "rank")


@dataclass
class Traversal:
    """``nodes``: (target, id, depth, predecessor, rank); ``truncations``: (target, kind, limit, at); ``levels``: the nodes by depth, or ``paths``:
    the first paths of each target by their number, where the search ran within tasks."""

    nodes: DataFrame
    truncations: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    paths: Callable[[int], DataFrame] | None = None


def adjacency(edges: DataFrame, direction: str, once: bool = True) -> DataFrame:
    """(at, next) rows: ``dependents`` goes against edges, ``dependencies`` along them, ``connected`` both ways; each once if that is needed."""
    e = edges.filter(~F.col("src").startswith("external:") & ~F.col("dst").startswith("external:"))
    against, along = e.select(F.col("dst").alias("at"), F.col("src").alias("next")), e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    adj = {"dependents": against, "dependencies": along, "connected": against.unionByName(along)}[direction].filter("at <> next")
    return adj.distinct() if once else adj


RELATIONSHIP = ("dependent", "dependency", "type", "is_type_only", "specifier_count")


def relationships(graphs: Sequence[DataFrame], direction: str) -> DataFrame:
    """(at, next, dependent, dependency, type, is_type_only, specifier_count): of all edges of the ``graphs`` between two neighbours the
    first one, in order of these columns. External ends and self edges are left out."""
    parts = []
    for g in graphs:
        e = g.filter(~F.col("src").startswith("external:") & ~F.col("dst").startswith("external:") & (F.col("src") != F.col("dst")))
        edge = [F.col("src").alias("dependent"), F.col("dst").alias("dependency"), *RELATIONSHIP[2:]]
        if direction != "dependencies":
            parts.append(e.select(F.col("dst").alias("at"), F.col("src").alias("next"), F.struct(*edge).alias("r")))
        if direction != "dependents":
            parts.append(e.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.struct(*edge).alias("r")))
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    return held.groupBy("at", "next").agg(F.min("r").alias("r")).select("at", "next", "r.*")


def traverse(
    edges: DataFrame,
    starts: DataFrame,
    direction: str = "dependents",
    max_depth: int = DEFAULT_DEPTH,
    max_entities: int | None = DEFAULT_ENTITIES,
    part: Callable[[Column], Column] | None = None,
    columns: Sequence[str] = NODE,
) -> Traversal:
    """Breadth first from each row of ``starts`` (target: its id).

    A node's depth is the least number of edges, its predecessor the first in queue order (level order, then the
    predecessor's place, then the id). The first ``max_entities`` nodes in that order hold; what comes next is the
    truncation. Where depth ends first, the first unvisited neighbour is. Start nodes are never results. Null ids are ignored.
    ``part`` names the part of an id; no edge may lead from one part to another. Of the nodes the ``columns`` are made.
    """
    packed = parts.gather(adjacency(edges, direction, once=False), starts, part=part)
    if packed is None:
        return by_levels(adjacency(edges, direction), starts, max_depth, max_entities)
    bounds = max_depth, max_entities
    return Traversal(parts.nodes(packed, columns, *bounds), parts.truncations(packed, *bounds), paths=lambda k: parts.paths(packed, k, *bounds))


def by_levels(adj: DataFrame, starts: DataFrame, max_depth: int, max_entities: int | None) -> Traversal:
    """The search of ``traverse`` over (at, next) rows across the cluster, for parts of any size."""
    adj = cut(adj)
    frontier = starts.filter(F.col("target").isNotNull()).select("target", F.col("target").alias("id")).distinct()
    visited = frontier.select("target", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("predecessor"), F.lit(0).cast("bigint").alias("rank"))
    visited = cut(visited)
    frontier, done, truncations, levels = visited, visited.filter("false"), None, []
    for depth in range(1, max_depth + 2):
        ahead = frontier.alias("f").join(adj, F.col("f.id") == F.col("at")).select("target", F.col("next").alias("id"), F.struct("f.rank", "f.id").alias("via"))
        fresh = ahead.groupBy("target", "id").agg(F.min("via").alias("via")).join(visited.select("target", "id"), ["target", "id"], "left_anti")
        if depth > max_depth:
            beyond = fresh.groupBy("target").agg(F.min_by("id", F.struct("via.rank", "id")).alias("at"))
            cutoff = beyond.select("target", F.lit("max-depth").alias("kind"), F.lit(max_depth).alias("limit"), "at")
            truncations = cutoff if truncations is None else truncations.unionByName(cutoff)
            break
        order = Window.partitionBy("target").orderBy("via.rank", "id")
        placed = frontier.groupBy("target").agg(F.max("rank").alias("last"))
        fresh = fresh.join(placed, "target").select(
            "target", "id", F.lit(depth).alias("depth"), F.col("via.id").alias("predecessor"), (F.col("last") + F.row_number().over(order)).cast("bigint").alias("rank")
        )
        fresh = cut(fresh)
        if max_entities is not None:
            over = fresh.filter(F.col("rank") == max_entities + 1).select("target", F.lit("max-entities").alias("kind"), F.lit(max_entities).alias("limit"), F.col("id").alias("at"))
            truncations = over if truncations is None else truncations.unionByName(over)
            stopped = over.select("target")
            fresh = fresh.filter(F.col("rank") <= max_entities)
            frontier = fresh.join(stopped, "target", "left_anti")
        else:
            frontier = fresh
        levels.append(fresh)
        done = done.unionByName(fresh)
        visited = visited.unionByName(fresh)
        if frontier.isEmpty():
            break
    if truncations is None:
        truncations = visited.filter("false").select("target", F.lit("max-depth").alias("kind"), F.lit(max_depth).alias("limit"), F.col("id").alias("at"))
    return Traversal(done, truncations, levels)


def dirty_closure(previous: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids connected to a changed one in either generation of the graph, the changed ones included.

    Frontier expansion without a per-target key: each node is visited once however many changes reach it.
    """
    adj = cut(adjacency(previous.select("src", "dst").unionByName(now.select("src", "dst")), "connected"))
    seen = cut(changed.select("id").filter("id IS NOT NULL").distinct())
    frontier = seen
    while True:
        fresh = cut(frontier.join(adj, F.col("id") == F.col("at")).select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            return seen
        seen, frontier = cut(seen.unionByName(fresh)), fresh


def first_nodes(t: Traversal, k: int) -> DataFrame:
    """The first ``k`` ids of each target, in id order; the limit is pushed below the shuffle."""
    return t.nodes.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("id"))).filter(F.col("_n") <= k).drop("_n")


def canonical_paths(t: Traversal, k: int = DEFAULT_PATHS) -> DataFrame:
    """(target, id, depth, path) of the first ``k`` impacted ids of each target, in id order: the path from the target to the id.

    Predecessors are walked level by level, so each level of nodes is joined once with the few paths that pass it.
    """
    if t.paths:
        return t.paths(k)
    wanted = cut(first_nodes(t, k))
    paths = wanted.filter("false").select("target", "id", "depth", F.col("predecessor").alias("at"), F.array("id").alias("path"))
    for level in range(len(t.levels), 0, -1):
        begun = wanted.filter(F.col("depth") == level).select("target", "id", "depth", F.col("predecessor").alias("at"), F.array("id").alias("path"))
        paths = paths.unionByName(begun)
        if level > 1:
            before = t.levels[level - 2].select("target", F.col("id").alias("at"), F.col("predecessor").alias("_p"))
            paths = paths.join(before, ["target", "at"]).select("target", "id", "depth", F.col("_p").alias("at"), F.concat(F.array("at"), "path").alias("path"))
    return paths.select("target", "id", "depth", F.concat(F.array("target"), "path").alias("path"))
