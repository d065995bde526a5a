"""Cycles among files, exactly as a depth-first search from ordinally sorted starts meets them.

The search within one weakly connected component doesn't depend on others. So components are labelled by distributed label propagation,
and each is searched in one task; a graph that a task takes as a whole is searched there, without labels. The search passes an edge once; what takes long is to
write its cycles out. So it returns its moves, cut into stretches, which are played again by many tasks. Where there are labels, nodes that lead nowhere are
trimmed before: they're on no cycle, and a search that visits them comes back as it went. Nodes that nothing leads to stay, since a search that starts there
decides where a cyclic part is entered, and so which cycles show.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators.parts import TASK_ROWS
from strataforge.runtime import cores, cut

#: Ids out of which one Arrow batch of chains is made, and ids of the chains of one stretch of a search.
OUT_IDS, STRETCH_IDS = 200_000, 5_000_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by least label, with pointer jumping (logarithmic in the diameter)."""
    pairs = edges.select("src", "dst").filter("src <> dst")
    both = cut(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        offered = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("offer"))
        moved = labels.join(offered, "id").select("id", F.least("component", "offer").alias("c"), F.col("component").alias("old"))
        jumped = cut(moved.join(labels.select(F.col("id").alias("c"), F.col("component").alias("further")), "c", "left").select("id", F.coalesce(F.least("further", "c"), "c").alias("component"), "old"))
        still = jumped.filter("component <> old").isEmpty()
        labels = jumped.select("id", "component")
        if still:
            return labels


#: Rounds of trimming; what is left after them is left to the search, which passes it in linear time.
TRIM_ROUNDS = 6


def trim(edges: DataFrame, rounds: int = TRIM_ROUNDS) -> DataFrame:
    """Of edges that are cut and come once, what is left after those to nodes without outgoing edges are taken away, again and again for some rounds (the
    result of a search is the same after any number of them) or until none is. Each round is cut, as it reads the one before twice. Self edges stay."""
    held = edges.select("src", "dst")
    for _ in range(rounds):
        before, held = held, cut(held.join(held.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if before.count() == held.count():
            break
    return held


def moves(adjacent: dict[int, list[int]], n: int) -> Iterator[tuple[int, int]]:
    """Moves of a search of ``n`` numbered nodes, each with the ids of the chain that it closes: the node that is entered, -1 for a step back, or
    -2 less the place on the stack that an edge leads back to.

    Each edge is met once and each chain has one back edge, so none comes twice.
    """
    state, place = bytearray(n), [0] * n
    for start in sorted(adjacent):
        if state[start]:
            continue
        place[start], state[start] = 0, 1
        stack, steps = [start], [iter(adjacent[start])]
        yield start, 0
        while steps:
            for nxt in steps[-1]:
                if state[nxt] == 1:
                    yield -2 - place[nxt], len(steps) - place[nxt] + 1
                elif not state[nxt]:
                    state[nxt], place[nxt] = 1, len(steps)
                    stack.append(nxt)
                    steps.append(iter(adjacent.get(nxt, ())))
                    yield nxt, 0
                    break
            else:
                steps.pop()
                state[stack.pop()] = 2
                yield -1, 0


def replay(stack: np.ndarray, depth: int, moved: Iterable[int]) -> Iterator[np.ndarray]:
    """The chains that moves close from a stack of ``depth`` nodes on (with room for the deepest): stack slices as their smallest rotations with the
    start repeated at the end. None is held."""
    for m in moved:
        if m >= 0:
            stack[depth] = m
            depth += 1
        elif m == -1:
            depth -= 1
        else:
            cycle = stack[-2 - m : depth]
            k = int(cycle.argmin())
            yield np.concatenate((cycle[k:], cycle[: k + 1]))


def walk(adjacent: dict[int, list[int]], n: int) -> Iterator[np.ndarray]:
    """All chains of ``n`` numbered nodes."""
    return replay(np.empty(n, dtype=np.int32), 0, (m for m, _ in moves(adjacent, n)))


def _numbered(edges: Iterable[tuple[str, str]]) -> tuple[list[str], dict[int, list[int]]]:
    """Names in order, and the ordered targets of each source by their numbers."""
    pairs = sorted(set(edges))
    names = sorted({x for p in pairs for x in p})
    number = {x: i for i, x in enumerate(names)}
    adjacent: dict[int, list[int]] = {}
    for s, d in pairs:
        adjacent.setdefault(number[s], []).append(number[d])
    return names, adjacent


def search(adjacent: dict[str, list[str]]) -> list[tuple[str, ...]]:
    """All cycles of one graph, shortest first."""
    names, numbers = _numbered((s, d) for s, ds in adjacent.items() for d in ds)
    return sorted((tuple(names[i] for i in c[:-1]) for c in walk(numbers, len(names))), key=lambda c: (len(c), c))


STRETCH = "names array<string>, stack array<int>, moves array<int>"


#: Rows of whole components that are searched as one graph at least, where there are as many.
GROUP_ROWS = 100_000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """(component, src, dst) rows ordered by component, in groups of whole components."""
    held, size, last = [], 0, None
    for batch in batches:
        c = batch.column(0)
        turns = (np.flatnonzero(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist() if batch.num_rows else []
        for i, j in pairwise([0, *turns, batch.num_rows]):
            if i == j:
                continue
            if size >= GROUP_ROWS and c[i] != last:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size, last = size + j - i, c[i]
    if held:
        yield pa.Table.from_batches(held)


def _coded(rows: pa.Table) -> tuple[pa.Array, dict[int, list[int]]]:
    """As ``_numbered``, without an object for each edge."""
    coded = pa.concat_arrays([x.cast(pa.string()) for c in ("src", "dst") for x in rows[c].chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)  # by bytes of UTF-8, as code points are ordered
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ids = rank[coded.indices.to_numpy()]
    src, dst = np.divmod(np.unique(ids[: rows.num_rows] * len(order) + ids[rows.num_rows :]), len(order))
    starts, first = np.unique(src, return_index=True)
    ends, to = [*first[1:].tolist(), len(dst)], dst.tolist()
    return coded.dictionary.take(order), {s: to[i:j] for s, i, j in zip(starts.tolist(), first.tolist(), ends, strict=True)}


def _stretches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Searches of (component, src, dst) rows ordered by component, in stretches that close chains of a bounded number of ids: the names that it meets,
    the stack at its begin, the moves. Ways that are gone and come back without a chain are left out."""
    for group in _groups(batches):
        table, adjacent = _coded(group)
        most = max(least, 4 * len(table))

        def pack(stack: list[int], held: list[int], table=table) -> pa.RecordBatch:
            begun, moved = np.array(stack, dtype=np.int32), np.array(held, dtype=np.int32)
            entered = moved >= 0
            met, ids = np.unique(np.concatenate((begun, moved[entered])), return_inverse=True)
            moved[entered] = ids[len(begun) :]
            columns = [table.take(pa.array(met)), pa.array(ids[: len(begun)].astype(np.int32)), pa.array(moved)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], type=pa.int32()), c) for c in columns], ["names", "stack", "moves"])

        stack, begun, held, size = [], [], [], 0
        for move, ids in moves(adjacent, len(table)):
            if move == -1 and held and held[-1] >= 0:
                held.pop()
            else:
                held.append(move)
            size += ids
            if move >= 0:
                stack.append(move)
            elif move == -1:
                stack.pop()
            if size >= most:
                yield pack(begun, held)
                begun, held, size = list(stack), [], 0
        if size:
            yield pack(begun, held)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed chains of stretches, in batches of bounded length."""
    for batch in batches:
        for row in range(batch.num_rows):
            table, begun, moved = (c[row].values for c in batch.columns)
            stack = np.empty(len(table), dtype=np.int32)
            stack[: len(begun)] = begun.to_numpy()

            def pack(held: list[np.ndarray], table=table) -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), table.take(pa.array(np.concatenate(held))))], ["chain"])

            held, size = [], 0
            for chain in replay(stack, len(begun), moved.to_pylist()):
                held.append(chain)
                size += len(chain)
                if size >= OUT_IDS:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)


def cycles(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., chain, length): file cycles; the chain ends where it began. External ends are ignored.

    A weakly connected component is searched in one task, since the order of visits decides which cycles show. One giant component is the
    stated limit: its edges, as numbers, have to fit into a task. Its chains are written by all tasks. Graphs of at most TASK_ROWS edges are
    searched in one task, as labels take many small jobs and save it nothing.
    """
    e = edges.filter(~F.col("src").startswith("external:") & ~F.col("dst").startswith("external:"))
    own = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys], F.lit(""))
    flat = e.select(F.concat(own, F.col("src")).alias("src"), F.concat(own, F.col("dst")).alias("dst")) if keys else e.select("src", "dst")
    held, least = cut(flat.distinct()), STRETCH_IDS
    if held.count() <= TASK_ROWS:
        ordered, alone = held.select(F.lit("").alias("component"), "src", "dst").coalesce(1), None
    else:
        left = trim(held)
        label = components(left).withColumnRenamed("id", "src")
        alone = left.filter("src = dst").join(label, "src", "left_anti").select(F.array("src", "dst").alias("chain"))
        ordered = left.join(label, "src").select("component", "src", "dst").repartition("component").sortWithinPartitions("component")
    stretches = ordered.mapInArrow(lambda batches: _stretches(batches, least), STRETCH).repartition(8 * cores(edges.sparkSession))
    found = stretches.mapInArrow(_chains, "chain array<string>")
    if alone is not None:
        found = found.unionByName(alone)
    length = (F.size("chain") - 1).alias("length")
    if not keys:
        return found.select("chain", length)
    bare = F.transform("chain", lambda c: F.element_at(F.split(c, "\x1f"), -1))
    types = dict(edges.dtypes)
    named = [F.split_part(F.element_at("chain", 1), F.lit("\x1f"), F.lit(i + 1)).cast(types[k]).alias(k) for i, k in enumerate(keys)]
    return found.select(*named, bare.alias("chain"), length)


def checks(found: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., cyclic, n_broken, n_repeated) of each group of ``edges``: whether cycles were found, steps of theirs that are no edges, and ids
    that a cycle meets twice."""
    steps = found.select(*keys, F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1), F.slice("chain", F.lit(2), F.size("chain") - 1))).alias("s"))
    steps = steps.select(*keys, F.col("s.0").alias("src"), F.col("s.1").alias("dst")).groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    broken = steps.join(edges.select(*keys, "src", "dst").distinct(), [*keys, "src", "dst"], "left_anti").groupBy(*keys).agg(F.sum("n").cast("int").alias("n_broken"))
    whole = found.groupBy(*keys).agg(F.lit(True).alias("cyclic"), F.count_if(F.size(F.array_distinct("chain")) != F.size("chain") - 1).cast("int").alias("n_repeated"))
    out = edges.select(*keys).distinct().join(whole, list(keys), "left").join(broken, list(keys), "left")
    return out.select(*keys, F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("n_broken", F.lit(0)).alias("n_broken"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))
