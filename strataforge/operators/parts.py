"""Searches of graphs within tasks: no edge leaves a part, so a part's edges go to a task as numbers, and nothing that a search meets is shuffled or held.

Rows of a part (edges, targets, things that its nodes hold) are gathered once and numbered in order of their ids. Each block of targets then gets the
numbered part and is searched by itself, so a large part doesn't wait for one task. What a search returns leaves the task in bounded batches.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataforge.runtime import cores, cut

#: Rows of one part that a task takes; graphs with a larger part are searched by levels, across the cluster.
TASK_ROWS = 1_000_000
#: Least targets of a block, most blocks of a part (each holds the part once more), and rows out of which one Arrow batch is made.
BLOCK, BLOCKS, OUT_ROWS = 1024, 16, 100_000
#: Kinds of rows below those of things, which are their places in ``KINDS``.
EDGE, START = -2, -1

ROWS = "part, kind, a, b, value"
PACKED = "names array<string>, first array<int>, next array<int>, targets array<int>, kinds array<int>, ids array<string>, held_first array<int>, held array<int>, value array<double>"


def gather(adjacent: DataFrame, starts: DataFrame, things: Iterable[DataFrame] = (), part: Callable[[Column], Column] | None = None) -> DataFrame | None:
    """One row for each block of targets of each part, or None where a part is too large for a task.

    ``adjacent`` (at, next; a row may repeat, so that no edges are shuffled only to be told apart), ``starts`` (target), ``things`` (kind: its number, member, id, value). ``part`` names the part of an id; without it
    all is one part.
    """
    of = part or (lambda c: F.lit(""))
    row = lambda df, kind, a, b, value: df.select(of(F.col(a)).alias("part"), kind.cast("int").alias("kind"), F.col(a).alias("a"), b.cast("string").alias("b"), value.cast("double").alias("value"))
    none = F.lit(None)
    rows = row(adjacent, F.lit(EDGE), "at", F.col("next"), none).unionByName(row(starts.filter("target IS NOT NULL").select("target").distinct(), F.lit(START), "target", none, none))
    for t in things:
        rows = rows.unionByName(row(t.filter("member IS NOT NULL"), F.col("kind"), "member", F.col("id"), F.col("value")))
    rows = cut(rows)
    size = F.count(F.lit(1))
    each = rows.groupBy("part").agg(size.alias("n"), F.least(F.ceil(F.count_if(F.col("kind") == START) / BLOCK), F.lit(BLOCKS)).alias("blocks"))
    most = each.agg(F.max("n").alias("n"), F.sum("blocks").alias("blocks")).first()
    if (most.n or 0) > TASK_ROWS:
        return None
    tasks = max(4 * cores(rows.sparkSession), min(most.blocks or 0, 10_000))
    block = BLOCK
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _pack(batches, block), PACKED).repartition(tasks)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each part, out of batches ordered by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0)
        ends = (np.flatnonzero(pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist() if len(part) > 1 else []
        for i, (begin, end) in enumerate(zip([0, *ends], [*ends, len(part)], strict=True)):
            if held and (i or (len(part) and held[-1].column(0)[-1] != part[0])):
                yield pa.Table.from_batches(held)
                held = []
            if end > begin:
                held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _numbers(values: pa.ChunkedArray, names: pa.Array) -> np.ndarray:
    """Places of ``values`` in ``names``, -1 where they aren't among them."""
    return pc.fill_null(pc.index_in(values, value_set=names), -1).to_numpy().astype(np.int32)


def _rows_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of ``n`` keys begin, in rows ordered by them."""
    return np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n)))).astype(np.int32)


def _pack(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        kind = rows["kind"].to_numpy()
        edges, starts, things = (rows.filter(pa.array(x)) for x in (kind == EDGE, kind == START, kind >= 0))
        if not len(starts):
            continue
        names = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks, *starts["a"].chunks], type=pa.string()))
        names = names.take(pc.array_sort_indices(names))
        at, nxt = _numbers(edges["a"], names), _numbers(edges["b"], names)
        order = np.lexsort((nxt, at))
        at, nxt = at[order], nxt[order]
        once = np.concatenate(([True], (at[1:] != at[:-1]) | (nxt[1:] != nxt[:-1])))[: len(at)]
        at, nxt = at[once], nxt[once]
        targets = np.unique(_numbers(starts["a"], names))
        # things in order of kind and id, the same kind and id being one
        things = things.append_column("member", pa.array(_numbers(things["a"], names)))
        things = things.filter(pc.greater_equal(things["member"], 0))
        things = things.take(pc.sort_indices(things, sort_keys=[("kind", "ascending"), ("b", "ascending")], null_placement="at_start")).combine_chunks()
        one, member = things["b"].combine_chunks(), things["member"].to_numpy()
        value = pc.fill_null(things["value"], -np.inf).to_numpy()
        kinds = things["kind"].to_numpy()
        if len(kinds):
            other = pc.and_(pc.fill_null(pc.not_equal(one[1:], one[:-1]), True), pc.invert(pc.and_(pc.is_null(one[1:]), pc.is_null(one[:-1])))).to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], other | (kinds[1:] != kinds[:-1])))
        else:
            new = np.zeros(0, dtype=bool)
        thing = np.cumsum(new) - 1
        by_member = np.lexsort((thing, member))
        columns = [
            names, _rows_of(at, len(names)), nxt, None, kinds[new], one.filter(pa.array(new)),
            _rows_of(member, len(names)), thing[by_member].astype(np.int32), value[by_member],
        ]
        step = max(block, math.ceil(len(targets) / BLOCKS))
        for i in range(0, len(targets), step):
            columns[3] = targets[i : i + step]
            held = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], type=pa.int32()), c) for c in held], [x.split()[0] for x in PACKED.split(", ")])


class Part:
    """A numbered part in a task, with the last target's search: ``found`` in queue order, how many at each depth, the predecessors of
    what was found by its number, and ``stop``, the truncation's kind and place or None."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(name)[row].values
        first, nxt = get("first").to_pylist(), get("next").to_pylist()
        self.names, self.targets, self.ids = get("names"), get("targets").to_pylist(), get("ids")
        self.kinds, self.held_first, self.held, self.value = (get(c).to_numpy() for c in ("kinds", "held_first", "held", "value"))
        self.adjacent = [nxt[a:b] for a, b in zip(first, first[1:], strict=False)]
        self.via, self._seen = [0] * len(self.adjacent), [-1] * len(self.adjacent)

    def search(self, target: int, max_depth: int, max_entities: int | None) -> None:
        adjacent, seen, via = self.adjacent, self._seen, self.via
        seen[target], frontier, found = target, [target], []
        self.found, self.counts, self.stop = found, [], None
        for _ in range(max_depth):
            begin = len(found)
            for at in frontier:
                for x in adjacent[at]:
                    if seen[x] != target:
                        seen[x], via[x] = target, at
                        found.append(x)
            if max_entities is not None and len(found) > max_entities:
                self.stop = "max-entities", found[max_entities]
                del found[max_entities:]
            frontier = found[begin:]
            if frontier:
                self.counts.append(len(frontier))
            if self.stop or not frontier:
                return
        beyond = next((x for at in frontier for x in adjacent[at] if seen[x] != target), None)
        if beyond is not None:
            self.stop = "max-depth", beyond

    def path(self, target: int, x: int) -> list[int]:
        """From the target to ``x``."""
        out = [x]
        while out[-1] != target:
            out.append(self.via[out[-1]])
        return out[::-1]


def each_target(packed: DataFrame, schema: str, out: Callable[[Part, int], tuple[int, Sequence]], max_depth: int, max_entities: int | None) -> DataFrame:
    """Rows of ``schema`` of all targets. ``out`` gets a part after the search of a target and says how many rows and their columns: Arrow arrays,
    lists or numbers; a column that is an array of numbers stands for ids of nodes where its type is string."""
    fields = T.StructType.fromDDL(schema)
    texts = [f.dataType == T.StringType() for f in fields]

    def pack(part: Part, held: list[Sequence]) -> pa.RecordBatch:
        columns, arrow = [], to_arrow_schema(fields)
        for text, field, pieces in zip(texts, arrow, zip(*held, strict=True), strict=True):
            if isinstance(pieces[0], pa.Array):
                columns.append(pa.concat_arrays(pieces))
            elif isinstance(pieces[0], np.ndarray):
                numbers = pa.array(np.concatenate(pieces))
                columns.append(part.names.take(numbers) if text else numbers)
            else:
                columns.append(pa.array([x for p in pieces for x in p], type=field.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, held, size = Part(batch, row), [], 0
                for target in part.targets:
                    part.search(target, max_depth, max_entities)
                    n, columns = out(part, target)
                    if n:
                        held.append(columns)
                        size += n
                    if size >= OUT_ROWS:
                        yield pack(part, held)
                        held, size = [], 0
                if held:
                    yield pack(part, held)

    return packed.mapInArrow(run, fields)


def nodes(packed: DataFrame, columns: Sequence[str], max_depth: int, max_entities: int | None) -> DataFrame:
    """What each target reaches, of (target, id, depth, predecessor, rank) the ``columns``."""
    types = {"target": "string", "id": "string", "depth": "int", "predecessor": "string", "rank": "bigint"}
    make = {
        "target": lambda p, t: np.full(len(p.found), t, dtype=np.int32), "id": lambda p, t: np.array(p.found, dtype=np.int32),
        "depth": lambda p, t: np.repeat(np.arange(1, len(p.counts) + 1, dtype=np.int32), p.counts),
        "predecessor": lambda p, t: np.array([p.via[x] for x in p.found], dtype=np.int32), "rank": lambda p, t: np.arange(1, len(p.found) + 1, dtype=np.int64),
    }
    makers = [make[c] for c in columns]
    return each_target(packed, ", ".join(f"{c} {types[c]}" for c in columns), lambda p, t: (len(p.found), [m(p, t) for m in makers] if p.found else ()), max_depth, max_entities)


TRUNCATIONS = "target string, kind string, limit int, at string"


def _node(*numbers: int) -> np.ndarray:
    return np.array(numbers, dtype=np.int32)


def truncations(packed: DataFrame, max_depth: int, max_entities: int | None, max_paths: int | None = None) -> DataFrame:
    """(target, kind, limit, at), with those of evidence paths where ``max_paths`` is given."""
    limits = {"max-depth": max_depth, "max-entities": max_entities, "max-evidence-paths": max_paths}

    def out(p: Part, t: int) -> tuple[int, Sequence]:
        stops = [p.stop] if p.stop else []
        if max_paths is not None and len(p.found) > max_paths:
            stops.append(("max-evidence-paths", sorted(p.found)[max_paths]))
        if not stops:
            return 0, ()
        kinds, at = zip(*stops, strict=True)
        return len(stops), (_node(*[t] * len(stops)), kinds, [limits[k] for k in kinds], _node(*at))

    return each_target(packed, TRUNCATIONS, out, max_depth, max_entities)


def paths(packed: DataFrame, k: int, max_depth: int, max_entities: int | None) -> DataFrame:
    """(target, id, depth, path) of the first ``k`` ids of each target."""

    def out(p: Part, t: int) -> tuple[int, Sequence]:
        ways = [p.path(t, x) for x in sorted(p.found)[:k]]
        if not ways:
            return 0, ()
        ends = np.cumsum([0, *map(len, ways)], dtype=np.int32)
        path = pa.ListArray.from_arrays(pa.array(ends), p.names.take(pa.array(np.concatenate(ways).astype(np.int32))))
        return len(ways), (_node(*[t] * len(ways)), _node(*[w[-1] for w in ways]), [len(w) - 1 for w in ways], path)

    return each_target(packed, "target string, id string, depth int, path array<string>", out, max_depth, max_entities)


class Impacts:
    """What the last search of a part comes to: the effects of its scope by kind, and the crossings of its first paths. Kinds are places in ``kinds``."""

    def __init__(self, kinds: Sequence[str], max_entities: int, max_paths: int):
        self.kinds, self.max_entities, self.max_paths = kinds, max_entities, max_paths
        self.layer = kinds.index("layer") if "layer" in kinds else None

    def effects(self, p: Part, target: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """By kind the first things in scope in order of their ids, the first node that holds each, their greatest values, and whether more are in scope."""
        scope = np.array([*p.found, target], dtype=np.int64)
        scope.sort()
        first, n = p.held_first[scope], p.held_first[scope + 1] - p.held_first[scope]
        total = int(n.sum())
        if not total:
            return {}
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(total)
        thing = p.held[at]
        order = np.argsort(thing, kind="stable")
        thing, node, value = thing[order], np.repeat(scope, n)[order], p.value[at][order]
        begin = np.flatnonzero(np.concatenate(([True], thing[1:] != thing[:-1])))
        thing, node, value = thing[begin], node[begin], np.maximum.reduceat(value, begin)
        ends = np.searchsorted(p.kinds[thing], np.arange(len(self.kinds) + 1))
        limit = self.max_entities
        return {k: (thing[a:b][:limit], node[a:b][:limit], value[a:b][:limit], b - a > limit) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a}

    def crossings(self, p: Part, target: int) -> list[tuple[str, str, int, int]]:
        """(from layer, to layer, dependent, dependency) of the steps of the first paths between layers."""
        if self.layer is None:
            return []
        layers = lambda x: [p.ids[i].as_py() for i in p.held[p.held_first[x] : p.held_first[x + 1]].tolist() if p.kinds[i] == self.layer]
        steps = {s for x in sorted(p.found)[: self.max_paths] for s in itertools.pairwise(p.path(target, x))}
        return sorted({(a, b, y, x) for x, y in steps for a in layers(x) for b in layers(y) if a is not None and b is not None and a != b})

    def effect_rows(self, p: Part, t: int) -> tuple[int, Sequence]:
        held = self.effects(p, t)
        if not held:
            return 0, ()
        thing, node = (np.concatenate([h[i] for h in held.values()]) for i in (0, 1))
        kind = pa.array(self.kinds).take(pa.array(p.kinds[thing]))
        return len(thing), (np.full(len(thing), t, dtype=np.int32), kind, p.ids.take(pa.array(thing)), node.astype(np.int32))

    def crossing_rows(self, p: Part, t: int) -> tuple[int, Sequence]:
        held = self.crossings(p, t)
        if not held:
            return 0, ()
        a, b, dependent, dependency = zip(*held, strict=True)
        return len(held), (_node(*[t] * len(held)), a, b, _node(*dependent), _node(*dependency))

    def measure_rows(self, p: Part, t: int) -> tuple[int, Sequence]:
        """One row: counts, sums of values, what independent exposures come to, and what was cut off."""
        held = {self.kinds[k]: v for k, v in self.effects(p, t).items()}
        n = len(p.found)
        values = lambda kind: held[kind][2].tolist() if kind in held else []
        total = lambda kind: math.fsum(v for v in values(kind) if v != -math.inf)  # noqa: E731  (-inf: no value)
        exposure = lambda v: max(0.0, v) if v <= 1 and v != -math.inf else 1.0  # noqa: E731  (of none and NaN the 1 is the least)
        some = lambda kind, scale: 1 - math.prod(1 - exposure(v / scale) for v in values(kind))
        row = [n, 1 if n else None, p.counts[0] if n else 0, float(len(values("domain"))), total("critical"), total("risk"), some("critical", 1), some("risk", 10), float(len(self.crossings(p, t)))]
        flags = [p.stop is not None, n > self.max_paths, *(kind in held and bool(held[kind][3]) for kind in self.kinds)]
        return 1, (_node(t), *([x] for x in row + flags))

    def measures(self) -> str:
        counts = "target string, n_impacted bigint, minimum_depth int, n_direct bigint, _domain double, _critical double, _risk double, _pc double, _pr double, _boundary double, _structural boolean, _path boolean"
        return ", ".join([counts, *(f"_more_{k} boolean" for k in self.kinds)])
