"""Paths, resolution, merge, cycles and traversal: golden values and seeded random graphs against independent oracles."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.operators import cycles as C
from strataforge.operators import graph as G
from strataforge.operators import traverse as T
from tests.conftest import rows

IMP = "array<struct<source:string,specifiers:array<struct<name:string,alias:string,isDefault:boolean,isNamespace:boolean>>,isTypeOnly:boolean,isDynamic:boolean>>"
EXP = "array<struct<name:string,type:string,isTypeOnly:boolean,source:string>>"


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("v")).first().v


def test_path_algebra(spark):
    assert value(spark, P.collapse("p"), p="src/a/../b/./c") == "src/b/c"
    assert value(spark, P.normalise("p"), p=".\\a//b\\c.ts") == "a/b/c.ts"
    assert value(spark, P.normalise("p", "/Root/x"), p="/root/X/a.ts") == "a.ts"
    assert value(spark, P.language("p"), p="a/b.HPP") == "cpp" and value(spark, P.language("p"), p="a/Makefile") is None
    assert [value(spark, P.package_root("p"), p=x) for x in ("node:fs", "@s/p/deep", "lodash/fp", "react")] == ["node:fs", "@s/p", "lodash", "react"]
    assert [value(spark, P.module_of("p"), p=x) for x in ("packages/a/src/x.ts", "lib/x.ts", "index.ts")] == ["packages/a", "lib", "root"]
    assert value(spark, P.candidates("p"), p="a/b")[:3] == ["a/b", "a/b.ts", "a/b/index.ts"]
    assert value(spark, P.candidates("p"), p="a/b.js")[:3] == ["a/b.js", "a/b.ts", "a/b.tsx"]
    assert value(spark, P.humanise("p"), p="order-linesOf_x") == "Order Lines Of X"


@pytest.mark.parametrize(("path", "patterns", "want"), [("a/node_modules/x.js", ["node_modules"], True), ("a/x.min.js", ["*.min.js"], True), ("src/gen/a.ts", ["src/*"], True), ("lib/src/a.ts", ["src/*"], False), ("a/b.ts", ["!b.ts"], False), ("A/Dist/b", ["dist"], True), ("a/b/c/d.py", ["a/**/d.py"], True)])
def test_ignore(spark, path, patterns, want):
    assert value(spark, P.ignored("p", patterns), p=path) is want


def graph_files(spark):
    one = lambda n: [{"name": f"s{i}", "alias": None, "isDefault": False, "isNamespace": False} for i in range(n)]
    imp = lambda s, n=1, t=False, d=False: {"source": s, "specifiers": one(n), "isTypeOnly": t, "isDynamic": d}
    index = [imp("./service"), imp("@/shared"), imp("@project/shared"), imp("react"), imp("./lazy", 0, False, True), imp("./nowhere")]
    data = [
        ("src/index.ts", index, [{"name": "*", "type": "barrel", "isTypeOnly": False, "source": "./types"}]), ("src/service.ts", [imp("./shared", 2), imp("./shared", 1, True)], []),
        ("src/shared.ts", [], []), ("src/lazy.ts", [], []), ("src/types/index.ts", [], []), ("packages/shared/src/index.ts", [], []),
    ]
    return spark.createDataFrame([(1, *d) for d in data], f"repo_id int, path string, imports {IMP}, exports {EXP}")


def test_build_graph(spark):
    nodes, edges = G.build_graph(graph_files(spark), ["repo_id"])
    assert nodes.filter("kind = 'file'").count() == 6
    got = {(r.src, r.dst): (r.type, r.is_type_only, r.specifier_count, r.is_external) for r in edges.collect()}
    assert got[("src/service.ts", "src/shared.ts")] == ("import", False, 3, False)
    assert got[("src/index.ts", "external:react")][3] and got[("src/index.ts", "src/lazy.ts")][0] == "dynamic-import"
    assert got[("src/index.ts", "src/types/index.ts")][0] == "re-export" and ("src/index.ts", "packages/shared/src/index.ts") in got
    assert ("src/index.ts", "src/shared.ts") in got and not any("nowhere" in d for _, d in got)


def test_boundaries_and_repair(spark):
    files = spark.createDataFrame([(1, "packages/a/src/index.ts"), (1, "packages/a/src/local.ts"), (1, "packages/b/src/index.ts")], "repo_id int, path string")
    edges = spark.createDataFrame([(1, "packages/a/src/index.ts", d) for d in ("packages/a/src/local.ts", "packages/b/src/index.ts", "external:react")], "repo_id int, src string, dst string")
    a = G.module_boundaries(files, edges, ["repo_id"]).filter("module = 'packages/a'").first()
    assert (a.internal, a.cross, a.external) == (["packages/a/src/local.ts"], ["packages/b:packages/b/src/index.ts"], ["react"])
    old, new = spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("a", "c")], "src string, dst string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    fixed = G.repair(old, new, spark.createDataFrame([("a",)], "id string"), ids)
    assert rows(fixed, "src", "dst") == [("a", "c")] and G.neighbours(fixed, "b", "dependents").count() == 0


def random_edges(rng, n, extra):
    e = {(f"n{i:03d}", f"n{(i + 1) % n:03d}") for i in range(n)} | {(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}") for _ in range(extra)}
    return sorted(e)


def bfs(edges, target, depth, limit):
    """Queue simulation: nodes with (depth, predecessor), and the truncation."""
    back = {}
    for s, d in edges:
        if s != d:
            back.setdefault(d, set()).add(s)
    seen, queue, out = {target}, deque([(target, 0)]), {}
    while queue:
        at, k = queue.popleft()
        fresh = [x for x in sorted(back.get(at, ())) if x not in seen]
        if k == depth:
            if fresh:
                return out, ("max-depth", fresh[0])
            continue
        for x in fresh:
            if limit is not None and len(out) == limit:
                return out, ("max-entities", x)
            seen.add(x)
            out[x] = (k + 1, at)
            queue.append((x, k + 1))
    return out, None


@pytest.mark.parametrize(("seed", "depth", "limit"), [(1, 8, 500), (2, 2, 500), (3, 4, 7), (4, 32, 31), (5, 0, 5)])
def test_traverse_random(spark, seed, depth, limit):
    rng = random.Random(seed)
    edges = random_edges(rng, 40, 60)
    df = spark.createDataFrame(edges, "src string, dst string")
    targets = ["n000", "n007", "n013"]
    t = T.traverse(df, spark.createDataFrame([(x,) for x in [*targets, targets[0]]], "target string"), "dependents", depth, limit)
    got = {(r.target, r.id): (r.depth, r.predecessor) for r in t.nodes.collect()}
    cuts = {r.target: (r.kind, r.at) for r in t.truncations.collect()}
    for x in targets:
        want, stop = bfs(edges, x, depth, limit)
        assert {k[1]: v for k, v in got.items() if k[0] == x} == want
        assert cuts.get(x) == stop


def test_traverse_edges(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert T.traverse(empty, spark.createDataFrame([("a",), (None,)], "target string")).nodes.count() == 0
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "C"), ("external:x", "C")], "src string, dst string")
    got = T.traverse(e, spark.createDataFrame([("C",)], "target string"))
    assert rows(got.nodes, "id", "depth") == [("A", 2), ("B", 1)]
    assert rows(T.canonical_paths(got, 1), "path") == [(["C", "B", "A"],)]
    assert rows(T.dirty_closure(e.limit(1), e, spark.createDataFrame([("A",)], "id string"))) == [("A",), ("B",), ("C",)]


def test_cycles_golden(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "external:x"), ("d", "d")], "src string, dst string")
    assert rows(C.cycles(e), "chain", "length") == [(["a", "b", "c", "a"], 3), (["d", "d"], 1)]


@pytest.mark.parametrize("seed", range(3))
def test_cycles_match_a_single_search(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(20)})
    adjacent = {}
    for s, d in edges:
        adjacent.setdefault(s, []).append(d)
    want = {tuple(c) for c in C.search(adjacent)}
    got = {tuple(r.chain[:-1]) for r in C.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_trimming_changes_no_cycle():
    """Any number of rounds of taking away nodes that lead nowhere leaves the cycles that a search of all edges meets."""
    for seed in range(300):
        rng = random.Random(seed)
        n = rng.randrange(3, 14)
        edges = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(rng.randrange(1, 25))})
        found = []
        for _ in range(4):
            adjacent = {}
            for s, d in edges:
                adjacent.setdefault(s, []).append(d)
            found.append(C.search(adjacent))
            edges = [(s, d) for s, d in edges if d in adjacent]
        assert found == [found[0]] * 4


def test_cycles_keyed_and_components(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", "b")], "repo_id int, src string, dst string")
    assert rows(C.cycles(e, ["repo_id"])) == [(1, ["a", "b", "a"], 2)]
    assert rows(C.components(spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "src string, dst string"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_merge_rules(spark):
    raw = spark.createDataFrame([("a", "b", "import", False, 1, False), ("a", "b", "type-import", True, 2, False), ("a", "a", "require", False, 1, False), ("a", "gone", "import", False, 1, False)], "src string, dst string, type string, is_type_only boolean, specifier_count int, is_external boolean")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(G.merge_edges(raw, nodes), "src", "dst", "type", "is_type_only", "specifier_count") == [("a", "a", "require", False, 1), ("a", "b", "import", False, 3)]
    assert rows(G.degrees(G.merge_edges(raw, nodes))) == [("a", 1, 2, 3), ("b", 1, 0, 1)]
    assert G.same_keys(nodes, nodes, ["id"]) and not G.same_keys(nodes, nodes.limit(1), ["id"])
