"""Graph queries over whole graphs, against brute force on fixtures."""

import datetime
import random
import re

import pyarrow as pa
import pytest

from strataforge.operators import cycles as C
from strataforge.operators import impact as IM
from strataforge.operators import parts
from strataforge.operators import traverse as T
from strataforge.plans import analysis, graphs
from strataforge.plans import inputs as I
from tests.conftest import rows


@pytest.mark.parametrize("length", [20, 40])
def test_reach_dependencies_goes_to_the_end(spark, monkeypatch, length):
    chain = spark.createDataFrame([(1, f"f{i:02d}", f"f{i + 1:02d}") for i in range(length)], "repo_id int, src string, dst string")
    monkeypatch.setattr(I, "repo_edges", lambda s, d: chain)
    got = rows(graphs.QUERIES["reach_dependencies_whole"](spark, ""))
    assert got == sorted(((f"1|f{i:02d}", f"1|f{j:02d}", j - i) for i in range(1, length) for j in range(i + 1, min(length, i + 32) + 1)), key=str)
    cuts = rows(graphs.QUERIES["reach_dependencies_truncations"](spark, ""))
    assert cuts == [(f"1|f{i:02d}", "max-depth", 32, f"1|f{i + 33:02d}") for i in range(1, length - 32)]


def _lines(spark, monkeypatch):
    """Four orders of three lines; the line of 2000 closes the cycle 1-2-3, the order of 1995 leads to part 9."""
    day = lambda y: datetime.datetime(y, 2, 1)
    parts = [(1, 1, 1996), (1, 2, 1996), (1, 3, 1996), (2, 3, 2000), (2, 1, 2000), (3, 2, 1995), (3, 8, 1997), (3, 9, 1999), (4, 20, 1996), (4, 21, 1996), (4, 21, 1996)]
    held = spark.createDataFrame([(o, n, p, 1, 1.0, day(y)) for n, (o, p, y) in enumerate(parts)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp_ntz")
    tables = {"lineitem": held, "supplier": spark.createDataFrame([(1,), (7,)], "s_suppkey long")}
    monkeypatch.setattr(graphs, "table", lambda s, d, name: tables[name])


def test_circular_dependencies_over_all_lines(spark, monkeypatch):
    _lines(spark, monkeypatch)
    assert rows(graphs.QUERIES["circular_dependencies"](spark, "")) == [(["part-1", "part-2", "part-3", "part-1"], 3), (["part-21", "part-21"], 1)]


def test_dirty_closure_over_both_generations(spark, monkeypatch):
    _lines(spark, monkeypatch)
    assert rows(graphs.QUERIES["dirty_closure_whole"](spark, "")) == [(f"part-{p}",) for p in (1, 2, 3, 8, 9)]


@pytest.mark.parametrize("seed", range(4))
def test_cycle_search_against_a_plain_recursion(seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(30)})
    stack, done, want = [], set(), set()

    def visit(x):
        stack.append(x)
        for y in (d for s, d in edges if s == x):
            if y in stack:
                c = stack[stack.index(y) :]
                k = c.index(min(c))
                want.add(tuple(c[k:] + c[:k]))
            elif y not in done:
                visit(y)
        done.add(stack.pop())

    for s in sorted({s for s, _ in edges}):
        if s not in done:
            visit(s)
    adjacent = {}
    for s, d in edges:
        adjacent.setdefault(s, []).append(d)
    assert C.search(adjacent) == sorted(want, key=lambda c: (len(c), c))


def _random(spark, seed):
    """Edges of two parts, ids by part, and targets with one that has no edge."""
    rng = random.Random(seed)
    e = sorted({(f"{p}|n{rng.randrange(30):02d}", f"{p}|n{rng.randrange(30):02d}") for p in "ab" for _ in range(70)})
    targets = sorted({d for _, d in e[::3]}) + ["c|alone"]
    return spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame([(t,) for t in targets], "target string")


@pytest.mark.parametrize(("seed", "direction", "depth", "limit"), [(1, "dependents", 8, None), (2, "dependencies", 2, None), (3, "connected", 32, 9), (4, "dependents", 3, 5)])
def test_searches_within_tasks_equal_those_by_levels(spark, monkeypatch, seed, direction, depth, limit):
    edges, targets = _random(spark, seed)
    every = lambda part: T.traverse(edges, targets, direction, depth, limit, part)
    monkeypatch.setattr(parts, "BLOCK", 7)
    one, split = every(None), every(graphs._repo)
    monkeypatch.setattr(parts, "TASK_ROWS", 0)
    levels = every(None)
    assert not levels.paths and one.paths and split.paths
    for t in (one, split):
        assert rows(t.nodes, *T.NODE) == rows(levels.nodes, *T.NODE) and rows(t.truncations) == rows(levels.truncations)
        assert rows(T.canonical_paths(t, 3)) == rows(T.canonical_paths(levels, 3))


def test_levels_within_tasks_write_no_checkpoints(spark, monkeypatch):
    """A search of 32 levels checkpoints its input only; each level once more was the time and the disk of whole runs."""
    made = []
    for m in (parts, T):
        monkeypatch.setattr(m, "cut", lambda df, own=m.cut: made.append(1) or own(df))
    chain = spark.createDataFrame([(1, f"f{i:02d}", f"f{i + 1:02d}") for i in range(34)], "repo_id int, src string, dst string")
    monkeypatch.setattr(I, "repo_edges", lambda s, d: chain)
    for name in ("reach_dependencies_whole", "reach_dependencies_truncations", "reach_depth_batch"):
        made.clear()
        assert graphs.QUERIES[name](spark, "").count() and len(made) == 1, name


def test_truncations_of_each_repository(spark, monkeypatch):
    """The same names in two repositories: what comes first after depth 32 is the smaller of two neighbours in one, and nothing in the other."""
    made = []
    monkeypatch.setattr(parts, "cut", lambda df, own=parts.cut: made.append(1) or own(df))
    chain = [(r, f"f{i:02d}", f"f{i + 1:02d}") for r in (1, 2) for i in range(33 + (r == 1))] + [(1, "f33", "a-first")]
    edges = spark.createDataFrame(chain, "repo_id int, src string, dst string")
    monkeypatch.setattr(I, "repo_edges", lambda s, d: edges)
    assert rows(graphs.QUERIES["reach_dependencies_truncations"](spark, "")) == [("1|f01", "max-depth", 32, "1|a-first")] and len(made) == 1


def _touched(spark):
    """What nodes of ``_random`` hold: ids of several nodes, values that differ by node or are missing, a node of two layers, one outside the graph."""
    node = lambda i: f"{'ab'[i % 2]}|n{i % 30:02d}"
    domains = spark.createDataFrame([(f"{node(i)[0]}|d{i % 5}", node(i)) for i in range(40)], "id string, member string")
    critical = spark.createDataFrame([(f"k{i % 9}{node(i)[0]}", node(i), None if i % 4 == 0 else i / 20) for i in range(25)] + [("k", "a|gone", 1.0)], "id string, member string, score double")
    risks = spark.createDataFrame([(f"{node(i)}#{i % 3}", node(i), ("low", "medium", "high", "critical", "odd")[i % 5]) for i in range(50)], "id string, member string, severity string")
    layers = spark.createDataFrame([(node(i), ("x", "y", None, "z")[i % 4]) for i in range(35)], "member string, layer string")
    return {"domains": domains, "critical": critical, "risks": risks, "layers": layers}


@pytest.mark.parametrize(("seed", "given", "bounds"), [(5, "domains critical risks layers", {"max_entities": 6, "max_paths": 3}), (6, "critical layers", {"max_depth": 3})])
def test_impact_within_tasks_equals_that_by_levels(spark, monkeypatch, seed, given, bounds):
    edges, targets = _random(spark, seed)
    held = _touched(spark)
    every = lambda part: IM.impact(edges, targets, **{k: held[k] for k in given.split()}, **bounds, part=part)
    monkeypatch.setattr(parts, "BLOCK", 7)
    own = every(graphs._repo)
    monkeypatch.setattr(parts, "TASK_ROWS", 0)
    levels = every(None)
    for name in ("impacted", "paths", "scores", "truncations", "effects", "crossings", "warnings"):
        a, b = getattr(own, name), getattr(levels, name)
        assert a.dtypes == b.dtypes and rows(a) == rows(b), name
    near = lambda i: [(r.target, r.kind, round(r.raw, 9), round(r.normalized, 9), r.weight, r.contribution, r.status) for r in i.components.orderBy("target", "kind").collect()]
    assert near(own) == near(levels)


def test_impact_holds_no_scopes(spark, monkeypatch):
    """Scores and components checkpoint their input only; scopes and levels written beside it were the disk of larger tables."""
    made = []
    for m in (parts, T):
        monkeypatch.setattr(m, "cut", lambda df, own=m.cut: made.append(df.columns) or own(df))
    edges, targets = _random(spark, 7)
    i = IM.impact(edges, targets, **_touched(spark), part=graphs._repo)
    assert i.scores.count() == targets.count() and i.components.count() == 5 * targets.count() and made == [["part", "kind", "a", "b", "value"]]
    plan = i.scores._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_chains_of_one_component_are_written_by_many_tasks(spark, monkeypatch):
    """One component whose search is cut into stretches: the same cycles as an uncut one, out of more than one task."""
    rng = random.Random(3)
    adjacent = {}
    for s, d in sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(300)}):
        adjacent.setdefault(f"n{s:02d}", []).append(f"n{d:02d}")
    edges = spark.createDataFrame([(s, d) for s, ds in adjacent.items() for d in ds], "src string, dst string")
    monkeypatch.setattr(C, "STRETCH_IDS", 200)
    got = C.cycles(edges)
    tasks = [len(p) for p in got.rdd.glom().collect()]
    assert sum(n > 0 for n in tasks) > 4
    assert sorted((tuple(r.chain[:-1]) for r in got.collect()), key=lambda c: (len(c), c)) == C.search(adjacent)


def _cyclic(seed):
    """Edges of three components of repositories a, b and c, with self edges, tails and a node that is alone with itself."""
    rng = random.Random(seed)
    edges = {(f"{p}n{rng.randrange(15):02d}", f"{p}n{rng.randrange(15):02d}") for p in "abc" for _ in range(40)} | {("cn03", "ct1"), ("ct1", "ct2"), ("ct2", "ct3"), ("d", "d")}
    adjacent = {}
    for s, d in sorted(edges):
        adjacent.setdefault(s, []).append(d)
    return sorted(edges), C.search(adjacent)


def test_cycles_of_a_graph_that_a_task_takes_need_no_labels(spark, monkeypatch):
    edges, want = _cyclic(1)
    monkeypatch.setattr(C, "components", lambda edges: pytest.fail("labels"))
    got = C.cycles(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted((tuple(r.chain[:-1]) for r in got.collect()), key=lambda c: (len(c), c)) == want


def test_cycles_of_larger_graphs_are_trimmed_by_one_join_a_round(spark, monkeypatch):
    edges, want = _cyclic(2)
    cut, joins = C.cut, []
    monkeypatch.setattr(C, "cut", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join")) or cut(df))
    held = spark.createDataFrame(edges, "src string, dst string")
    trimmed = C.trim(held)
    assert set(joins) == {1} and 1 < len(joins) <= C.TRIM_ROUNDS and not trimmed.filter("dst LIKE 'ct%'").count()
    monkeypatch.setattr(C, "TASK_ROWS", 0)
    assert sorted((tuple(r.chain[:-1]) for r in C.cycles(held).collect()), key=lambda c: (len(c), c)) == want


@pytest.mark.parametrize("group", [1, 1000])
def test_stretches_hold_what_their_chains_need(monkeypatch, group):
    """Components in batches that cut them, names beyond ASCII: chains as of one search; a tail without a cycle isn't carried on."""
    edges, want = _cyclic(3)
    rename = lambda x: x.replace("n1", "\U0001d4b3").replace("n0", "\uffee")
    found = lambda stretches: sorted((tuple(x[:-1]) for b in C._chains(iter(stretches)) for x in b.column(0).to_pylist()), key=lambda c: (len(c), c))
    monkeypatch.setattr(C, "GROUP_ROWS", group, raising=False)
    rows = [(s[0], s, d) for s, d in edges]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["component", "src", "dst"])
    stretches = list(C._stretches((batch(rows[i : i + 7]) for i in range(0, len(rows), 7)), 20))
    assert found(stretches) == want and not any("ct2" in b.column(0)[0].as_py() for b in stretches)
    adjacent = {}
    for s, d in sorted((rename(s), rename(d)) for s, d in edges):
        adjacent.setdefault(s, []).append(d)
    named = list(C._stretches(iter([batch([(k, rename(s), rename(d)) for k, s, d in rows])]), 20))
    assert found(named) == C.search(adjacent)


def _states(spark, folder):
    """Two repositories' states as files: an older version, a superseded row, ids, paths and dependencies that are missing, absent, doubled or own."""
    row = lambda repo, version, entity, path, to, at=1: (repo, version, entity, f"name of {entity}", path, "role", 0.5, "critical", 3, 0.5, ["cycle"], to, "domain", "layer", at)
    held = [
        row(1, 2, "a", "pa", ["b", None, "b", "a", "gone"]), row(1, 2, "b", "pb", ["c"]), row(1, 2, "c", "pc", ["a"]), row(1, 2, "c", "pc", [], 2), row(1, 2, "x", "px", None), row(1, 2, None, "pn", ["a"]),
        row(1, 1, "c", "pc", ["x"]), row(2, 1, "a", "pa", ["b"]), row(2, 1, "b", "pb", []), row(None, 1, "a", "pa", ["a"]),
    ]
    columns = "repo_id long, version int, entity_id string, entity_name string, path string, architecture_role string, importance double, criticality string, complexity int, health_score double, risks array<string>, depends_on array<string>, belongs_to_domain string, belongs_to_layer string, ingested_at long"
    spark.createDataFrame(held, columns).write.parquet(f"{folder}/entity_states.parquet")
    spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, True)], "repo_id long, version int, is_full_snapshot boolean").write.parquet(f"{folder}/snapshots.parquet")
    return str(folder)


def _scans(df):
    """How often the plan that ran read states, and whether it carried columns that nothing asks for."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet [^\n]*entity_id", ran)), any(c in ran for c in ("entity_name", "health_score", "architecture_role"))


def test_reach_depth_batch_shuffles_states_and_edges_once(spark, monkeypatch, tmp_path):
    """Both ends of the edges come out of one reading of two columns; the edges aren't shuffled again to be told apart, though they may repeat."""
    d, seen = _states(spark, tmp_path), []
    assert rows(I.repo_edges(spark, d)) == sorted([(1, "pa", "pa"), (1, "pa", "pb"), (1, "pb", "pc"), (1, "pn", "pa"), (2, "pa", "pb")], key=str)
    assert _scans(I.repo_edges(spark, d)) == (1, False)
    monkeypatch.setattr(parts, "cut", lambda df, own=parts.cut: seen.append(df) or own(df))
    got = rows(graphs.QUERIES["reach_depth_batch"](spark, d))
    assert got == [("1|pa", "1|pn", 1), ("1|pb", "1|pa", 1), ("1|pb", "1|pn", 2), ("1|pc", "1|pa", 2), ("1|pc", "1|pb", 1), ("1|pc", "1|pn", 3), ("2|pb", "2|pa", 1)] and _scans(seen[0]) == (1, False)
    e = spark.createDataFrame([("1|b", "1|a"), ("1|b", "1|a"), ("1|c", "1|b")], "src string, dst string")
    t = T.traverse(e, spark.createDataFrame([("1|a",)], "target string"))
    assert rows(t.nodes) == [("1|a", "1|b", 1, "1|a", 1), ("1|a", "1|c", 2, "1|b", 2)] and "Exchange" not in seen[1].filter("kind = -2")._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([(1, "a", None, ["a", "b"]), (1, "b", "pb", ["a"])], "repo_id long, entity_id string, path string, depends_on array<string>")
    assert rows(I.edges_of(none)) == sorted([(1, None, None), (1, None, "pb"), (1, "pb", None)], key=str)


def test_impact_components_shuffle_states_once(spark, monkeypatch, tmp_path):
    """Edges and what their files hold come out of one reading of the columns that are asked for."""
    d, seen = _states(spark, tmp_path), []
    monkeypatch.setattr(parts, "cut", lambda df, own=parts.cut: seen.append(df) or own(df))
    got = rows(analysis.QUERIES["impact_components"](spark, d).filter("kind IN ('reach', 'risk')"), "target", "kind", "raw", "status")
    assert got == sorted([(t, k, v, "available") for t, n, r in (("1|pa", 1.0, 14.0), ("1|pb", 2.0, 21.0), ("1|pc", 3.0, 28.0), ("2|pb", 1.0, 14.0)) for k, v in (("reach", n), ("risk", r))], key=str)
    assert len(seen) == 1 and _scans(seen[0]) == (1, False)
