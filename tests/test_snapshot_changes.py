"""Snapshot changes against brute force, with nulls, ties, repeats, empty tables and clashing extra columns."""

import random
from datetime import datetime, timedelta

import pytest

from strataforge.operators.snapshot_changes import change_set, full_versions, keep_snapshots, snapshot_changes

STATE = (
    "repo_id bigint, version int, entity_id string, kind string, entity_name string, path string, architecture_role string, importance double, criticality string, complexity int, "
    "health_score double, risks array<string>, depends_on array<string>, belongs_to_domain string, belongs_to_layer string, ingested_at timestamp, _row string, _lag int, change_kind string"
)
SNAP = "repo_id bigint, version int, is_full_snapshot boolean, taken_at timestamp"
T0 = datetime(2024, 1, 1)


def state(repo, version, entity, at=0, **f):
    base = dict(kind="file", entity_name="n", path="p", architecture_role="r", importance=0.5, criticality="low", complexity=1, health_score=0.9, risks=["a", "b"], depends_on=[], belongs_to_domain=None, belongs_to_layer="l") | f
    return (repo, version, entity, *base.values(), T0 + timedelta(seconds=at) if at is not None else None, "x", 1, "clash")


def run(spark, states, snaps, **kw):
    out = snapshot_changes(spark.createDataFrame(states, STATE), spark.createDataFrame([(r, v, f, T0) for r, v, f in snaps], SNAP), **kw)
    return sorted(map(tuple, out.collect()), key=str)


def test_kinds(spark):
    states = [state(1, 1, "a"), state(1, 1, "b"), state(1, 3, "a", complexity=2), state(1, 3, "c"), state(1, 2, "z"), state(1, 5, "a", complexity=2)]
    got = run(spark, states, [(1, 1, True), (1, 2, False), (1, 3, True), (1, 5, True)])
    assert got == sorted([(1, 1, 3, "a", "modified"), (1, 1, 3, "b", "removed"), (1, 1, 3, "c", "added"), (1, 3, 5, "c", "removed")], key=str)


def test_comparison_rules(spark):
    same = [state(1, 1, "a", risks=["a", "b", "b"], importance=0.5), state(1, 2, "a", risks=["b", "a"], importance=0.5000000001)]
    assert run(spark, same, [(1, 1, True), (1, 2, True)]) == []
    for change in ({"importance": 0.50001}, {"importance": None}, {"belongs_to_domain": "d"}, {"risks": None}, {"risks": ["a", None]}, {"depends_on": None}, {"kind": "n", "entity_name": "file"}):
        assert run(spark, [state(1, 1, "a"), state(1, 2, "a", **change)], [(1, 1, True), (1, 2, True)]) == [(1, 1, 2, "a", "modified")], change
    nan = float("nan")
    assert run(spark, [state(1, 1, "a", importance=nan), state(1, 2, "a", importance=nan)], [(1, 1, True), (1, 2, True)]) == []


def test_latest_row_holds_and_repeats_and_ties(spark):
    states = [state(1, 1, "a", complexity=9, at=5), state(1, 1, "a", complexity=1, at=9), state(1, 1, "a", complexity=7, at=None), state(1, 2, "a", complexity=1), state(1, 2, "a", complexity=1)]
    assert run(spark, states, [(1, 1, True), (1, 2, True), (1, 2, True)]) == []
    tie = [state(1, 1, "a", complexity=1), state(1, 1, "a", complexity=2), state(1, 2, "a", complexity=2), state(1, 2, "a", complexity=1)]
    assert run(spark, tie, [(1, 1, True), (1, 2, True)]) == []  # the same row wins on both sides


def test_null_keys_empty_versions_and_tables(spark):
    assert run(spark, [state(None, 1, "a"), state(1, None, "a"), state(1, 1, None)], [(1, 1, True), (1, 2, True)]) == []
    assert run(spark, [state(1, 1, "a")], [(1, 1, True), (1, 2, True), (1, 3, True)]) == [(1, 1, 2, "a", "removed")]
    assert run(spark, [], [(1, 1, True)]) == [] and run(spark, [state(1, 1, "a")], []) == []


def test_changed_columns_and_summary(spark):
    states = [state(1, 1, "a"), state(1, 2, "a", complexity=5, importance=0.9)]
    got = run(spark, states, [(1, 1, True), (1, 2, True)], report_columns=True)
    assert got[0][:5] == (1, 1, 2, "a", "modified") and sorted(got[0][5]) == ["complexity", "importance"]
    out = snapshot_changes(spark.createDataFrame(states, STATE), spark.createDataFrame([(1, 1, True, T0), (1, 2, True, T0)], SNAP))
    assert list(map(tuple, change_set(out).collect())) == [(1, 1, 2, 0, 0, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)
    snaps = [(r, v, rng.random() < 0.6) for r in (1, 2) for v in range(1, 7)]
    states = [state(r, v, e, at=rng.randint(0, 3), complexity=rng.randint(0, 2)) for r in (1, 2) for v in range(1, 7) for e in "abcdef" for _ in range(rng.choice([0, 1, 1, 2]))]
    states = list({s[:3] + (s[15],): s for s in states}.values())  # no ties of different content
    held = {}
    for s in states:
        k = s[:3]
        if k not in held or s[15] > held[k][15]:
            held[k] = s
    want = set()
    for r in (1, 2):
        full = [v for a, v, f in snaps if a == r and f]
        for a, b in zip(full, full[1:], strict=False):
            x, y = {k[2]: s[9] for k, s in held.items() if k[:2] == (r, a)}, {k[2]: s[9] for k, s in held.items() if k[:2] == (r, b)}
            want |= {(r, a, b, e, "added") for e in y.keys() - x.keys()} | {(r, a, b, e, "removed") for e in x.keys() - y.keys()} | {(r, a, b, e, "modified") for e in x.keys() & y.keys() if x[e] != y[e]}
    assert set(run(spark, states, snaps)) == want


def test_layout(spark, tmp_path):
    df = spark.createDataFrame([state(1, v, e) for v in (1, 2) for e in "dcba"], STATE)
    keep_snapshots(df, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 8
    assert full_versions(spark.createDataFrame([(1, 2, True, T0), (1, 5, True, T0)], SNAP)).count() == 2


def test_no_gathering_in_plan(spark):
    out = snapshot_changes(spark.createDataFrame([state(1, 1, "a")], STATE), spark.createDataFrame([(1, 1, True, T0)], SNAP))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "CartesianProduct" not in plan
