"""Change streams and state differences."""

import random
from datetime import datetime, timedelta

import pytest

from strataforge.operators import diffs as D
from strataforge.streaming import changes as W
from tests.conftest import rows

SCHEMA = "path string, kind string, epoch int, sequence bigint, at timestamp"
T0 = datetime(2024, 1, 1)


def ch(spark, items):
    return spark.createDataFrame([(p, k, e, s, T0 + timedelta(milliseconds=100 * s if s is not None else 0)) for p, k, e, s in items], SCHEMA)


@pytest.mark.parametrize("width", [2, 3, 4096])
def test_fold_equals_a_sequential_fold(spark, width):
    rng = random.Random(width)
    items = [(rng.choice("abc"), rng.choice(W.KINDS[1:]), 1, i) for i in range(200)]
    want = {}
    for p, k, _, _ in items:
        want[p] = W.merge_kinds(want.get(p), k)
    got = {r.path: r.kind for r in W.fold_changes(ch(spark, items), width).collect()}
    assert got == {p: k for p, k in want.items() if k}


def test_fold_edges(spark):
    assert W.fold_changes(ch(spark, [])).count() == 0
    got = W.fold_changes(ch(spark, [("a", "created", 1, 1), ("a", "deleted", 1, 2), (None, "created", 1, 3), ("b", "deleted", 1, 4), ("b", "created", 1, 5), ("c", "modified", 1, None)]))
    assert rows(got) == [("b", "modified")]


def test_order_debounce_overflow(spark):
    df = ch(spark, [("a", "modified", 1, 1), ("a", "modified", 1, 2), ("a", "modified", 0, 3), ("a", "modified", 2, 9)])
    assert rows(W.accepted(df, ["path"]), "sequence") == [(1,), (2,), (9,)]
    assert rows(W.debounced(df, ["path"]), "n") == [(1,), (3,)]
    assert rows(W.overflows(df, ["path"], 0), "epoch", "overflow") == [(0, True), (1, True), (2, True)]


def test_streaming_twin(spark, tmp_path):
    items = [("a", "created", 1, 1), ("b", "deleted", 1, 2), ("a", "deleted", 1, 3), ("b", "modified", 1, 4), ("c", "created", 1, 5)]
    for i in range(0, len(items), 2):
        ch(spark, items[i : i + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def sink(batch, _):
        for r in batch.collect():
            seen[r.path] = r.kind

    q = W.pending_stream(W.stream_changes(spark, str(tmp_path / "in"), SCHEMA, 10)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.path: r.kind for r in W.fold_changes(ch(spark, items)).collect()}
    assert {p: k for p, k in seen.items() if k != "none"} == want


def test_refresher_and_bus(spark):
    calls = []
    r = W.Refresher(lambda df: calls.append(sorted(x.path for x in df.collect())), lambda: calls.append("rescan"), limit=2)
    r(ch(spark, [("a", "created", 1, 1), ("b", "modified", 1, 2)]), 0)
    r(ch(spark, [("a", "created", 1, 1)]), 0)  # replayed
    r(ch(spark, [("x", "created", 1, 3), ("y", "created", 1, 4), ("z", "created", 1, 5)]), 1)
    r(ch(spark, [("x", "created", 2, 1)]), 2)
    assert calls == [["a", "b"], "rescan", "rescan"] and r.generation == 3
    bus, heard = W.EventBus(), []
    bus.on("e", lambda _: 1 / 0)
    bus.once("e", heard.append)
    bus.emit("e", 1)
    bus.emit("e", 2)
    assert heard == [1] and len(bus.errors) == 2
    assert W.overall_progress("parse", 0.5) == 30 and W.overall_progress("parse", 9) == 45


def test_diffs(spark):
    s = "id string, a int, tags array<string>, grp string"
    before = spark.createDataFrame([("x", 1, ["p", "q"], "g"), ("y", 1, None, None), ("z", 1, [], "g")], s)
    after = spark.createDataFrame([("x", 1, ["q", "p"], "g"), ("y", 2, None, "h"), ("w", 1, [], "g")], s)
    assert rows(D.diff_by_key(before, after, ["id"], ["a", "tags", "grp"])) == [("w", "added"), ("y", "modified"), ("z", "removed")]
    assert rows(D.field_changes(before, after, ["id"], ["a", "tags", "grp"])) == [("y", "a", "1", "2"), ("y", "grp", "null", '"h"')]
    assert rows(D.membership_changes(before, after, ["id"], "grp")) == [("y", None, "h")]
    assert rows(D.added_removed_kept(before, after, ["id"])) == [("w", "added"), ("x", "kept"), ("y", "kept"), ("z", "removed")]
    h = lambda df: D.state_hash(df, ["grp"], ["id"]).filter("grp = 'g'").first().hash
    assert h(before) == h(before.orderBy("id", ascending=False).repartition(3))
    assert D.diff_by_key(before.limit(0), after.limit(0), ["id"], ["a"]).count() == 0


def test_flushes_against_a_plain_loop(spark):
    import random
    from datetime import datetime, timedelta

    rng, zero = random.Random(3), datetime(2024, 1, 1)
    items, want = [], []
    for key in ("a", "b", "c"):
        times, t = [], 0
        for _ in range(400):
            t += rng.choice([1, 30, 120, 200, 249, 250, 400]) if key != "c" else 100
            times.append(t)
        items += [(key, zero + timedelta(milliseconds=x)) for x in times]
        start = last = times[0]
        n = 0
        for x in times:
            if x - last >= 250 or x - start >= 2000:
                want.append((key, zero + timedelta(milliseconds=start), zero + timedelta(milliseconds=last), n))
                start, n = x, 0
            last, n = x, n + 1
        want.append((key, zero + timedelta(milliseconds=start), zero + timedelta(milliseconds=last), n))
    df = spark.createDataFrame([*items, ("z", None)], "path string, at timestamp")
    got = [tuple(r) for r in W.flushed(df, ["path"]).collect()]
    shift = got and min(r[1] for r in got if r[0] == "a") - min(r[1] for r in want if r[0] == "a")
    assert sorted(got) == sorted((k, a + shift, b + shift, n) for k, a, b, n in want)
    assert W.flushed(df.limit(0), ["path"]).count() == 0
