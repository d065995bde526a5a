"""File changes as a stream: folding, ordering, debouncing, and refresh per micro-batch.

Changes are rows (path, kind, epoch, sequence, at). Each operator has a batch form over a table and a stateful form for Structured
Streaming with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.runtime import cut

KINDS = ("none", "created", "deleted", "modified")
MAX_PENDING = 10_000
DEBOUNCE_MS, MAX_LATENCY_MS = 250, 2000
#: Changes of one path that are folded at once; more are folded level by level.
FOLD_WIDTH = 4096


def merge_kinds(previous: str | None, new: str) -> str | None:
    """Pending kind after one more change; None if nothing is left to report."""
    if previous is None:
        return new
    if previous == "created":
        return None if new == "deleted" else "created"
    return "deleted" if new == "deleted" else "modified"


def _effect(kind: Column) -> Column:
    """What a change makes of each pending kind, in the order of KINDS."""
    table = {k: [merge_kinds(None if p == "none" else p, k) or "none" for p in KINDS] for k in KINDS[1:]}
    out = F.when(F.lit(False), F.array(*map(F.lit, KINDS)))
    for k, row in table.items():
        out = out.when(kind == k, F.array(*map(F.lit, row)))
    return out


def fold_changes(changes: DataFrame, width: int = FOLD_WIDTH) -> DataFrame:
    """(path, kind): the pending kind of each path after all changes in order of sequence; dropped paths are left out.

    A change is a function on pending kinds, and functions compose associatively. So a path's changes are composed
    in stretches of ``width`` sequence numbers, then stretches of stretches: no path, however hot, is gathered at once.
    Rows with a null path or sequence are left out; of repeated sequences of a path the greatest kind holds.
    """
    rows = changes.filter(F.col("path").isNotNull() & F.col("sequence").isNotNull()).groupBy("path", F.col("sequence").alias("at")).agg(F.max("kind").alias("kind"))
    rows = rows.select("path", "at", _effect(F.col("kind")).alias("f"))
    top = rows.agg(F.max("at")).first()[0] or 0
    names = F.array(*map(F.lit, KINDS))
    while True:
        rows = (
            rows.groupBy("path", F.floor(F.col("at") / width).alias("at"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("s"))
            .select("path", "at", F.aggregate("s", names, lambda acc, x: F.transform(acc, lambda k: F.element_at(x["f"], F.array_position(names, k).cast("int")))).alias("f"))
        )
        if top < width:
            break
        top //= width
    return rows.select("path", F.element_at("f", 1).alias("kind")).filter("kind <> 'none'")


def accepted(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Batch form of ordering: per source (``keys``), a change counts if its epoch is the greatest seen so far (in order of ``at``)
    and its sequence exceeds those seen before in that epoch. Both are running maxima over the arrival order."""
    order = Window.partitionBy(*keys).orderBy("at", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "epoch").orderBy("at", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    newest, last = F.max("epoch").over(order), F.max("sequence").over(within)
    return changes.withColumns({"_e": newest, "_s": last}).filter((F.col("_e").isNull() | (F.col("epoch") >= F.col("_e"))) & (F.col("_s").isNull() | (F.col("sequence") > F.col("_s")))).drop("_e", "_s")


def debounced(changes: DataFrame, keys: list[str], gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(keys..., started, ended, n): sessions without a pause of ``gap_ms`` or more; native session windows fold map-side."""
    w = F.session_window("at", f"{gap_ms} milliseconds")
    return changes.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("ended")).select(*keys, F.col("w.start").alias("started"), "ended", "n")


def flushed(changes: DataFrame, keys: list[str], gap_ms: int = DEBOUNCE_MS, latency_ms: int = MAX_LATENCY_MS) -> DataFrame:
    """(keys..., started, ended, n): sessions as a debounce flushes them: after a pause of ``gap_ms``, and at the latest ``latency_ms`` after the first
    change, when the next change begins a new session. Times count in milliseconds; rows with a null time are left out.

    A session's start is a change after a pause, or the first change ``latency_ms`` after the start before it. Which changes follow from each other so is found
    by doubling jumps, in logarithmic rounds; windows hold what falls into twice ``latency_ms`` of a key (and one row for each such stretch), so no key is gathered.
    """
    if not 0 < gap_ms <= latency_ms:
        raise ValueError("the pause has to be positive and at most the latency")
    spark_null = F.lit(None).cast("bigint")
    t = changes.filter("at IS NOT NULL").groupBy(*keys, F.unix_millis(F.col("at").cast("timestamp")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.min("at").alias("first"))
    t = t.withColumn("b", F.floor(F.col("t") / latency_ms))
    within = Window.partitionBy(*keys, "b").orderBy("t")
    last = t.groupBy(*keys, (F.col("b") + 1).alias("b")).agg(F.max("t").alias("_last"))
    t = t.withColumn("_prev", F.lag("t").over(within)).join(last, [*keys, "b"], "left").withColumn("_prev", F.coalesce("_prev", "_last"))
    root = F.col("_prev").isNull() | (F.col("t") - F.col("_prev") >= gap_ms)
    t = t.withColumn("root", F.when(root, F.col("t"))).drop("_prev", "_last")
    # the session of each change: the last change after a pause, in its stretch or carried over from earlier ones
    stretch = t.groupBy(*keys, "b").agg(F.max("root").alias("_r"))
    carried = stretch.withColumn("_carried", F.last("_r", True).over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("_r")
    own = F.last("root", True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    t = cut(t.withColumn("_own", own).join(carried, [*keys, "b"]).withColumn("s", F.coalesce("_own", "_carried")).select(*keys, "b", "t", "s", "n", "at", "first"))
    # the first change at least latency_ms later, of the same session
    asked = t.select(*keys, (F.col("b") + 1).alias("p"), (F.col("t") + latency_ms).alias("o"), F.lit(0).alias("tag"), F.col("t").alias("own"), F.col("s"), spark_null.alias("u"), spark_null.alias("us"))
    there = t.select(*keys, F.explode(F.array("b", F.col("b") - 1)).alias("p"), F.col("t").alias("o"), F.lit(1).alias("tag"), spark_null.alias("own"), spark_null.alias("s"), F.col("t").alias("u"), F.col("s").alias("us"))
    ahead = Window.partitionBy(*keys, "p").orderBy("o", "tag").rowsBetween(0, Window.unboundedFollowing)
    jump = asked.unionByName(there).withColumns({"to": F.first("u", True).over(ahead), "ts": F.first("us", True).over(ahead)}).filter("tag = 0 AND ts = s").select(*keys, F.col("own").alias("t"), "to")
    jump, starts = cut(jump), cut(t.filter("t = s").select(*keys, "t"))
    while True:
        more = starts.join(jump, [*keys, "t"]).select(*keys, F.col("to").alias("t")).join(starts, [*keys, "t"], "left_anti")
        more = cut(more)
        if more.isEmpty():
            break
        starts = cut(starts.unionByName(more))
        jump = cut(jump.join(jump.select(*keys, F.col("t").alias("to"), F.col("to").alias("further")), [*keys, "to"]).select(*keys, "t", F.col("further").alias("to")))
    t = t.join(starts.withColumn("_start", F.col("t")), [*keys, "t"], "left")
    before = starts.groupBy(*keys, (F.floor(F.col("t") / latency_ms) + 1).alias("b")).agg(F.max("t").alias("_before"))
    t = t.withColumn("_start", F.last("_start", True).over(within.rowsBetween(Window.unboundedPreceding, 0))).join(before, [*keys, "b"], "left")
    return t.groupBy(*keys, F.coalesce("_start", "_before").alias("_s")).agg(F.min("first").alias("started"), F.max("at").alias("ended"), F.sum("n").alias("n")).drop("_s")


def overflows(changes: DataFrame, keys: list[str], limit: int = MAX_PENDING) -> DataFrame:
    """(keys..., epoch, n_paths, overflow): pending paths of each epoch and whether they force a full rescan."""
    return changes.groupBy(*keys, "epoch").agg(F.count_distinct("path").alias("n_paths")).withColumn("overflow", F.col("n_paths") > limit)


# -- Structured Streaming --------------------------------------------------------------------------------
def stream_changes(spark: SparkSession, path: str, schema: str = "path string, kind string, epoch int, sequence bigint, at timestamp", max_files: int = 100) -> DataFrame:
    """File source of change records."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def pending_stream(changes: DataFrame) -> DataFrame:
    """Stateful fold: (path, kind) after each micro-batch for paths that changed in it (kind ``none`` where dropped)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, last = state.get if state.exists else (None, -1)
        kind = None if kind in (None, "none") else kind
        rows = pd.concat(frames).sort_values("sequence")
        for k, s in zip(rows.kind, rows.sequence, strict=True):
            if s > last:
                kind, last = merge_kinds(kind, k), int(s)
        state.update((kind or "none", last))
        yield pd.DataFrame({"path": [key[0]], "kind": [kind or "none"]})

    return changes.groupBy("path").applyInPandasWithState(step, "path string, kind string", "kind string, last long", "update", "NoTimeout")


def accepted_stream(changes: DataFrame, source: str) -> DataFrame:
    """Stateful ordering: rows of a lower epoch or of a sequence not beyond the last one are dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        epoch, last = state.get if state.exists else (-1, -1)
        rows = pd.concat(frames).sort_values(["at", "sequence"])
        keep = []
        for e, s in zip(rows.epoch, rows.sequence, strict=True):
            ok = e > epoch or (e == epoch and s > last)
            keep.append(ok)
            if ok:
                epoch, last = int(e), int(s)
        state.update((epoch, last))
        yield rows[keep]

    return changes.groupBy(source).applyInPandasWithState(step, changes.schema, "epoch long, last long", "append", "NoTimeout")


def debounced_stream(changes: DataFrame, keys: list[str], delay: str = "2 seconds", gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Sessions of changes by event time; a session closes once the watermark (the greatest latency) has passed."""
    w = F.session_window("at", f"{gap_ms} milliseconds")
    return changes.withWatermark("at", delay).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, "w.start", "w.end", "n")


@dataclass
class Refresher:
    """Micro-batch sink: folds a batch's changes and hands them on, or calls for a full rescan after an overflow or a newer epoch.

    ``refresh(changes)`` and ``rescan()`` are the incremental and the full pipeline. A batch that was handled before (a
    replay after recovery) is skipped by its id. Results of a stale generation are to be dropped by comparing ``generation``.
    """

    refresh: Callable[[DataFrame], None]
    rescan: Callable[[], None]
    limit: int = MAX_PENDING
    epoch: int = 0
    last_batch: int = -1
    generation: int = 0
    log: list[str] = field(default_factory=list)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return
        self.last_batch = batch_id
        row = batch.agg(F.max("epoch").alias("e"), F.count_distinct("path").alias("n")).first()
        if row.e is None:
            return
        self.generation += 1
        newer = self.epoch and row.e > self.epoch
        self.epoch = max(self.epoch, row.e)
        if newer or row.n > self.limit:
            self.log.append("rescan")
            self.rescan()
        else:
            self.log.append("refresh")
            self.refresh(fold_changes(batch.filter(F.col("epoch") == row.e)).orderBy("path"))


class EventBus:
    """Typed callbacks by event name. A failing listener doesn't keep others from being called."""

    def __init__(self) -> None:
        self._listeners: dict[str, list[Callable]] = {}
        self.errors: list[tuple[str, Exception]] = []

    def on(self, event: str, listener: Callable) -> Callable[[], None]:
        self._listeners.setdefault(event, []).append(listener)
        return lambda: self.off(event, listener)

    def once(self, event: str, listener: Callable) -> None:
        def wrapped(payload):
            self.off(event, wrapped)
            listener(payload)

        self.on(event, wrapped)

    def off(self, event: str, listener: Callable) -> None:
        if listener in self._listeners.get(event, []):
            self._listeners[event].remove(listener)

    def emit(self, event: str, payload=None) -> None:
        for listener in list(self._listeners.get(event, [])):
            try:
                listener(payload)
            except Exception as error:  # noqa: BLE001
                self.errors.append((event, error))


#: Share of the whole at which each stage begins and ends.
STAGES = {"scan": (0, 15), "parse": (15, 45), "graph": (45, 60), "architecture": (60, 65), "knowledge": (65, 75), "synthesis": (75, 88), "intelligence": (88, 96), "persist": (96, 100)}


def overall_progress(stage: str, part: float) -> float:
    start, end = STAGES[stage]
    return start + (end - start) * max(0.0, min(1.0, part))
