"""Texts packed into containers of fixed capacity: one global best-fit-decreasing run over a segment tree.

Items of one size are interchangeable, so best fit needs only how many items there are of each size and how many open
containers of each remaining capacity: both are bounded by the capacity, whatever the number of texts. The driver runs it
on counts and keeps a plan of segments ("from this item on, so many a container, from this container on"). The texts are sorted by size
across the cluster, each takes its place in the order, and looks its segment up; no task holds a group of them, and nothing is
packed in shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataforge.functions.rows import flat_map
from strataforge.runtime import cores, cut

TOKENIZER = "byte_bpe_50k.tiktoken"
SCHEMA = "spec_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens int, container_id bigint, position int"


class BestFit:
    """Open containers by remaining capacity. A segment tree over the capacities 0..capacity knows which occur, so the
    tightest container with room is found in logarithmic time. Containers that were filled alike are one range of numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.count = 0

    def _mark(self, remaining: int, on: int) -> None:
        tree, i = self.tree, remaining + self.size
        tree[i] = on
        i >>= 1
        while i:
            value = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == value:
                break
            tree[i] = value
            i >>= 1

    def tightest(self, need: int) -> int:
        """Smallest remaining capacity of at least ``need``; -1 if there is none."""
        tree, i = self.tree, need + self.size
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i *= 2
                    if not tree[i]:
                        i += 1
                return i - self.size
            i >>= 1
        return -1

    def _add(self, remaining: int, first: int, n: int) -> None:
        held = self.open.setdefault(remaining, [])
        held.append((first, n))
        if len(held) == 1:
            self._mark(remaining, 1)

    def _take(self, remaining: int) -> tuple[int, int]:
        held = self.open[remaining]
        out = held.pop()
        if not held:
            self._mark(remaining, 0)
        return out

    def put(self, need: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(items, items a container, first container, position) of ``n`` items of ``need`` tokens, none larger than those before.

        After an item, its container is the tightest one that fits as long as another item fits in it; so containers are filled one by one.
        """
        while n:
            room = self.tightest(need)
            if room < 0:
                room, each = self.capacity, self.capacity // need if need else n
                first, boxes = self.count, -(-n // each)
                self.count += boxes
            else:
                each = room // need if need else n
                first, boxes = self._take(room)
            used = min(boxes, -(-n // each))
            if used < boxes:
                self._add(room, first + used, boxes - used)
            items = min(n, used * each)
            whole = items // each
            if whole:
                self._add(room - each * need, first, whole)
            if whole < used:
                self._add(room - (items - whole * each) * need, first + whole, 1)
            yield items, each, first, self.capacity - room
            n -= items


def plan(counts: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Segments (first item, items a container, first container, position, size) of items in decreasing order of size, and the
    number of containers. ``counts``: (size, items), sizes within the capacity. At most about one and a half segments for each pair of sizes, commonly few a size."""
    bins, out, at = BestFit(capacity), [], 0
    for size, n in sorted(counts, reverse=True):
        for items, each, first, position in bins.put(size, n):
            out.append((at, each, first, position, size))
            at += items
    return np.array(out, np.int64).reshape(-1, 5), bins.count


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row; a null or empty text has none. Whole texts are counted."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(path).encode_ordinary
        for doc_id, text in rows:
            yield doc_id, len(encode(text)) if text else 0

    return flat_map(documents, ["doc_id", "text"], each, "doc_id bigint, n_tokens bigint")


def packed(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Container and position of every item or piece for each capacity of ``specs`` (a small table; null or
    non-positive capacities are left out).

    ``sizes`` has doc_id and n_tokens. Columns: spec_id, doc_id, piece (0 for an undivided item), first_token (of the
    piece within its text), n_tokens, container_id (unique per spec), position (its first token within the container).
    An item beyond the capacity is cut into full pieces and a rest, which is packed like an item.
    Empty texts take no room and lie in some container. Repeated rows are items of their own; rows with a null doc_id
    are kept. No items or no specs give an empty result. Items of one size are placed in the order of doc_id.
    """
    spark = sizes.sparkSession
    capacities = {r.spec_id: r.capacity_tokens for r in specs.filter("capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens")).toLocalIterator()}
    if not capacities:
        return spark.createDataFrame([], SCHEMA)
    each_spec = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in capacities.items()]))
    n = F.col("n_tokens").cast("bigint")
    items = cut(sizes.select("doc_id", n.alias("n_tokens"))).select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row"), each_spec.alias("s")).select("doc_id", "n_tokens", "row", "s.*")
    full = F.when(n > F.col("capacity"), F.floor(n / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    items = items.withColumn("full", full).withColumn("rest", n - F.col("full") * F.col("capacity"))
    items = items.withColumn("rest", F.when((F.col("full") > 0) & (F.col("rest") == 0), -1).otherwise(F.col("rest")))
    # rows of one size and doc_id are told apart by their number, so that a size or id that a third of all rows have spreads over many tasks
    order = ["spec_id", F.desc("rest"), "doc_id", "row"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))
    ordered = items.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("spec_id", "doc_id", "full", "rest", F.spark_partition_id().alias("part"))
    ordered = cut(ordered)
    counts: dict[int, list[tuple[int, int]]] = {k: [] for k in capacities}
    for r in ordered.filter("rest >= 0").groupBy("spec_id", "rest").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts[r.spec_id].append((r.rest, r.n))
    plans = {k: plan(c, capacities[k]) for k, c in counts.items()}
    before: dict[tuple[int, int], tuple[int, int]] = {}
    sums = dict.fromkeys(capacities, (0, 0))
    for r in ordered.groupBy("part", "spec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).orderBy("part").toLocalIterator():
        before[r.part, r.spec_id] = sums[r.spec_id]
        sums[r.spec_id] = (sums[r.spec_id][0] + r.n, sums[r.spec_id][1] + r.full)
    shared = spark.sparkContext.broadcast((capacities, plans, before))
    fields = T.StructType.fromDDL(SCHEMA)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capacities, plans, before = shared.value
        arrow, done = to_arrow_schema(fields), {}
        for batch in batches:
            spec_ids, _, fulls, rests, parts = (c.to_numpy(zero_copy_only=False) if i != 1 else None for i, c in enumerate(batch.columns))
            for spec in np.unique(spec_ids).tolist():
                at = np.flatnonzero(spec_ids == spec)
                key = (int(parts[at[0]]), spec)
                index, pieces = done.get(key, before[key])
                segments, boxes = plans[spec]
                ids, full, rest, capacity = batch.column(1).take(pa.array(at)), fulls[at], rests[at], capacities[spec]
                done[key] = (index + len(at), pieces + int(full.sum()))
                yield from _placed(spec, ids, full, rest, capacity, index + np.arange(len(at)), boxes + pieces, segments, arrow)

    return ordered.mapInArrow(place, fields)


#: Pieces of one Arrow batch.
_OUT_PIECES = 1 << 16


def _placed(spec: int, ids: pa.Array, full: np.ndarray, rest: np.ndarray, capacity: int, index: np.ndarray, next_box: int, segments: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch(take: np.ndarray, piece, first, n, box, position) -> pa.RecordBatch:
        columns = [np.full(len(take), spec), ids.take(pa.array(take)), piece, first, n, box, position]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    held = np.flatnonzero(rest >= 0)
    if len(held):
        k = np.searchsorted(segments[:, 0], index[held], "right") - 1
        first, each, box, position, size = segments[k].T
        j = index[held] - first
        yield batch(held, full[held], full[held] * capacity, rest[held], box + j // each, position + j % each * size)
    for i in np.flatnonzero(full).tolist():
        for start in range(0, int(full[i]), _OUT_PIECES):
            piece = np.arange(start, min(int(full[i]), start + _OUT_PIECES))
            yield batch(np.full(len(piece), i), piece, piece * capacity, np.full(len(piece), capacity), next_box + piece, np.zeros(len(piece), np.int64))
        next_box += int(full[i])


def containers(pieces: DataFrame, specs: DataFrame) -> DataFrame:
    """For each capacity: containers, the fewest that the tokens could take, tokens in them, unused tokens and the share in use."""
    used = pieces.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return used.join(specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens")), "spec_id").select(
        "spec_id", "capacity_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "n_tokens", (room - F.col("n_tokens")).alias("unused_tokens"), (F.col("n_tokens") / room).alias("fill")
    )


def checks(sizes: DataFrame, pieces: DataFrame, specs: DataFrame) -> DataFrame:
    """For each capacity, what a packing must hold: documents placed, and how many containers hold more than the capacity or have
    gaps or overlaps, how many documents are split although they fit, and how many lost or gained tokens.

    ``sizes`` has one row per doc_id. Containers and documents fold map-side into sums: within a container the pieces of lengths n at
    positions p lie end to end exactly if the ends, in order of position, are the next starts, which equal sums of starts and ends and the greatest end tell.
    """
    capacity = specs.filter("capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    end = F.col("position") + F.col("n_tokens")
    full = F.col("n_tokens") > 0
    boxes = pieces.groupBy("spec_id", "container_id").agg(
        F.sum("n_tokens").alias("t"), F.max(end).alias("top"), F.sum(F.when(full, F.col("position"))).alias("starts"), F.sum(F.when(full, end)).alias("ends"), F.sum(F.when(full, end * end - F.col("position") * F.col("position"))).alias("squares")
    )
    boxes = boxes.join(capacity, "spec_id").groupBy("spec_id", "capacity_tokens").agg(
        F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"),
        F.count_if((F.col("t") > 0) & ((F.col("top") != F.col("t")) | (F.col("ends") - F.col("starts") != F.col("top")) | (F.col("squares") != F.col("top") * F.col("top")))).alias("n_loose"),
    )
    documents = pieces.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    documents = documents.join(sizes.select("doc_id", F.col("n_tokens").alias("size")), "doc_id").join(capacity, "spec_id")
    documents = documents.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("k") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_split"), F.count_if(F.col("t") != F.col("size")).alias("n_changed")
    )
    return documents.join(boxes, "spec_id").select("spec_id", "capacity_tokens", "n_documents", "n_overfull", "n_loose", "n_split", "n_changed")
