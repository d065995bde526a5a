"""Layers, architecture signals and patterns, with the rules as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.rules import LAYERS, MAX_CONFIDENCE, MIN_CONFIDENCE, PATTERN_ORDER, SERVICE_WEIGHTS, SIGNALS


def layer_role(path: Column | str) -> Column:
    """Role of the first layer rule that a segment of the path matches; null if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, names in LAYERS:
        out = out.when(P.has_segment(path, names), role)
    return out


def layer_directory(path: Column | str) -> Column:
    """The path up to the first segment that its layer's rule names."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for _, names in LAYERS:
        place = F.array_min(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position(P.segments(p), n)), lambda i: i > 0))
        out = out.when(P.has_segment(p, names), F.array_join(F.slice(F.split(p, "/"), F.lit(1), place.cast("int")), "/"))
    return out


def infer_layers(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., role, name, rank, directories, file_count); ``rank`` is the order of the rules."""
    order = F.array_position(F.array(*[F.lit(r) for r, _ in LAYERS]), F.col("role"))
    return (
        files.select(*keys, layer_role("path").alias("role"), layer_directory("path").alias("directory"))
        .filter("role IS NOT NULL")
        .groupBy(*keys, "role")
        .agg(F.array_sort(F.collect_set("directory")).alias("directories"), F.count(F.lit(1)).alias("file_count"))
        .select(*keys, "role", F.initcap("role").alias("name"), order.cast("int").alias("rank"), "directories", "file_count")
    )


def directional_evidence(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., pattern, rule, weight, matches): edges from a source to a target segment, for each rule on directions."""
    src, dst = P.segments("src"), P.segments("dst")
    hits = [
        F.when(F.arrays_overlap(src, F.array(*map(F.lit, a))) & F.arrays_overlap(dst, F.array(*map(F.lit, b))), F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("rule"), F.lit(w).alias("weight")))
        for p, r, w, a, b in SIGNALS
        if b
    ]
    return edges.select(*keys, F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull()))).groupBy(*keys, "pattern", "rule", "weight").agg(F.count(F.lit(1)).alias("matches"))


def signals(files: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., pattern, rule, weight, matches) of all rules that match at least once. One pass over files, one over edges."""
    seg = P.segments("path")
    hits = [F.when(F.arrays_overlap(seg, F.array(*map(F.lit, a))), F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("rule"), F.lit(w).alias("weight"))) for p, r, w, a, b in SIGNALS if not b]
    by_path = files.select(*keys, F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull()))).groupBy(*keys, "pattern", "rule", "weight").agg(F.count(F.lit(1)).alias("matches"))
    area = F.regexp_extract(F.lower("path"), r"^((?:.*?/)?(?:services|apps)/[^/]+)/", 1)
    services = files.select(*keys, area.alias("area")).filter("area <> ''").groupBy(*keys).agg(F.count_distinct("area").alias("areas"), F.count(F.lit(1)).alias("matches")).filter("areas >= 2")
    topology = services.select(
        *keys, F.lit("microservice").alias("pattern"), F.lit("microservice.services").alias("rule"), F.when(F.col("areas") >= 3, SERVICE_WEIGHTS[1]).otherwise(SERVICE_WEIGHTS[0]).alias("weight"), "matches"
    )
    return by_path.unionByName(directional_evidence(edges, keys)).unionByName(topology)


def service_topology(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    area = F.regexp_extract(F.lower("path"), r"^((?:.*?/)?(?:services|apps)/[^/]+)/", 1)
    return files.select(*keys, area.alias("area")).filter("area <> ''").groupBy(*keys).agg(F.count_distinct("area").alias("n_services"), F.count(F.lit(1)).alias("n_files"))


def score_patterns(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., pattern, confidence, rules): weights summed to three places, at most 0.98."""
    total = F.floor(F.sum("weight") * 1000 + 0.5) / 1000
    return found.groupBy(*keys, "pattern").agg(F.least(F.lit(MAX_CONFIDENCE), total).alias("confidence"), F.array_sort(F.collect_set("rule")).alias("rules"))


def best_pattern(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The pattern of highest confidence (ties by fixed order) of at least 0.35, else ``unknown`` with 0."""
    rank = F.array_position(F.array(*map(F.lit, PATTERN_ORDER)), F.col("pattern"))
    best = scores.groupBy(*keys).agg(F.max(F.struct("confidence", (-rank).alias("r"), "pattern")).alias("b"))
    sure = F.col("b.confidence") >= MIN_CONFIDENCE
    return best.select(*keys, F.when(sure, F.col("b.pattern")).otherwise("unknown").alias("pattern"), F.when(sure, F.col("b.confidence")).otherwise(0.0).alias("confidence"))
