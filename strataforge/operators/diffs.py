"""Differences of two states of a table: keys, fields, memberships, canonical form, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.rules import SIGNIFICANCE_WEIGHTS, SIGNIFICANT_HEALTH, SNAPSHOT_METRICS


def canonical(df: DataFrame, column: str) -> Column:
    """A column in canonical form: arrays in order, everything else as it is."""
    c = F.col(column)
    return F.array_sort(c) if isinstance(df.schema[column].dataType, T.ArrayType) else c


def canonical_state(df: DataFrame) -> DataFrame:
    return df.select(*[canonical(df, c).alias(c) for c in df.columns])


def _marked(df: DataFrame, key: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    return df.select(*key, *[canonical(df, c).alias(f"_{side}_{c}") for c in columns], F.lit(True).alias(f"_{side}"))


def diff_by_key(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key..., change): added, removed or modified rows; null equals null, arrays compare without order."""
    j = _marked(before, key, columns, "b").join(_marked(after, key, columns, "a"), list(key), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~same, "modified")
    return j.select(*key, change.alias("change")).filter("change IS NOT NULL")


def field_changes(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key..., field, old, new) as JSON text for each field that differs, in rows held by both."""
    j = _marked(before, key, columns, "b").join(_marked(after, key, columns, "a"), list(key))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)
    items = [F.when(~F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}")), F.struct(F.lit(c).alias("field"), text(f"_b_{c}").alias("old"), text(f"_a_{c}").alias("new"))) for c in columns]
    return j.select(*key, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def membership_changes(before: DataFrame, after: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """(key..., before, after) of rows in both whose membership differs."""
    j = before.select(*key, F.col(column).alias("before")).join(after.select(*key, F.col(column).alias("after")), list(key))
    return j.filter(~F.col("before").eqNullSafe(F.col("after")))


def added_removed_kept(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., side): added, removed or kept keys, in one full outer join."""
    b, a = before.select(*key).distinct().withColumn("_b", F.lit(True)), after.select(*key).distinct().withColumn("_a", F.lit(True))
    side = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("kept")
    return b.join(a, list(key), "full_outer").select(*key, side.alias("side"))


def state_hash(df: DataFrame, keys: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """(keys..., n_rows, hash): order-independent digest of each group's canonical rows, without volatile columns.

    Row digests add up in two halves of 64 bits, so a group of any size folds map-side.
    """
    columns = sorted(c for c in df.columns if c not in skip and c not in keys)
    row = F.sha2(F.to_json(F.struct(*[canonical(df, c).alias(c) for c in columns])), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(20,0)"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", part(1).cast("string"), part(13).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("hash"))


def snapshot_metrics(summary: DataFrame, keys: Sequence[str] = ("repo_id", "version")) -> DataFrame:
    """(keys..., metrics): the flat metrics of each version, by name. ``summary`` has one row per version with a column for each metric
    (its name with underscores); a column that's missing or null gives no metric."""
    held = [F.struct(F.lit(m).alias("key"), F.col(c).cast("double").alias("value")) for m in SNAPSHOT_METRICS if (c := m.replace(".", "_")) in summary.columns]
    return summary.select(*keys, F.map_from_entries(F.filter(F.array(*held), lambda e: e["value"].isNotNull())).alias("metrics"))


def history(snapshots: DataFrame, limit: int | None = None, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Versions newest first with the version before; with ``limit`` the newest of each group (a report)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    chain = Window.partitionBy(*keys).orderBy("version")
    out = snapshots.withColumn("parent_version", F.lag("version").over(chain)).withColumn("place", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("place") <= limit)


def version_diff(metrics: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., from_version, to_version, health_delta, dimension_deltas, significance) of consecutive versions.

    ``metrics`` has keys, version and a map. A metric that a version lacks counts as 0. ``dimension_deltas`` has the health dimensions of the
    later version. Significance: entities changed (as a part of those before), whether the number of domains changed, and health points of 20.
    """
    chain = Window.partitionBy(*keys).orderBy("version")
    m = metrics.withColumns({"from_version": F.lag("version").over(chain), "_from": F.lag("metrics").over(chain)}).filter("from_version IS NOT NULL")
    at = lambda c, k: F.coalesce(F.try_element_at(F.col(c), F.lit(k) if isinstance(k, str) else k), F.lit(0.0))
    delta = lambda k: at("metrics", k) - at("_from", k)
    entities = F.least(F.lit(1.0), F.abs(delta("entities.total")) / F.greatest(F.lit(1.0), F.coalesce(F.try_element_at("_from", F.lit("entities.total")), F.lit(1.0))))
    domains = F.when(F.abs(delta("domains.total")) > 0, 0.5).otherwise(0.0)
    health = F.least(F.lit(1.0), F.abs(delta("health.overall")) / SIGNIFICANT_HEALTH)
    dimensions = F.filter(F.map_keys("metrics"), lambda k: k.startswith("health.") & (k != "health.overall"))
    deltas = F.map_from_entries(F.transform(dimensions, lambda k: F.struct(F.substring(k, 8, 100).alias("key"), delta(k).alias("value"))))
    parts = zip(SIGNIFICANCE_WEIGHTS, (entities, domains, health), strict=True)
    value = F.least(F.lit(1.0), sum((x * w for w, x in parts), F.lit(0.0)))
    return m.select(*keys, "from_version", F.col("version").alias("to_version"), delta("health.overall").alias("health_delta"), deltas.alias("dimension_deltas"), value.alias("significance"))


def snapshot_hash(summary: DataFrame) -> DataFrame:
    """``summary`` with the first 16 hex digits of the digest of its identity as JSON: id, version, entity_count, module_count,
    health_score and architecture, in this order, whole numbers without a fraction. A null is a JSON null."""
    number = lambda c: F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string"))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    fields = [("id", text("id")), ("version", number("version")), ("entityCount", number("entity_count")), ("moduleCount", number("module_count")), ("healthScore", number("health_score")), ("architecture", text("architecture"))]
    held = [F.concat(F.lit(f'"{n}":'), F.coalesce(F.when(v != "", v), F.lit("null"))) for n, v in fields]
    return summary.withColumn("hash", F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *held), F.lit("}")), 256), 1, 16))


def is_full_version(version: Column) -> Column:
    """Versions that are kept in full: the first and each tenth."""
    return (version == 1) | (version % 10 == 0)
