"""What changed between consecutive full snapshots of a table.

States are range-partitioned and sorted by entity key; within a range every entity's
rows stream past in version order and each row is compared with its neighbour. That is the
two-pointer merge of neighbouring snapshots, for all pairs of versions in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_COLUMNS = (
    "kind", "entity_name", "path", "architecture_role", "importance", "criticality", "complexity",
    "health_score", "risks", "depends_on", "belongs_to_domain", "belongs_to_layer",
)


def _fingerprint(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """128 bits over exactly compared columns. Nulls skip a hash step, so null flags and set sizes enter too."""
    parts: list[Column] = []
    for name in columns:
        value = F.col(f"`{name}`")
        parts.append(value.isNull())
        if isinstance(df.schema[name].dataType, T.ArrayType):
            value = F.array_sort(F.array_distinct(value))
            parts.append(F.size(value))
        parts.append(value)
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def _differs(now: Column, before: Column, tolerance: float) -> Column:
    same_special = now.eqNullSafe(before)  # null = null, NaN = NaN, equal infinities
    near = F.coalesce(F.abs(now - before) < tolerance, F.lit(False))
    return ~(same_special | near)


def full_versions(snapshots: DataFrame, group: str = "repo_id", version: str = "version", full: str = "is_full_snapshot") -> DataFrame:
    """Full versions of each group with the full version before and after."""
    chain = Window.partitionBy(group).orderBy(version)
    return (
        snapshots.filter(F.col(full) & F.col(group).isNotNull() & F.col(version).isNotNull())
        .select(group, version)
        .distinct()
        .withColumn("_before", F.lag(version).over(chain))
        .withColumn("_after", F.lead(version).over(chain))
    )


def snapshot_changes(
    states: DataFrame,
    snapshots: DataFrame,
    *,
    group: str = "repo_id",
    entity: str = "entity_id",
    version: str = "version",
    full: str = "is_full_snapshot",
    latest_by: str = "ingested_at",
    compare: Sequence[str] = ENTITY_COLUMNS,
    tolerance: float = 1e-6,
    report_columns: bool = False,
) -> DataFrame:
    """Added, removed and modified entities between each full version and the next.

    Of several rows of one (group, version, entity) the one with the greatest ``latest_by``
    holds (null is oldest; a full tie goes to the greatest content fingerprint). Arrays compare
    as sets, doubles within ``tolerance``, null equals null, a null array differs from an empty
    one. Rows with a null key name no entity and are left out; a full version without rows counts
    as an empty snapshot. Extra columns are ignored. An empty input gives no rows.
    With ``report_columns`` an array ``changed_columns`` names what was modified (one fingerprint
    per column instead of one per row).

    Scale: superseded rows fold into one per key before the range shuffle (map-side combine), so a
    hot key is never gathered; ranges cut a hot group at entity keys. Only keys, fingerprints and
    the tolerance-compared doubles are shuffled, never texts or arrays.
    """
    doubles = [c for c in compare if isinstance(states.schema[c].dataType, (T.DoubleType, T.FloatType))]
    exact = [c for c in compare if c not in doubles]
    groups = [[c] for c in exact] if report_columns else [exact]
    prints: dict[str, Column] = {}
    for i, names in enumerate(groups):
        prints[f"_p{i}"], prints[f"_q{i}"] = _fingerprint(states, names)
    values = {f"_d{i}": F.col(f"`{c}`") for i, c in enumerate(doubles)}

    chain = full_versions(snapshots, group, version, full)
    slim = states.filter(F.col(group).isNotNull() & F.col(version).isNotNull() & F.col(entity).isNotNull()).select(
        group, version, entity, F.col(latest_by).alias("_at"), *[v.alias(k) for k, v in {**prints, **values}.items()]
    )
    held = (
        slim.join(chain, [group, version])
        .groupBy(group, entity, version, "_before", "_after")
        .agg(F.max(F.struct("_at", *prints, *values)).alias("_row"))
        .select(group, entity, version, "_before", "_after", *[F.col(f"_row.{k}").alias(k) for k in (*prints, *values)])
    )
    ranged = held.repartitionByRange(group, entity)
    stream = Window.partitionBy(group, entity).orderBy(version)
    ranged = ranged.withColumn("_lag", F.lag(F.struct(version, *prints, *values)).over(stream)).withColumn("_lead", F.lead(version).over(stream))

    changed = [(c, ~(F.col(f"_p{i}").eqNullSafe(F.col(f"_lag._p{i}")) & F.col(f"_q{i}").eqNullSafe(F.col(f"_lag._q{i}")))) for i, c in enumerate(exact if report_columns else ["*"])]
    changed += [(c, _differs(F.col(f"_d{i}"), F.col(f"_lag._d{i}"), tolerance)) for i, c in enumerate(doubles)]
    any_change = F.lit(False)
    for _, test in changed:
        any_change = any_change | test
    names = F.filter(F.array(*[F.when(test, F.lit(c)) for c, test in changed]), lambda x: x.isNotNull()) if report_columns else F.lit(None)

    def event(old: str, new: str, kind: str, columns: Column) -> Column:
        return F.struct(F.col(old).alias("from_version"), F.col(new).alias("to_version"), F.lit(kind).alias("change_kind"), columns.cast("array<string>").alias("changed_columns"))

    none = F.lit(None)
    follows = F.col(f"_lag.{version}").eqNullSafe(F.col("_before"))
    events = F.array(
        F.when(F.col("_before").isNotNull() & ~follows, event("_before", version, "added", none)),
        F.when(F.col("_before").isNotNull() & follows & any_change, event("_before", version, "modified", names)),
        F.when(F.col("_after").isNotNull() & ~F.col("_lead").eqNullSafe(F.col("_after")), event(version, "_after", "removed", none)),
    )
    out = ranged.select(group, entity, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("_e"))
    columns = [group, "_e.from_version", "_e.to_version", entity, "_e.change_kind"]
    return out.select(*columns, *(["_e.changed_columns"] if report_columns else []))


def change_set(changes: DataFrame, group: str = "repo_id", entity: str = "entity_id") -> DataFrame:
    """Counts of each version step: the summary form of a change set."""
    kind = F.col("change_kind")
    return changes.groupBy(group, "from_version", "to_version").agg(
        F.count_if(kind == "added").alias("n_added"),
        F.count_if(kind == "removed").alias("n_removed"),
        F.count_if(kind == "modified").alias("n_modified"),
    )


def keep_snapshots(states: DataFrame, path: str, group: str = "repo_id", entity: str = "entity_id", version: str = "version") -> None:
    """Write states range-partitioned and sorted by key, the layout the merge reads best: row-group
    statistics then prune by key range."""
    states.repartitionByRange(group, entity).sortWithinPartitions(group, entity, version).write.mode("overwrite").parquet(path)
