"""Referential integrity of a persisted state: one table of violations; a valid state has none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators import cycles as C
from strataforge.operators import diffs as D
from strataforge.operators import intelligence as N


def duplicates(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return out.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("id"))


def dangling(df: DataFrame, reference: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Keys of ``df`` that ``reference`` lacks (anti join)."""
    out = df.select(*key).distinct().join(reference.select(*key).distinct(), list(key), "left_anti")
    return out.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("id"))


def out_of_range(df: DataFrame, key: Sequence[str], condition: str, rule: str) -> DataFrame:
    return df.filter(condition).select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("id"))


def violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unlike(held: DataFrame, again: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Keys of rows that differ from what is worked out again (or that only one side has)."""
    columns = [c for c in held.columns if c not in key]
    out = D.diff_by_key(held, again.select(*held.columns), key, columns)
    return out.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("id"))


def unreciprocal(entities: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Pairs that one entity names as a dependency and the other not as a dependent, or the other way round; one full outer join."""
    out = entities.select(*key, F.col("id").alias("a"), F.explode("depends_on").alias("b")).distinct()
    back = entities.select(*key, F.explode("depended_on_by").alias("a"), F.col("id").alias("b")).distinct()
    pairs = out.withColumn("_o", F.lit(True)).join(back.withColumn("_b", F.lit(True)), [*key, "a", "b"], "full_outer").filter("_o IS NULL OR _b IS NULL")
    return pairs.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in key], "a", "b").alias("id"))


def suite(t: dict[str, DataFrame], key: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(rule, id) of everything that's wrong with the tables of an analysis: ids that aren't unique, references to what isn't there, dependencies
    without their counterpart, values out of range, cycles that are none, and summaries that don't follow from the tables."""
    k = list(key)
    e, nodes = t["entities"], t["nodes"].select(*k, "id")
    ids, paths = e.select(*k, "id"), e.select(*k, "path")
    edges, own = t["edges"], t["edges"].filter("NOT is_external")
    risks = t["risks"].select(*k, F.explode("affected").alias("path"))
    served = t["capabilities"].select(*k, F.explode("implemented_by").alias("id"))
    ends = t["semantic_edges"].select(*k, F.explode(F.array("src", "dst")).alias("id"))
    broken = C.checks(t["cycles"], own, k).filter("n_broken > 0 OR n_repeated > 0")
    arch = t["architecture"].join(t["layers"].groupBy(*k).agg(F.count(F.lit(1)).alias("n_layers")), k, "left").select(*k, "confidence", "n_layers")
    return violations(
        [
            *[duplicates(t[n], [*k, c], f"{n}-{c}-unique") for n, c in (("entities", "id"), ("nodes", "id"), ("risks", "id"), ("domains", "id"), ("capabilities", "id"), ("semantic_nodes", "id"), ("layers", "name"), ("files", "path"))],
            duplicates(edges, [*k, "src", "dst"], "edges-unique"),
            dangling(edges.select(*k, F.col("src").alias("id")), nodes, [*k, "id"], "edge-source-known"), dangling(edges.select(*k, F.col("dst").alias("id")), nodes, [*k, "id"], "edge-target-known"),
            dangling(e.select(*k, F.explode("depends_on").alias("id")), ids, [*k, "id"], "dependency-known"), dangling(e.select(*k, F.explode("depended_on_by").alias("id")), ids, [*k, "id"], "dependent-known"),
            unreciprocal(e, k, "dependency-reciprocal"), dangling(risks, paths, [*k, "path"], "risk-file-known"), dangling(served, ids, [*k, "id"], "capability-entity-known"),
            dangling(t["critical"], paths, [*k, "path"], "critical-file-known"), dangling(ends, t["semantic_nodes"], [*k, "id"], "semantic-end-known"), dangling(t["files"], paths, [*k, "path"], "file-is-entity"), dangling(paths, t["files"], [*k, "path"], "entity-is-file"),
            out_of_range(e, [*k, "id"], "NOT (importance BETWEEN 0 AND 1) OR NOT (health BETWEEN 0 AND 1)", "score-range"),
            out_of_range(t["health"], k, "NOT (overall BETWEEN 0 AND 100)", "health-range"), broken.select(F.lit("cycle-is-closed").alias("rule"), F.concat_ws("|", *[F.col(x).cast("string") for x in k]).alias("id")),
            unlike(t["complexity"], N.complexity_profile(e, k), k, "complexity-follows"), unlike(t["risk_assessment"], N.risk_assessment(t["risks"], k), k, "risk-follows"),
            unlike(t["health"], N.health(e, arch, N.risk_exposure(t["risks"], k), None, k), k, "health-follows"), unlike(t["critical"].select(*k, "path", "criticality", "score"), N.critical_components(e, k), [*k, "path"], "critical-follows"),
        ]
    )


def recovery_status(records: DataFrame, required: Sequence[str]) -> DataFrame:
    """(repo_id, version, status) from (repo_id, version, namespace, readable): ``cleanup`` if a required record is
    missing, ``quarantine`` if one can't be read, else ``valid``."""
    r = records.groupBy("repo_id", "version").agg(F.collect_set("namespace").alias("held"), F.bool_and("readable").alias("readable"))
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), F.col("held"))) > 0
    return r.select("repo_id", "version", F.when(missing, "cleanup").when(~F.col("readable"), "quarantine").otherwise("valid").alias("status"))


def recovered(status: DataFrame) -> DataFrame:
    """Newest valid version of each repository."""
    return status.filter("status = 'valid'").groupBy("repo_id").agg(F.max("version").alias("version"))
