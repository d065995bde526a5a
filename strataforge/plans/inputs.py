"""Inputs of the queries on the test tables, and the same as SQL for the comparison.

``repo_*`` come from the entity snapshots and the manifest (many repositories, one of them large); ``part_*`` is one graph
out of the order lines, denser, with merged and self edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.runtime import table

EXT_SQL = "lower(regexp_extract({0}, '\\.([^./]+)$', 1))"
LANG_SQL = (
    "CASE {0} WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' "
    "WHEN 'cjs' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END"
)
NORM_SQL = "regexp_replace(regexp_replace(regexp_replace({0}, '\\\\', '/', 'g'), '/+', '/', 'g'), '^(\\./)+', '')"

BASE = f"""WITH held_manifest AS (
  SELECT repo_id, path, loc, size FROM (
    SELECT repo_id, {NORM_SQL.format("relative_path")} AS path, lines_of_code AS loc, size,
      row_number() OVER (PARTITION BY repo_id, {NORM_SQL.format("relative_path")} ORDER BY scanned_at DESC, file_id DESC, size DESC NULLS LAST, lines_of_code DESC) AS rn FROM manifest) WHERE rn = 1
), newest AS (SELECT repo_id, max(version) AS version FROM snapshots WHERE is_full_snapshot GROUP BY repo_id),
cur AS (
  SELECT repo_id, version, entity_id, entity_name, path, complexity, depends_on, belongs_to_domain, belongs_to_layer, importance, health_score, criticality, architecture_role, risks FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.repo_id, e.version, e.entity_id ORDER BY e.ingested_at DESC) AS rn
    FROM entity_states e JOIN newest n ON e.repo_id = n.repo_id AND e.version = n.version) WHERE rn = 1
), repo_files AS (
  SELECT c.repo_id, c.path, {LANG_SQL.format(EXT_SQL.format("c.path"))} AS language, c.complexity, coalesce(m.loc, 0) AS lines_of_code, coalesce(m.size, 0) AS size
  FROM (SELECT DISTINCT repo_id, path, complexity FROM cur) c LEFT JOIN held_manifest m ON c.repo_id = m.repo_id AND c.path = m.path
), repo_edges AS (
  SELECT DISTINCT a.repo_id, a.src, b.path AS dst FROM (SELECT repo_id, path AS src, unnest(depends_on) AS dep FROM cur) a JOIN cur b ON a.repo_id = b.repo_id AND a.dep = b.entity_id
), raw_edges AS (
  SELECT src, dst, type, is_type_only, specifier_count, false AS is_external FROM (
    SELECT 'part-' || l_partkey AS src, 'part-' || lead(l_partkey) OVER w AS dst,
      CASE l_linenumber % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'type-import' WHEN 2 THEN 're-export' WHEN 3 THEN 'dynamic-import' ELSE 'require' END AS type,
      l_returnflag = 'R' AS is_type_only, CAST(l_quantity AS INTEGER) AS specifier_count
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) WHERE dst IS NOT NULL
), ext_edges AS (
  SELECT 'part-' || l_partkey AS src, 'external:' || s_name AS dst, 'import' AS type, false AS is_type_only, CAST(l_quantity AS INTEGER) AS specifier_count, true AS is_external FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), edges AS (
  SELECT src, dst,
    CASE max(CASE type WHEN 'dynamic-import' THEN 1 WHEN 'type-import' THEN 2 WHEN 're-export' THEN 3 WHEN 'require' THEN 4 ELSE 5 END)
      WHEN 1 THEN 'dynamic-import' WHEN 2 THEN 'type-import' WHEN 3 THEN 're-export' WHEN 4 THEN 'require' ELSE 'import' END AS type,
    bool_and(is_type_only) AS is_type_only, CAST(sum(specifier_count) AS BIGINT) AS specifier_count, bool_and(is_external) AS is_external
  FROM (SELECT * FROM raw_edges UNION ALL SELECT * FROM ext_edges) GROUP BY src, dst
)
"""


def held_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("repo_id", P.normalise("relative_path").alias("path"), "scanned_at", "file_id", "size", F.col("lines_of_code").alias("loc"))
    best = F.max(F.struct("scanned_at", "file_id", "size", "loc")).alias("h")
    return m.groupBy("repo_id", "path").agg(best).select("repo_id", "path", "h.loc", "h.size")


STATE = "entity_name path complexity depends_on belongs_to_domain belongs_to_layer importance health_score criticality architecture_role risks".split()


def current(spark: SparkSession, d: str, columns: Sequence[str] = STATE) -> DataFrame:
    """Entities of each repository's newest full version, of their state the ``columns``; the others aren't shuffled."""
    newest = table(spark, d, "snapshots").filter("is_full_snapshot").groupBy("repo_id").agg(F.max("version").alias("version"))
    rows = table(spark, d, "entity_states").join(newest, ["repo_id", "version"])
    held = F.max_by(F.struct(*columns), "ingested_at").alias("h")
    return rows.groupBy("repo_id", "version", "entity_id").agg(held).select("repo_id", "version", "entity_id", *[f"h.{c}" for c in columns])


def repo_files(spark: SparkSession, d: str) -> DataFrame:
    cur = current(spark, d).select("repo_id", "path", "complexity").distinct()
    return cur.join(held_manifest(spark, d), ["repo_id", "path"], "left").select(
        "repo_id", "path", P.language("path").alias("language"), "complexity", F.coalesce("loc", F.lit(0)).alias("lines_of_code"), F.coalesce("size", F.lit(0)).alias("size")
    )


def repo_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(current(spark, d, ("path", "depends_on")))


def edges_of(cur: DataFrame) -> DataFrame:
    """(repo_id, src, dst) of ``current`` entities. An entity's own id and those that it depends on come out of one row and meet in a window, so that
    the states are read and shuffled once, not for either side of a join."""
    own, to = F.struct(F.col("entity_id").alias("id"), F.lit(True).alias("own")), lambda x: F.struct(x.alias("id"), F.lit(False).alias("own"))
    ids = F.concat(F.array(own), F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), to))
    each = cur.select("repo_id", "path", F.explode(ids).alias("e")).select("repo_id", "path", "e.id", "e.own").filter("repo_id IS NOT NULL AND id IS NOT NULL")
    held = F.max(F.when(F.col("own"), F.struct(F.col("path").alias("dst")))).over(Window.partitionBy("repo_id", "id"))  # a struct, as a path may be null
    return each.withColumn("held", held).filter("NOT own AND held IS NOT NULL").select("repo_id", F.col("path").alias("src"), "held.dst").distinct()


def _part(c: str) -> F.Column:
    return F.concat(F.lit("part-"), F.col(c))


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    kind = F.element_at(F.array(*map(F.lit, ("import", "type-import", "re-export", "dynamic-import", "require"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    li = table(spark, d, "lineitem")
    return li.select(
        _part("l_partkey").alias("src"), F.concat(F.lit("part-"), F.lead("l_partkey").over(w)).alias("dst"), kind.alias("type"),
        (F.col("l_returnflag") == "R").alias("is_type_only"), F.col("l_quantity").cast("int").alias("specifier_count"), F.lit(False).alias("is_external"),
    ).filter("dst IS NOT NULL")


def external_edges(spark: SparkSession, d: str) -> DataFrame:
    li, s = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        _part("l_partkey").alias("src"), F.concat(F.lit("external:"), "s_name").alias("dst"), F.lit("import").alias("type"), F.lit(False).alias("is_type_only"),
        F.col("l_quantity").cast("int").alias("specifier_count"), F.lit(True).alias("is_external"),
    )
