"""Dependency graph of files: resolution, merge, degrees, boundaries, repair.

Edges are rows (keys..., src, dst, type, is_type_only, specifier_count, is_external). ``keys`` are the columns that tell
graphs apart (``repo_id``, ``version``); all graphs of a table are worked on in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.rules import EDGE_PRIORITY


def _priority(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv]), kind)


def merge_edges(raw: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One edge per (src, dst): type of highest priority, flags by AND, counts summed. Self edges stay.

    With ``nodes`` (keys..., id) edges whose ends are missing are dropped. The aggregate folds map-side.
    """
    kind = F.max_by("type", _priority(F.col("type")))
    out = raw.groupBy(*keys, "src", "dst").agg(
        kind.alias("type"), F.bool_and("is_type_only").alias("is_type_only"), F.sum(F.col("specifier_count").cast("bigint")).alias("specifier_count"), F.bool_and("is_external").alias("is_external")
    )
    if nodes is not None:
        ids = nodes.select(*keys, "id").distinct()
        for end in ("src", "dst"):
            out = out.join(ids.withColumnRenamed("id", end), [*keys, end], "left_semi")
    return out


def degrees(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., id, in_degree, out_degree, degree) of nodes with an edge; one shuffle of pre-counted ends."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return (
        edges.select(*keys, F.inline(ends))
        .groupBy(*keys, "id")
        .agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))
    )


def kind_counts(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return nodes.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def type_counts(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def nodes_of(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., id, kind) of all ends; ``external:`` ids are of kind external."""
    ids = edges.select(*keys, F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.withColumn("kind", F.when(F.col("id").startswith("external:"), "external").otherwise("file"))


def neighbours(edges: DataFrame, node: str, direction: str = "dependencies") -> DataFrame:
    """Ids next to ``node``, in ordinal order; the filter reaches the scan."""
    here, there = ("src", "dst") if direction == "dependencies" else ("dst", "src")
    return edges.filter(F.col(here) == node).select(F.col(there).alias("id")).distinct().orderBy("id")


def file_neighbours(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., id, depends_on, depended_on_by) over file ends, arrays in order."""
    inner = edges.filter(~F.col("src").startswith("external:") & ~F.col("dst").startswith("external:"))
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("d"), none.alias("b")), F.struct(F.col("dst").alias("id"), none.alias("d"), F.col("src").alias("b")))
    return (
        inner.select(*keys, F.inline(both))
        .groupBy(*keys, "id")
        .agg(F.array_sort(F.collect_set("d")).alias("depends_on"), F.array_sort(F.collect_set("b")).alias("depended_on_by"))
    )


def hubs(edges: DataFrame, least: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """File nodes with an in-degree of at least ``least``."""
    return degrees(edges, keys).filter((F.col("in_degree") >= least) & ~F.col("id").startswith("external:")).select(*keys, "id", F.col("in_degree").alias("fan_in"))


def hotspots(edges: DataFrame, k: int = 12) -> DataFrame:
    """Top ``k`` nodes by degree, ties by id (top-k, no full sort)."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def resolve(imports: DataFrame, files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What each import means: (keys..., src, specifier, kind, target).

    ``imports`` has (keys..., src, specifier), ``files`` (keys..., path). Candidates in order join the known paths; the
    first hit holds. A relative or rooted specifier without a hit is ``unresolved``, any other is ``external`` (its package).
    """
    each = imports.select(*keys, "src", "specifier").distinct().withColumn("bases", P.specifier_bases("src", "specifier"))
    ranked = each.select(*keys, "src", "specifier", F.posexplode(F.flatten(F.transform("bases", P.candidates))).alias("rank", "target"))
    known = files.select(*keys, F.col("path").alias("target")).distinct()
    hit = ranked.join(known, [*keys, "target"]).groupBy(*keys, "src", "specifier").agg(F.min_by("target", "rank").alias("target"))
    s = F.col("specifier")
    inner = s.startswith(".") | s.startswith("/")
    kind = F.when(F.col("target").isNotNull(), "internal").when(inner, "unresolved").otherwise("external")
    out = each.select(*keys, "src", "specifier").join(hit, [*keys, "src", "specifier"], "left").withColumn("kind", kind)
    return out.withColumn("target", F.when(F.col("kind") == "external", F.concat(F.lit("external:"), P.package_root("specifier"))).otherwise(F.col("target")))


def build_graph(files: DataFrame, keys: Sequence[str] = (), sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) out of parsed files: (keys..., path, imports[source, specifiers, isTypeOnly, isDynamic], exports[name, type, isTypeOnly, source]).

    With ``sources`` (keys..., path) only these files' edges are built; all files are what imports may mean.
    """
    own = files if sources is None else files.join(sources.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")
    imp = own.select(*keys, F.col("path").alias("src"), F.explode("imports").alias("i")).select(
        *keys, "src", F.col("i.source").alias("specifier"),
        F.when(F.col("i.isDynamic"), "dynamic-import").when(F.col("i.isTypeOnly"), "type-import").otherwise("import").alias("type"),
        F.col("i.isTypeOnly").alias("is_type_only"), F.size("i.specifiers").alias("specifier_count"),
    )
    exp = own.select(*keys, F.col("path").alias("src"), F.explode("exports").alias("e")).filter("e.source IS NOT NULL")
    exp = exp.groupBy(*keys, "src", F.col("e.source").alias("specifier"), F.col("e.isTypeOnly").alias("is_type_only")).agg(F.count(F.lit(1)).cast("int").alias("specifier_count")).withColumn("type", F.lit("re-export"))
    raw = imp.unionByName(exp)
    target = resolve(raw, files, keys).filter("kind <> 'unresolved'")
    edges = raw.join(target, [*keys, "src", "specifier"]).withColumnRenamed("target", "dst").withColumn("is_external", F.col("kind") == "external")
    merged = merge_edges(edges, None, keys)
    nodes = files.select(*keys, F.col("path").alias("id"), F.lit("file").alias("kind")).unionByName(merged.filter("is_external").select(*keys, F.col("dst").alias("id"), F.lit("external").alias("kind"))).distinct()
    return nodes, merged


def repair(edges: DataFrame, rebuilt: DataFrame, dirty: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges after a change: sources in ``dirty`` (keys..., id) come from ``rebuilt``, others stay if their target does."""
    d = dirty.select(*keys, F.col("id").alias("src")).distinct()
    kept = edges.join(d, [*keys, "src"], "left_anti").join(nodes.select(*keys, F.col("id").alias("dst")).distinct(), [*keys, "dst"], "left_semi")
    return kept.unionByName(rebuilt.join(d, [*keys, "src"], "left_semi"))


def module_boundaries(files: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., module, files, internal, cross, external): sorted sets, as dependencies leave or stay in a module."""
    own = files.select(*keys, P.module_of("path").alias("module"), F.lit("f").alias("k"), F.col("path").alias("v"))
    src, dst = P.module_of("src"), P.module_of("dst")
    out = F.col("dst").startswith("external:")
    dep = edges.select(
        *keys, src.alias("module"), F.when(out, "x").when(src == dst, "i").otherwise("c").alias("k"),
        F.when(out, F.expr("substring(dst, 10)")).when(src == dst, F.col("dst")).otherwise(F.concat(dst, F.lit(":"), "dst")).alias("v"),
    )
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("v"))))
    both = own.unionByName(dep).distinct()
    return both.groupBy(*keys, "module").agg(pick("f").alias("files"), pick("i").alias("internal"), pick("c").alias("cross"), pick("x").alias("external"))


def module_count(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct parent directories; the top level counts as one."""
    folder = P.dirname("path")
    return files.select(*keys, F.when(folder == "", "_root").otherwise(folder).alias("d")).groupBy(*keys).agg(F.count_distinct("d").alias("n_modules"))


def union_edges(*parts: DataFrame) -> DataFrame:
    """Adjacency of several generations of a graph, each edge once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two tables hold the same keys (structure unchanged)."""
    return a.select(*keys).exceptAll(b.select(*keys).distinct()).isEmpty() and b.select(*keys).distinct().exceptAll(a.select(*keys).distinct()).isEmpty()
