"""Entities, domains, capabilities, profile and the semantic graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.operators import graph as G
from strataforge.rules import CAPABILITIES, NO_DOMAINS, PURPOSES, ROLE_NAMES, ROLE_PATHS


def _any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def role(path: Column | str, n_imports: Column | None = None, n_exports: Column | None = None) -> Column:
    """Architecture role by ordered rules on the path, then on the name."""
    lower, name = F.lower(F.col(path) if isinstance(path, str) else path), F.lower(P.basename(path))
    many = F.coalesce((n_imports > 3) & (n_exports > 3), F.lit(False)) if n_imports is not None else F.lit(False)
    entry = name.isin("index.ts", "index.js", "main.ts", "main.js")
    out = (
        F.when(_any(name, (".test.", ".spec.")) | lower.contains("__tests__"), "test")
        .when(entry & many, "barrel")
        .when(entry, "entry-point")
        .when(name.endswith(".d.ts") | _any(name, (".types.", ".interface.")), "type-definition")
        .when(_any(name, ("config", ".rc.")), "config")
    )
    for r, parts in ROLE_PATHS:
        out = out.when(_any(lower, parts), r)
    for r, parts in ROLE_NAMES:
        out = out.when(_any(name, parts), r)
    return out.otherwise("unknown")


def purpose(path: Column | str, role_: Column) -> Column:
    name = F.regexp_replace(P.basename(path), r"\.[^.]+$", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for r, text in PURPOSES.items():
        out = out.when(role_ == r, F.concat(F.lit(text.replace("{}", "")), name))
    return out


def importance(files: DataFrame, edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., path, in_degree, out_degree, importance). Nodes of every kind count; a file without a node has 0.1."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    deg = nodes.select(*keys, "id").join(G.degrees(edges, keys), [*keys, "id"], "left").na.fill(0, ["in_degree", "out_degree"])
    base = F.greatest(F.lit(1.0), F.col("n_nodes") * 0.1)
    part = lambda c: F.least(F.lit(1.0), F.col(c) / base)
    value = F.when(F.col("in_degree").isNull(), 0.1).when(F.col("n_nodes") <= 1, 0.5).otherwise(F.least(F.lit(1.0), part("in_degree") * 0.7 + part("out_degree") * 0.3))
    out = files.select(*keys, "path").join(deg.withColumnRenamed("id", "path"), [*keys, "path"], "left")
    out = out.join(n, list(keys), "left")
    return out.select(*keys, "path", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), value.alias("importance"))


def criticality(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def health_score(complexity: Column, importance_: Column) -> Column:
    raw = 1 - F.least(F.lit(1.0), complexity / 50) * (0.5 + importance_ * 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def entities(files: DataFrame, edges: DataFrame, nodes: DataFrame, layers: DataFrame, risks: DataFrame | None = None, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """One row per file: id, path, name, role, purpose, layer, importance, criticality, complexity, health, risks, depends_on, depended_on_by."""
    imp = importance(files, edges, nodes, keys)
    near = G.file_neighbours(edges, keys).withColumnRenamed("id", "path")
    lay = layers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_layers"))
    out = files.select(*keys, "path", "complexity").join(imp, [*keys, "path"]).join(near, [*keys, "path"], "left")
    out = out.join(lay, list(keys), "left")
    none = F.array().cast("array<string>")
    inside = F.filter(F.coalesce("_layers", F.array().cast("array<struct<rank:int,name:string>>")), lambda l: F.contains(F.lower("path"), F.concat(F.lit("/"), F.lower(l["name"]), F.lit("/"))))
    out = out.withColumn("role", role("path"))
    if risks is not None:
        ids = risks.select(*keys, "id", F.explode("affected").alias("path")).groupBy(*keys, "path").agg(F.array_sort(F.collect_set("id")).alias("risks"))
        out = out.join(ids, [*keys, "path"], "left")
    else:
        out = out.withColumn("risks", none)
    prefix = lambda c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit("file:"), x))
    return out.select(
        *keys, F.concat(F.lit("file:"), "path").alias("id"), "path", P.basename("path").alias("name"), "role", purpose("path", F.col("role")).alias("purpose"),
        F.try_element_at(inside, F.lit(1))["name"].alias("layer"), "importance", criticality(F.col("importance")).alias("criticality"), "complexity",
        health_score(F.col("complexity"), F.col("importance")).alias("health"), F.coalesce("risks", none).alias("risks"), prefix("depends_on").alias("depends_on"), prefix("depended_on_by").alias("depended_on_by"),
    )


def domain_of(path: Column | str) -> Column:
    """Top-level directory; null for the root and for infrastructure."""
    p = P.normalise(path)
    top = F.split_part(p, F.lit("/"), F.lit(1))
    return F.when(p.contains("/") & ~F.lower(top).isin(*NO_DOMAINS), top)


def domains(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., id, name, file_count, lines_of_code, languages, confidence) of top-level directories with two files or more."""
    return (
        files.withColumn("d", domain_of("path"))
        .filter("d IS NOT NULL")
        .groupBy(*keys, "d")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("lines_of_code").alias("lines_of_code"), F.array_sort(F.collect_set("language")).alias("languages"))
        .filter("file_count >= 2")
        .select(*keys, F.concat(F.lit("domain:"), "d").alias("id"), P.humanise("d").alias("name"), "file_count", "lines_of_code", "languages", F.lit(0.6).alias("confidence"))
    )


def domain_edges(files: DataFrame, edges: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., src_domain, dst_domain): distinct dependencies between different domains."""
    held = domains(files, keys).select(*keys, F.expr("substring(id, 8)").alias("d"))
    place = files.select(*keys, "path", domain_of("path").alias("d")).join(held, [*keys, "d"], "left_semi").distinct()
    a = place.select(*keys, F.col("path").alias("src"), F.concat(F.lit("domain:"), "d").alias("src_domain"))
    b = place.select(*keys, F.col("path").alias("dst"), F.concat(F.lit("domain:"), "d").alias("dst_domain"))
    return edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).filter("src_domain <> dst_domain").select(*keys, "src_domain", "dst_domain").distinct()


def capabilities(files: DataFrame, frameworks: DataFrame | None = None, imports: DataFrame | None = None, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., id, name, category, n_evidence, confidence, implemented_by).

    ``frameworks`` (keys..., name), ``imports`` (keys..., path, source). Evidence: paths that match, imports, frameworks.
    """
    named = [F.when(F.col("path").rlike(f"(?i){rx}"), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit("naming").alias("kind"), P.basename("path").alias("indicator"))) for n, c, _, _, rx in CAPABILITIES if rx]
    parts = [files.select(*keys, F.col("path").alias("location"), F.inline(F.filter(F.array(*named), lambda x: x.isNotNull())))]
    if imports is not None:
        hit = [F.when(F.col("source").contains(m), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit("import").alias("kind"), F.lit(m).alias("indicator"))) for n, c, _, ms, _ in CAPABILITIES for m in ms]
        parts.append(imports.select(*keys, F.col("path").alias("location"), F.inline(F.filter(F.array(*hit), lambda x: x.isNotNull()))))
    if frameworks is not None:
        hit = [F.when(F.lower("name").contains(m), F.struct(F.lit(n).alias("cap"), F.lit(c).alias("category"), F.lit(m).alias("m"))) for n, c, ms, _, _ in CAPABILITIES for m in ms]
        fw = frameworks.select(*keys, F.col("name").alias("indicator"), F.inline(F.filter(F.array(*hit), lambda x: x.isNotNull())))
        parts.append(fw.select(*keys, F.lit("package.json").alias("location"), F.col("cap").alias("name"), "category", F.lit("framework").alias("kind"), "indicator"))
        if imports is not None:
            on = [*[fw[k] == imports[k] for k in keys], imports["source"].contains(fw["m"])]
            parts.append(fw.join(imports, reduce(lambda a, b: a & b, on)).select(*[fw[k] for k in keys], imports["path"].alias("location"), fw["cap"].alias("name"), fw["category"], F.lit("framework").alias("kind"), fw["indicator"]))
    evidence = reduce(DataFrame.unionByName, parts).distinct()
    place = F.when(F.col("location") != "package.json", F.concat(F.lit("file:"), "location"))
    out = evidence.groupBy(*keys, "name", "category").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_set(place)).alias("implemented_by"))
    return out.select(
        *keys, F.concat(F.lit("capability:"), F.regexp_replace(F.lower("name"), r"\s+", "-")).alias("id"), "name", "category", "n_evidence", F.least(F.lit(1.0), F.col("n_evidence") * 0.3).alias("confidence"), "implemented_by"
    )


def size_class(n: Column) -> Column:
    return F.when(n < 20, "tiny").when(n < 100, "small").when(n < 500, "medium").when(n < 5000, "large").otherwise("massive")


def language_distribution(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., language, file_count, percentage to two places) of files with a known language."""
    counts = files.filter("language IS NOT NULL").groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("file_count"))
    return _share(counts, "file_count", keys, 100)


def language_breakdown(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., language, lines_of_code, percentage to one place)."""
    counts = files.filter("language IS NOT NULL").groupBy(*keys, "language").agg(F.sum("lines_of_code").alias("lines_of_code"))
    return _share(counts, "lines_of_code", keys, 10)


def _share(counts: DataFrame, column: str, keys: Sequence[str], places: int) -> DataFrame:
    """Counts are few rows (one per group and language), so a window over them is cheap."""
    from pyspark.sql import Window

    total = F.sum(column).over(Window.partitionBy(*keys))
    return counts.withColumn("percentage", F.when(total == 0, 0.0).otherwise(F.floor(F.col(column) / total * 100 * places + 0.5) / places))


def profile(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    lang = language_breakdown(files, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("lines_of_code")).alias("o"), "language"))), lambda x: x["language"]).alias("languages"))
    base = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_files"), F.sum("lines_of_code").alias("total_lines"))
    out = base.join(lang, list(keys), "left")
    return out.select(*keys, "total_files", "total_lines", size_class(F.col("total_files")).alias("repository_size"), "languages")


def semantic_graph(ents: DataFrame, doms: DataFrame, caps: DataFrame, layers: DataFrame, files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> tuple[DataFrame, DataFrame]:
    """(nodes: keys..., id, kind, label, weight; edges: keys..., src, dst, kind, weight, confidence); the first edge of a pair wins."""
    from pyspark.sql import Window

    total = F.sum("file_count").over(Window.partitionBy(*keys))
    nodes = (
        doms.select(*keys, "id", F.lit("domain").alias("kind"), F.col("name").alias("label"), (F.col("file_count") / F.greatest(F.lit(1), total)).alias("weight"))
        .unionByName(layers.select(*keys, F.concat(F.lit("layer:"), "name").alias("id"), F.lit("layer").alias("kind"), F.col("name").alias("label"), F.lit(0.5).alias("weight")))
        .unionByName(caps.select(*keys, "id", F.lit("capability").alias("kind"), F.col("name").alias("label"), F.col("confidence").alias("weight")))
        .unionByName(ents.select(*keys, "id", F.lit("entity").alias("kind"), F.col("name").alias("label"), F.col("importance").alias("weight")))
    )
    member = files.select(*keys, F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("domain:"), domain_of("path")).alias("dst")).filter("dst IS NOT NULL")
    f = lambda df, kind, w, c, r: df.select(*keys, "src", "dst", F.lit(kind).alias("kind"), w.cast("double").alias("weight"), c.cast("double").alias("confidence"), F.lit(r).alias("rank"))
    edges = (
        f(member.join(doms.select(*keys, F.col("id").alias("dst")), [*keys, "dst"], "left_semi"), "belongs-to", F.lit(1), F.lit(0.6), 1)
        .unionByName(f(ents.filter("layer IS NOT NULL").select(*keys, F.col("id").alias("src"), F.concat(F.lit("layer:"), "layer").alias("dst")), "belongs-to", F.lit(1), F.lit(0.8), 2))
        .unionByName(f(caps.select(*keys, F.explode("implemented_by").alias("src"), F.col("id").alias("dst"), "confidence"), "serves", F.col("confidence"), F.col("confidence"), 3))
        .unionByName(f(ents.select(*keys, F.col("id").alias("src"), F.explode("depends_on").alias("dst")), "depends-on", F.lit(0.5), F.lit(0.9), 4))
    )
    first = edges.groupBy(*keys, "src", "dst").agg(F.min(F.struct("rank", "kind", "weight", "confidence")).alias("e")).select(*keys, "src", "dst", "e.kind", "e.weight", "e.confidence")
    ids = nodes.select(*keys, "id")
    for end in ("src", "dst"):
        first = first.join(ids.withColumnRenamed("id", end), [*keys, end], "left_semi")
    return nodes, first


def semantic_slice(nodes: DataFrame, edges: DataFrame, n_nodes: int = 100, n_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """The heaviest ``n_nodes`` nodes (ties by label, id) and the first ``n_edges`` edges inside them: a bounded view of one graph."""
    top = nodes.orderBy(F.desc("weight"), "label", "id").limit(n_nodes)
    ids = top.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return top, inside.orderBy("src", "dst").limit(n_edges)
