"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.operators import cycles as C
from strataforge.operators import graph as G
from strataforge.operators import impact as IM
from strataforge.operators import traverse as T
from strataforge.plans import inputs as I
from strataforge.plans.inputs import BASE
from strataforge.rules import RESOLVE_EXTENSIONS
from strataforge.runtime import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_edges(I.raw_edges(spark, d).unionByName(I.external_edges(spark, d)))


REACHED = ("target", "id", "depth")
_MODULE_SQL = "CASE WHEN regexp_extract({0}, '^((?:packages|apps)/[^/]+)', 1) <> '' THEN regexp_extract({0}, '^((?:packages|apps)/[^/]+)', 1) WHEN split_part({0}, '/', 1) <> '' AND NOT contains(split_part({0}, '/', 1), '.') THEN split_part({0}, '/', 1) ELSE 'root' END"

QUERIES = {
    "edge_merge": _edges,
    "node_degrees": lambda s, d: G.degrees(_edges(s, d)),
    "nodes_by_kind": lambda s, d: G.kind_counts(G.nodes_of(_edges(s, d))),
    "edges_by_type": lambda s, d: G.type_counts(_edges(s, d)),
    "neighbours_out": lambda s, d: G.neighbours(_edges(s, d), "part-1"),
    "neighbours_in": lambda s, d: G.neighbours(_edges(s, d), "part-1", "dependents"),
    "dependency_hubs": lambda s, d: G.hubs(_edges(s, d)),
    "hotspots_top12": lambda s, d: G.hotspots(_edges(s, d)),
    "file_neighbours": lambda s, d: G.file_neighbours(I.repo_edges(s, d), ["repo_id"]),
    "module_boundaries": lambda s, d: G.module_boundaries(I.repo_files(s, d), I.repo_edges(s, d), ["repo_id"]),
    "module_count": lambda s, d: G.module_count(I.repo_files(s, d), ["repo_id"]),
    "union_generations": lambda s, d: G.union_edges(_generation(s, d, None, "1999-01-01"), _generation(s, d, "1997-01-01", None)).groupBy().agg(F.count(F.lit(1)).alias("n_edges")),
    "graph_repair": lambda s, d: _repair(s, d),
    "resolve_specifiers": lambda s, d: _resolve(s, d),
    "reach_depth_batch": lambda s, d: T.traverse(I.repo_edges(s, d).select(_key("src").alias("src"), _key("dst").alias("dst")), _targets(s, d), "dependents", 8, None, _repo, REACHED).nodes.select("target", "id", "depth"),
    "reach_dependencies": lambda s, d: T.traverse(I.repo_edges(s, d).select(_key("src").alias("src"), _key("dst").alias("dst")), _targets(s, d), "dependencies", 3, None, _repo, REACHED).nodes.select("target", "id", "depth"),
    "reach_dependencies_whole": lambda s, d: _dependencies(s, d).nodes.select("target", "id", "depth"),
    "reach_dependencies_truncations": lambda s, d: _dependencies(s, d).truncations,
    "canonical_paths": lambda s, d: T.canonical_paths(T.traverse(I.repo_edges(s, d).select(_key("src").alias("src"), _key("dst").alias("dst")), _targets(s, d), part=_repo), 3),
    "dirty_closure": lambda s, d: T.dirty_closure(_generation(s, d, None, "1993-01-01"), _generation(s, d, "1998-10-01", None), table(s, d, "supplier").filter("s_suppkey <= 3").select(F.concat(F.lit("part-"), "s_suppkey").alias("id"))),
    "dirty_closure_whole": lambda s, d: T.dirty_closure(_generation(s, d, None, "1998-01-01"), _generation(s, d, "1998-01-01", None), _changed(s, d)),
    "circular_dependencies": lambda s, d: C.cycles(_generation(s, d, None, None)),
    "repo_cycles": lambda s, d: C.cycles(_folders(s, d), ["repo_id"]),
    "repo_cycle_checks": lambda s, d: C.checks(C.cycles(_folders(s, d), ["repo_id"]), _folders(s, d), ["repo_id"]),
    "path_relationships": lambda s, d: _path_relationships(s, d),
    "graph_components": lambda s, d: C.components(I.repo_edges(s, d).select(_key("src").alias("src"), _key("dst").alias("dst"))),
}


def _key(c: str) -> F.Column:
    return F.concat_ws("|", F.col("repo_id").cast("string"), F.col(c))


def _repo(c: F.Column) -> F.Column:
    """Repository of a keyed id; no edge leaves it."""
    return F.substring_index(c, "|", 1)


def _targets(s: SparkSession, d: str) -> DataFrame:
    """Every file that something depends on."""
    return I.repo_edges(s, d).select(_key("dst").alias("target")).distinct()


def _dependencies(s: SparkSession, d: str) -> T.Traversal:
    """All that the targets reach, down to the operator's hard bound; its truncations tell of targets that reach further."""
    edges = I.repo_edges(s, d).select(_key("src").alias("src"), _key("dst").alias("dst"))
    return T.traverse(edges, _targets(s, d), "dependencies", T.HARD_DEPTH, None, _repo, REACHED)


def _changed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").filter("s_suppkey <= 3").select(F.concat(F.lit("part-"), "s_suppkey").alias("id"))


def _generation(s: SparkSession, d: str, since: str | None, before: str | None) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(s, d, "lineitem").select("l_partkey", "l_shipdate", F.lead("l_partkey").over(w).alias("to")).filter("to IS NOT NULL")
    if since:
        li = li.filter(F.col("l_shipdate") >= since)
    if before:
        li = li.filter(F.col("l_shipdate") < before)
    part = lambda c: F.concat(F.lit("part-"), F.col(c))
    return li.select(part("l_partkey").alias("src"), part("to").alias("dst")).distinct()


def _folders(s: SparkSession, d: str) -> DataFrame:
    """Last folders of files that depend on each other; the files of the test tables hold no cycle, their folders' names do."""
    e = I.repo_edges(s, d).select("repo_id", P.basename(P.dirname("src")).alias("src"), P.basename(P.dirname("dst")).alias("dst"))
    return e.filter("src <> dst").distinct()


def _path_relationships(s: SparkSession, d: str) -> DataFrame:
    """Relationships along the first paths in two generations of the part graph."""
    raw = I.raw_edges(s, d)
    both = [raw.filter("is_type_only"), raw.filter("NOT is_type_only")]
    t = T.traverse(raw.select("src", "dst").distinct(), s.createDataFrame([("part-1",), ("part-2",)], "target string"), max_depth=3)
    return IM.path_relationships(T.canonical_paths(t, 3), T.relationships(both, "dependents"))


def _repair(s: SparkSession, d: str) -> DataFrame:
    old, new = _generation(s, d, None, "1997-01-01"), _generation(s, d, "1996-01-01", None)
    nodes = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    dirty = nodes.filter(F.col("id").endswith("7"))
    return G.repair(old, new, dirty, nodes)


def _resolve(s: SparkSession, d: str) -> DataFrame:
    """Relative imports between neighbouring files, an alias and a package for each file with an edge."""
    e = I.repo_edges(s, d)
    depth = F.size(F.split("src", "/")) - 1
    up = F.concat(F.when(depth == 0, "./").otherwise(F.repeat(F.lit("../"), depth)), F.regexp_replace("dst", r"\.[^./]+$", ""))
    own = e.select("repo_id", "src", F.explode(F.array(up, F.concat(F.lit("./"), P.basename("dst")), F.lit("@/missing/thing"), F.lit("@scope/pkg/deep"), F.lit("lodash/fp"), F.lit("node:fs"))).alias("specifier"))
    return G.resolve(own, I.repo_files(s, d).select("repo_id", "path"), ["repo_id"])


_GEN = """gen AS (SELECT DISTINCT 'part-' || l_partkey AS src, 'part-' || nxt AS dst, l_shipdate FROM (
  SELECT l_partkey, l_shipdate, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"""


def _reach(direction: str, depth: int) -> str:
    at, nxt = ("dst", "src") if direction == "dependents" else ("src", "dst")
    body = BASE.replace("WITH held_manifest", "WITH RECURSIVE held_manifest", 1)
    return f"""{body}, keyed AS (SELECT repo_id || '|' || src AS src, repo_id || '|' || dst AS dst FROM repo_edges WHERE src <> dst),
    walk AS (SELECT DISTINCT repo_id || '|' || dst AS target, repo_id || '|' || dst AS id, 0 AS depth FROM repo_edges
      UNION SELECT w.target, k.{nxt} AS id, w.depth + 1 AS depth FROM walk w JOIN keyed k ON w.id = k.{at} WHERE w.depth < {depth})
    SELECT target, id, min(depth) AS depth FROM walk GROUP BY target, id HAVING target <> id"""


_FOLDER = "regexp_replace({0}, '/?[^/]*$', '')"
_LAST = "regexp_extract(regexp_replace({0}, '/?[^/]*$', ''), '([^/]*)$', 1)"
_CYCLES_SQL = BASE.replace("WITH held_manifest", "WITH RECURSIVE held_manifest", 1) + f""", f AS (SELECT DISTINCT repo_id, {_LAST.format("src")} AS a, {_LAST.format("dst")} AS b FROM repo_edges WHERE {_LAST.format("src")} <> {_LAST.format("dst")}),
    reach AS (SELECT repo_id, a, b FROM f UNION SELECT r.repo_id, r.a, f.b FROM reach r JOIN f ON f.repo_id = r.repo_id AND f.a = r.b)
    SELECT repo_id, bool_or(a = b) AS cyclic, 0 AS n_broken, 0 AS n_repeated FROM reach GROUP BY repo_id"""
_STEMS = lambda stem, ends: ", ".join(f"{stem} || '{e}'" for e in ends)
_RESOLVE_SQL = (
    BASE
    + f""", spec AS (SELECT DISTINCT repo_id, src, specifier, base FROM (
      SELECT repo_id, src, CASE WHEN len(string_split(src, '/')) = 1 THEN './' ELSE repeat('../', len(string_split(src, '/')) - 1) END || regexp_replace(dst, '\\.[^./]+$', '') AS specifier, regexp_replace(dst, '\\.[^./]+$', '') AS base FROM repo_edges
      UNION ALL SELECT repo_id, src, './' || regexp_extract(dst, '([^/]*)$', 1), ltrim({_FOLDER.format("src")} || '/' || regexp_extract(dst, '([^/]*)$', 1), '/') FROM repo_edges)),
    cand AS (SELECT repo_id, src, specifier, unnest(c) AS target, generate_subscripts(c, 1) AS rank FROM (SELECT *, CASE WHEN regexp_matches(regexp_extract(base, '([^/]*)$', 1), '.\\.[^.]+$')
      THEN [base, {_STEMS("regexp_replace(base, '\\.[^./]+$', '')", RESOLVE_EXTENSIONS)}] ELSE [base, {_STEMS("base", [x for e in RESOLVE_EXTENSIONS for x in (e, f"/index{e}")])}] END AS c FROM spec)),
    hit AS (SELECT c.repo_id, c.src, c.specifier, arg_min(c.target, c.rank) AS target FROM cand c SEMI JOIN repo_files f ON f.repo_id = c.repo_id AND f.path = c.target GROUP BY ALL)
    SELECT s.repo_id, s.src, s.specifier, CASE WHEN h.target IS NULL THEN 'unresolved' ELSE 'internal' END AS kind, h.target FROM (SELECT DISTINCT repo_id, src, specifier FROM spec) s LEFT JOIN hit h USING (repo_id, src, specifier)
    UNION ALL SELECT DISTINCT repo_id, src, x.specifier, 'external', x.target FROM repo_edges, (VALUES ('@/missing/thing', 'external:@'), ('@scope/pkg/deep', 'external:@scope/pkg'), ('lodash/fp', 'external:lodash'), ('node:fs', 'external:node:fs')) x(specifier, target)"""
)
_PART_LEVELS = "".join(
    f", p{k} AS (SELECT target, id, min(q) AS p, {k} AS depth FROM (SELECT l.target, e.src AS id, list_append(l.p, e.src) AS q FROM p{k - 1} l JOIN pe e ON e.dst = l.id) c WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT target, id FROM p{j}' for j in range(k))}) o WHERE o.target = c.target AND o.id = c.id) GROUP BY target, id)"
    for k in (1, 2, 3)
)
_PATHS_SQL = (
    BASE
    + ", pe AS (SELECT DISTINCT src, dst FROM raw_edges WHERE src <> dst), p0 AS (SELECT unnest(['part-1', 'part-2']) AS target, target AS id, [target] AS p, 0 AS depth)"
    + _PART_LEVELS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, p) AS place FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS n FROM ranked WHERE place <= 500),
    steps AS (SELECT target, id, unnest(range(1, len(p))) AS step, p FROM firsts WHERE n <= 3),
    rel AS (SELECT src, dst, min({'type': type, 'is_type_only': is_type_only, 'specifier_count': specifier_count}) AS r FROM raw_edges GROUP BY src, dst)
    SELECT s.target, s.id, CAST(s.step AS INTEGER) AS step, rel.src AS dependent, rel.dst AS dependency, r.type, r.is_type_only, r.specifier_count FROM steps s JOIN rel ON rel.dst = p[step] AND rel.src = p[step + 1]"""
)


def levels(n: int, targets: str = "SELECT DISTINCT repo_id || '|' || dst AS target FROM repo_edges") -> str:
    """Levels 1 to ``n`` of the dependents of all targets as SQL, with ``p``, the first of the shortest paths: the first predecessor in queue order
    is the one with the first path, since a level's order is that of its paths."""
    out = f"{BASE}, keyed AS MATERIALIZED (SELECT DISTINCT repo_id || '|' || src AS src, repo_id || '|' || dst AS dst FROM repo_edges WHERE src <> dst), l0 AS MATERIALIZED (SELECT target, target AS id, [target] AS p, 0 AS depth FROM ({targets})), s0 AS MATERIALIZED (SELECT target, id FROM l0)"
    for k in range(1, n + 1):
        out += f", l{k} AS MATERIALIZED (SELECT target, id, min(q) AS p, {k} AS depth FROM (SELECT l.target, k.src AS id, list_append(l.p, k.src) AS q FROM l{k - 1} l JOIN keyed k ON k.dst = l.id) c ANTI JOIN s{k - 1} s USING (target, id) GROUP BY target, id)"
        out += f", s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT target, id FROM l{k})"
    return out


def bounded(depth: int = 8, entities: int = 500) -> str:
    """``reached``: the first ``entities`` of each target's dependents down to ``depth``, in queue order; ``rest``: what comes next."""
    all_levels = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, depth + 1))
    return f"{levels(depth + 1)}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, p) AS place FROM ({all_levels})), reached AS MATERIALIZED (SELECT * FROM ranked WHERE place <= {entities}), rest AS (SELECT target, id FROM ranked WHERE place = {entities + 1})"


SQL = {
    "edge_merge": BASE + "SELECT * FROM edges",
    "node_degrees": BASE + "SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id",
    "nodes_by_kind": BASE + "SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN starts_with(id, 'external:') THEN 'external' ELSE 'file' END AS kind FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)) GROUP BY kind",
    "edges_by_type": BASE + "SELECT type, count(*) AS n FROM edges GROUP BY type",
    "neighbours_out": BASE + "SELECT DISTINCT dst AS id FROM edges WHERE src = 'part-1'",
    "neighbours_in": BASE + "SELECT DISTINCT src AS id FROM edges WHERE dst = 'part-1'",
    "dependency_hubs": BASE + "SELECT dst AS id, count(*) AS fan_in FROM edges WHERE NOT is_external GROUP BY dst HAVING count(*) >= 5",
    "hotspots_top12": BASE + "SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 12",
    "file_neighbours": BASE + "SELECT repo_id, id, list_sort(coalesce(list(DISTINCT d) FILTER (WHERE d IS NOT NULL), [])) AS depends_on, list_sort(coalesce(list(DISTINCT b) FILTER (WHERE b IS NOT NULL), [])) AS depended_on_by FROM (SELECT repo_id, src AS id, dst AS d, NULL AS b FROM repo_edges UNION ALL SELECT repo_id, dst, NULL, src FROM repo_edges) GROUP BY repo_id, id",
    "module_boundaries": BASE
    + f""", m AS (SELECT repo_id, {_MODULE_SQL.format("path")} AS module, 'f' AS k, path AS v FROM repo_files UNION
      SELECT repo_id, {_MODULE_SQL.format("src")}, CASE WHEN {_MODULE_SQL.format("src")} = {_MODULE_SQL.format("dst")} THEN 'i' ELSE 'c' END,
        CASE WHEN {_MODULE_SQL.format("src")} = {_MODULE_SQL.format("dst")} THEN dst ELSE {_MODULE_SQL.format("dst")} || ':' || dst END FROM repo_edges)
    SELECT repo_id, module, """
    + ", ".join(f"list_sort(coalesce(list(DISTINCT v) FILTER (WHERE k = '{k}'), [])) AS {n}" for k, n in (("f", "files"), ("i", "internal"), ("c", "cross"), ("x", "external")))
    + " FROM m GROUP BY repo_id, module",
    "module_count": BASE + "SELECT repo_id, count(DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '_root' END) AS n_modules FROM repo_files GROUP BY repo_id",
    "union_generations": f"WITH {_GEN} SELECT count(DISTINCT (src, dst)) AS n_edges FROM gen WHERE l_shipdate < DATE '1999-01-01' OR l_shipdate >= DATE '1997-01-01'",
    "graph_repair": f"""WITH {_GEN}, old AS (SELECT DISTINCT src, dst FROM gen WHERE l_shipdate < DATE '1997-01-01'), new AS (SELECT DISTINCT src, dst FROM gen WHERE l_shipdate >= DATE '1996-01-01'),
      nodes AS (SELECT src AS id FROM new UNION SELECT dst FROM new)
      SELECT src, dst FROM old WHERE NOT (src LIKE '%7' AND src IN (SELECT id FROM nodes)) AND dst IN (SELECT id FROM nodes) UNION ALL SELECT src, dst FROM new WHERE src LIKE '%7'""",
    "reach_depth_batch": _reach("dependents", 8),
    "canonical_paths": bounded() + "SELECT target, id, depth, p AS path FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS n FROM reached) WHERE n <= 3",
    "resolve_specifiers": _RESOLVE_SQL,
    "repo_cycle_checks": _CYCLES_SQL,
    "path_relationships": _PATHS_SQL,
    "reach_dependencies": _reach("dependencies", 3),
    "reach_dependencies_whole": _reach("dependencies", T.HARD_DEPTH),
    "dirty_closure": f"""WITH RECURSIVE {_GEN}, adj AS (SELECT src, dst FROM gen WHERE l_shipdate < DATE '1993-01-01' OR l_shipdate >= DATE '1998-10-01'), both_ways AS (SELECT src, dst FROM adj UNION SELECT dst, src FROM adj),
      walk AS (SELECT 'part-' || s_suppkey AS id FROM supplier WHERE s_suppkey <= 3 UNION SELECT b.dst FROM walk w JOIN both_ways b ON w.id = b.src) SELECT id FROM walk""",
    "dirty_closure_whole": f"""WITH RECURSIVE {_GEN}, both_ways AS (SELECT src, dst FROM gen UNION SELECT dst, src FROM gen),
      walk AS (SELECT 'part-' || s_suppkey AS id FROM supplier WHERE s_suppkey <= 3 UNION SELECT b.dst FROM walk w JOIN both_ways b ON w.id = b.src) SELECT id FROM walk""",
    "graph_components": BASE.replace("WITH held_manifest", "WITH RECURSIVE held_manifest", 1)
    + """, keyed AS (SELECT repo_id || '|' || src AS a, repo_id || '|' || dst AS b FROM repo_edges WHERE src <> dst), both_ways AS (SELECT a, b FROM keyed UNION SELECT b, a FROM keyed),
      walk AS (SELECT DISTINCT a AS id, a AS seen FROM both_ways UNION SELECT w.id, k.b FROM walk w JOIN both_ways k ON w.seen = k.a) SELECT id, min(seen) AS component FROM walk GROUP BY id""",
}
