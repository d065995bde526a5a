"""Queries of architecture, knowledge, synthesis and scores over all repositories, and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.operators import architecture as A
from strataforge.operators import cycles as C
from strataforge.operators import graph as G
from strataforge.operators import impact as IM
from strataforge.operators import integrity as U
from strataforge.operators import intelligence as N
from strataforge.operators import knowledge as K
from strataforge.operators import synthesis as S
from strataforge.plans import graphs
from strataforge.plans import inputs as I
from strataforge.plans.inputs import BASE
from strataforge.rules import CAPABILITIES, DEFAULT_IGNORE, LAYERS, NO_DOMAINS, ROLE_NAMES, ROLE_PATHS, SIGNALS
from strataforge.runtime import table

KEYS = ["repo_id"]


class _Set:
    """Intermediate tables of one call."""

    def __init__(self, s: SparkSession, d: str):
        self.files, self.edges = I.repo_files(s, d), I.repo_edges(s, d)
        self.nodes = self.files.select("repo_id", F.col("path").alias("id"), F.lit("file").alias("kind"))
        self.layers = A.infer_layers(self.files, KEYS)
        self.exports = _exports(s, d)
        self.domains, self.capabilities = S.domains(self.files), S.capabilities(self.files)
        self.signals = A.signals(self.files, self.edges, KEYS)
        self.best = A.best_pattern(A.score_patterns(self.signals, KEYS), KEYS)

    @cached_property
    def risks(self) -> DataFrame:
        """Risks of the repositories' files; these have no exports, so no barrels."""
        imports = self.edges.groupBy("repo_id", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("n_imports"))
        cycles = K.cycle_risks(C.cycles(self.edges, KEYS), KEYS)
        return K.all_risks([K.high_complexity(self.files), K.large_file(self.files), K.excessive_imports(imports), K.orphan_files(self.files, self.edges), K.unstable_modules(self.edges), cycles])

    @cached_property
    def entities(self) -> DataFrame:
        return S.entities(self.files, self.edges, self.nodes, self.layers, self.risks)

    @cached_property
    def exposure(self) -> DataFrame:
        return N.risk_exposure(self.risks)

    @cached_property
    def health(self) -> DataFrame:
        arch = self.best.join(self.layers.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_layers")), "repo_id", "left").select("repo_id", "confidence", "n_layers")
        return N.health(self.entities, arch, self.exposure)


def _exports(s: SparkSession, d: str) -> DataFrame:
    """Part files with their edges as imports and exports: re-exports and imports of a source."""
    raw = I.raw_edges(s, d)
    kind = F.when(F.col("type") == "re-export", F.lit("re-export")).when(F.col("is_type_only"), F.lit("default")).otherwise(F.lit("named"))
    return raw.groupBy(F.lit(1).alias("repo_id"), F.col("src").alias("path")).agg(
        F.collect_list(F.struct(F.col("dst").alias("name"), kind.alias("type"))).alias("exports"),
        F.collect_list(F.struct(F.col("dst").alias("source"), (F.col("type") == "dynamic-import").alias("isDynamic"))).alias("imports"), F.count(F.lit(1)).alias("n_imports"),
    )


def _barrels(s: SparkSession, d: str) -> DataFrame:
    """Part files of which only re-exports are kept, so that barrels occur."""
    raw = I.raw_edges(s, d).filter("type = 're-export'")
    return raw.groupBy(F.lit(1).alias("repo_id"), F.col("src").alias("path")).agg(F.collect_list(F.struct(F.col("dst").alias("name"), F.col("type"))).alias("exports"))


def _with_tests(s: SparkSession, d: str) -> DataFrame:
    """The repositories' files, helpers and views taken for tests beside and apart from the source, since the tables hold no tests."""
    beside = F.regexp_replace("path", r"[-_]?[hH]elper(\.\w+)$", ".test$1")
    return I.repo_files(s, d).withColumn("path", F.when(F.col("path").rlike(r"[-_]?[vV]iew\.\w+$"), F.concat(F.lit("tests/"), "path")).otherwise(beside))


def _q(name: str):
    return lambda s, d: getattr(_Set(s, d), name)


def _impact(s: SparkSession, d: str) -> IM.Impact:
    key = lambda c: F.concat_ws("|", F.col("repo_id").cast("string"), F.col(c))
    cur = I.current(s, d, ("path", "depends_on", "belongs_to_domain", "belongs_to_layer", "importance", "criticality", "risks"))  # of edges too, so that one shuffle serves all
    e = I.edges_of(cur).select(key("src").alias("src"), key("dst").alias("dst"))
    domains = cur.filter("belongs_to_domain IS NOT NULL").select(F.concat_ws("|", F.col("repo_id").cast("string"), F.col("belongs_to_domain")).alias("id"), key("path").alias("member"))
    risks = cur.select(key("path").alias("member"), F.explode("risks").alias("r")).select(F.concat_ws("#", "member", "r").alias("id"), "member", F.when(F.col("r").contains("cycle") | F.col("r").contains("circular"), "high").otherwise("medium").alias("severity"))
    critical = cur.filter("criticality = 'critical'").select(F.concat(F.lit("critical:"), key("path")).alias("id"), key("path").alias("member"), F.col("importance").alias("score"))
    layers = cur.filter("belongs_to_layer IS NOT NULL").select(key("path").alias("member"), F.col("belongs_to_layer").alias("layer"))
    return IM.impact(e, e.select(F.col("dst").alias("target")).distinct(), domains=domains, critical=critical, risks=risks, layers=layers, part=graphs._repo)


def _identity(s: SparkSession, d: str, x: _Set) -> DataFrame:
    """Repositories with frameworks that their main language and package manager stand for."""
    r = table(s, d, "repository")
    own = {"typescript": ["React", "Vitest", "ESLint"], "javascript": ["Express", "Jest", "Webpack"], "python": ["Django"], "go": ["Turborepo", "Prisma"], "java": ["Playwright"]}
    named = F.array().cast("array<string>")
    for language, names in own.items():
        named = F.when(F.col("main_language") == language, F.array(*map(F.lit, names))).otherwise(named)
    managed = F.coalesce("package_manager", F.lit(""))
    rows = r.select(
        "repo_id", "root_path", named.alias("frameworks"), "package_manager", managed.isin("npm", "pnpm", "yarn", "bun").alias("has_package_json"), (F.col("repo_id") % 2 == 0).alias("has_readme"),
        F.when(F.col("total_files").isNotNull(), F.lit("1.0.0")).alias("version"),
    )
    return N.identity(rows, x.best, S.profile(x.files))


def _story(s: SparkSession, d: str) -> DataFrame:
    x = _Set(s, d)
    return N.story(_identity(s, d, x), S.profile(x.files), x.best, x.layers, x.domains, x.health, N.critical_components(x.entities), N.risk_assessment(x.risks), N.top_risks(x.risks))


def _notes(s: SparkSession, d: str) -> DataFrame:
    """Knowledge about files: the rows of each path in the manifest stand for its notes."""
    return table(s, d, "manifest").select("repo_id", P.normalise("relative_path").alias("path"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Targets by id, by a path to be normalised, by base name only, ambiguous and missing ones, of repository 1."""
    f = I.repo_files(s, d).filter("repo_id = 1").select("path").distinct()
    nodes = f.select(F.col("path").alias("id"), F.lit("file").alias("kind"), "path").unionByName(f.filter("path LIKE '%a%'").select(F.concat(F.lit("copy:"), "path").alias("id"), F.lit("file").alias("kind"), "path"))
    asked = f.select(F.explode(F.array(F.concat(F.lit("file:"), "path"), F.concat(F.lit("./"), F.regexp_replace("path", "/", "//")), F.concat(F.lit("no/"), "path"), F.concat(F.lit(".\\"), "path"))).alias("target"))
    return IM.resolve_ids(asked, nodes)


def _integrity(s: SparkSession, d: str) -> DataFrame:
    cur = I.current(s, d)
    refs = cur.select("repo_id", F.explode("depends_on").alias("entity_id"))
    return U.violations(
        [
            U.duplicates(table(s, d, "snapshots"), ["repo_id", "version"], "snapshot-id-unique"),
            U.dangling(refs, cur, ["repo_id", "entity_id"], "dependency-known"),
            U.dangling(cur, table(s, d, "repository"), ["repo_id"], "repository-known"),
            U.out_of_range(cur, ["repo_id", "entity_id"], "NOT (importance BETWEEN 0 AND 1) OR NOT (health_score BETWEEN 0 AND 1)", "score-range"),
        ]
    )


def _recovery(s: SparkSession, d: str) -> DataFrame:
    """Versions as records: entities, domains and layers that a version holds."""
    st = table(s, d, "entity_states")
    parts = [st.select("repo_id", "version", F.lit("entities").alias("namespace"), F.lit(True).alias("readable")), st.filter("belongs_to_domain IS NOT NULL").select("repo_id", "version", F.lit("domains").alias("namespace"), (F.col("importance") <= 1).alias("readable"))]
    return U.recovery_status(parts[0].unionByName(parts[1]).groupBy("repo_id", "version", "namespace").agg(F.bool_and("readable").alias("readable")), ["entities", "domains"])


QUERIES = {
    "language_distribution": lambda s, d: S.language_distribution(I.repo_files(s, d)),
    "language_breakdown_by_loc": lambda s, d: S.language_breakdown(I.repo_files(s, d)),
    "layer_inference": lambda s, d: _Set(s, d).layers,
    "directional_evidence": lambda s, d: A.directional_evidence(I.repo_edges(s, d), KEYS),
    "architecture_signals": _q("signals"),
    "pattern_scores": lambda s, d: A.score_patterns(_Set(s, d).signals, KEYS),
    "best_pattern": _q("best"),
    "service_topology": lambda s, d: A.service_topology(I.repo_files(s, d), KEYS),
    "naming_convention": lambda s, d: K.naming_convention(I.repo_files(s, d), KEYS, 3, 0.2),
    "source_root_convention": lambda s, d: K.source_root(I.repo_files(s, d), KEYS),
    "test_layout": lambda s, d: K.test_layout(_with_tests(s, d), KEYS),
    "export_style": lambda s, d: K.export_style(_exports(s, d), KEYS),
    "barrel_pattern": lambda s, d: K.barrel_pattern(_barrels(s, d), KEYS).select("repo_id", "file_count", "re_exports"),
    "dynamic_imports": lambda s, d: K.dynamic_imports(_exports(s, d), KEYS),
    "risk_high_complexity": lambda s, d: K.high_complexity(I.repo_files(s, d)),
    "risk_large_file": lambda s, d: K.large_file(I.repo_files(s, d)),
    "risk_excessive_imports": lambda s, d: K.excessive_imports(_exports(s, d)),
    "risk_orphan": lambda s, d: K.orphan_files(I.repo_files(s, d), I.repo_edges(s, d)),
    "risk_unstable": lambda s, d: K.unstable_modules(I.raw_edges(s, d).filter("type = 'import'").select(F.lit(1).alias("repo_id"), "src", "dst").distinct()),
    "risk_barrel": lambda s, d: K.barrel_explosion(_barrels(s, d)),
    "barrel_pattern_whole": lambda s, d: K.barrel_pattern(_exports(s, d), KEYS).select("repo_id", "file_count", "re_exports"),
    "risk_unstable_whole": lambda s, d: K.unstable_modules(I.raw_edges(s, d).select(F.lit(1).alias("repo_id"), "src", "dst").distinct()),
    "risk_barrel_whole": lambda s, d: K.barrel_explosion(_exports(s, d)),
    "all_risks": _q("risks"),
    "importance": lambda s, d: (lambda x: S.importance(x.files, x.edges, x.nodes).select("repo_id", "path", "in_degree", "out_degree", F.round("importance", 6).alias("importance")))(_Set(s, d)),
    "entity_roles": lambda s, d: I.repo_files(s, d).select("repo_id", "path", S.role("path").alias("role")),
    "entity_purposes": lambda s, d: I.repo_files(s, d).select("repo_id", "path", S.purpose("path", S.role("path")).alias("purpose")),
    "entities": lambda s, d: _Set(s, d).entities.withColumns({"importance": F.round("importance", 6), "health": F.round("health", 6)}).drop("purpose", "risks"),
    "entity_filter_page": lambda s, d: _Set(s, d).entities.filter("role = 'service' AND criticality = 'low'").select("repo_id", "path", "role").orderBy("repo_id", "path").offset(5).limit(20),
    "entity_by_id": lambda s, d: I.current(s, d).filter("entity_id LIKE 'file:src/generated/%'").select("repo_id", "entity_id", "complexity"),
    "domains": _q("domains"),
    "domain_dependencies": lambda s, d: S.domain_edges(I.repo_files(s, d), I.repo_edges(s, d)),
    "capabilities": _q("capabilities"),
    "profile": lambda s, d: S.profile(I.repo_files(s, d)),
    "semantic_nodes": lambda s, d: (lambda x: S.semantic_graph(x.entities, x.domains, x.capabilities, x.layers, x.files)[0].withColumn("weight", F.round("weight", 6)))(_Set(s, d)),
    "semantic_edges": lambda s, d: (lambda x: S.semantic_graph(x.entities, x.domains, x.capabilities, x.layers, x.files)[1].withColumns({"weight": F.round("weight", 6), "confidence": F.round("confidence", 6)}))(_Set(s, d)),
    "complexity_profile": lambda s, d: N.complexity_profile(_Set(s, d).entities),
    "risk_exposure": _q("exposure"),
    "risk_assessment": lambda s, d: N.risk_assessment(_Set(s, d).risks),
    "risks_by_category": lambda s, d: N.risks_by_category(_Set(s, d).risks),
    "top_risks": lambda s, d: N.top_risks(_Set(s, d).risks),
    "health": _q("health"),
    "critical_components": lambda s, d: N.critical_components(_Set(s, d).entities),
    "identity": lambda s, d: _identity(s, d, _Set(s, d)).withColumn("frameworks", F.transform("frameworks", lambda f: F.concat_ws(":", f["name"], f["category"]))),
    "story": lambda s, d: _story(s, d),
    "knowledge_health": lambda s, d: (lambda x: N.health(x.entities, x.best.select("repo_id", "confidence", F.lit(0).alias("n_layers")), x.exposure, _notes(s, d)))(_Set(s, d)),
    "ignore_filter": lambda s, d: I.held_manifest(s, d).select("repo_id", "path", P.ignored("path", [*DEFAULT_IGNORE, "src/*/data", "**/util/*.py"]).alias("ignored")),
    "path_normalise": lambda s, d: table(s, d, "manifest").select("file_id", "relative_path", P.normalise("relative_path").alias("path"), P.dirname(P.normalise("relative_path")).alias("dir"), P.extension("relative_path").alias("ext")).distinct(),
    "package_root": lambda s, d: table(s, d, "manifest").select(P.normalise("relative_path").alias("path")).distinct().select("path", P.package_root("path").alias("root"), P.module_of("path").alias("module")),
    "candidate_expansion": lambda s, d: I.repo_files(s, d).select("path", F.array_join(P.candidates("path"), ";").alias("candidates")).distinct(),
    "impact_batch": lambda s, d: _impact(s, d).scores.drop("boundary", "total"),
    "impact_scores": lambda s, d: _impact(s, d).scores,
    "impact_truncations": lambda s, d: _impact(s, d).truncations,
    "impact_components": lambda s, d: _impact(s, d).components.select("target", "kind", "raw", "contribution", "status"),
    "impact_effects": lambda s, d: _impact(s, d).effects,
    "impact_crossings": lambda s, d: _impact(s, d).crossings,
    "impact_targets": lambda s, d: _asked(s, d),
    "component_union": lambda s, d: IM.cumulative(_impact(s, d)),
    "integrity_violations": _integrity,
    "recovery_status": _recovery,
    "recovery_selection": lambda s, d: U.recovered(_recovery(s, d)),
}

# -- SQL ----------------------------------------------------------------------------------------------
_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_seg = lambda c: f"string_split(lower({c}), '/')"
_ROLE = "CASE " + " ".join(f"WHEN list_has_any({_seg('path')}, {_list(n)}) THEN '{r}'" for r, n in LAYERS) + " END"
_DIR = "CASE " + " ".join(
    f"WHEN list_has_any({_seg('path')}, {_list(n)}) THEN array_to_string(string_split(path, '/')[1:list_min(list_filter(list_transform({_list(n)}, lambda x: list_position({_seg('path')}, x)), lambda x: x > 0))], '/')" for _, n in LAYERS
) + " END"
_LAYERS = f""", layers AS (SELECT repo_id, role, upper(role[1:1]) || role[2:] AS name, list_position({_list(r for r, _ in LAYERS)}, role) AS rank, list_sort(list(DISTINCT directory)) AS directories, count(*) AS file_count
  FROM (SELECT repo_id, {_ROLE} AS role, {_DIR} AS directory FROM repo_files) WHERE role IS NOT NULL GROUP BY repo_id, role)"""
_DIRECTION = " UNION ALL ".join(
    f"SELECT repo_id, '{p}' AS pattern, '{r}' AS rule, {w}::DOUBLE AS weight, count(*) AS matches FROM repo_edges WHERE list_has_any({_seg('src')}, {_list(a)}) AND list_has_any({_seg('dst')}, {_list(b)}) GROUP BY repo_id" for p, r, w, a, b in SIGNALS if b
)
_AREA = "regexp_extract(lower(path), '^((?:.*?/)?(?:services|apps)/[^/]+)/', 1)"
_SIGNALS = (
    ", signals AS ("
    + " UNION ALL ".join(f"SELECT repo_id, '{p}' AS pattern, '{r}' AS rule, {w}::DOUBLE AS weight, count(*) AS matches FROM repo_files WHERE list_has_any({_seg('path')}, {_list(a)}) GROUP BY repo_id" for p, r, w, a, b in SIGNALS if not b)
    + f" UNION ALL {_DIRECTION} UNION ALL SELECT repo_id, 'microservice', 'microservice.services', CASE WHEN count(DISTINCT a) >= 3 THEN 0.62 ELSE 0.45 END::DOUBLE, count(*) FROM (SELECT repo_id, {_AREA} AS a FROM repo_files) WHERE a <> '' GROUP BY repo_id HAVING count(DISTINCT a) >= 2)"
)
_SCORES = ", scores AS (SELECT repo_id, pattern, least(0.98, floor(sum(weight) * 1000 + 0.5) / 1000)::DOUBLE AS confidence, list_sort(list(DISTINCT rule)) AS rules FROM signals GROUP BY repo_id, pattern)"
_BEST = """, best AS (SELECT repo_id, CASE WHEN confidence >= 0.35 THEN pattern ELSE 'unknown' END AS pattern, CASE WHEN confidence >= 0.35 THEN confidence ELSE 0 END::DOUBLE AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, list_position(['hexagonal','clean','ddd','mvc','microservice','layered'], pattern)) AS rn FROM scores) WHERE rn = 1)"""
_rid = lambda kind, expr: f"sha256('risk:{kind}:' || {expr})"
_HIGH = f"SELECT repo_id, {_rid('high-complexity', 'path')} AS id, 'high-complexity' AS type, CASE WHEN complexity >= 40 THEN 'critical' WHEN complexity >= 30 THEN 'high' ELSE 'medium' END AS severity, [path] AS affected, complexity::DOUBLE AS measured FROM repo_files WHERE complexity >= 20"
_LARGE = f"SELECT repo_id, {_rid('large-file', 'path')} AS id, 'large-file' AS type, CASE WHEN lines_of_code >= 1000 THEN 'high' ELSE 'medium' END AS severity, [path] AS affected, lines_of_code::DOUBLE AS measured FROM repo_files WHERE lines_of_code >= 500"
_ORPHAN = f"""SELECT repo_id, {_rid('orphan-file', 'path')} AS id, 'orphan-file' AS type, 'low' AS severity, [path] AS affected, NULL::DOUBLE AS measured FROM repo_files f
  WHERE NOT EXISTS (SELECT 1 FROM repo_edges e WHERE e.repo_id = f.repo_id AND (e.src = f.path OR e.dst = f.path)) AND (SELECT count(*) FROM repo_files g WHERE g.repo_id = f.repo_id) > 1"""


def _unstable(edges: str) -> str:
    return f"""SELECT repo_id, {_rid('unstable-module', 'id')} AS id, 'unstable-module' AS type, CASE WHEN o >= 15 THEN 'high' ELSE 'medium' END AS severity, [id] AS affected, floor(o / (i + o) * 1000 + 0.5) / 1000 AS measured FROM (
  SELECT repo_id, id, sum(i)::DOUBLE AS i, sum(o)::DOUBLE AS o FROM (SELECT repo_id, src AS id, 0 AS i, 1 AS o FROM {edges} UNION ALL SELECT repo_id, dst, 1, 0 FROM {edges}) GROUP BY repo_id, id) WHERE o >= 8 AND o / (i + o) >= 0.8"""


_RISKS = f", risks AS ({_HIGH} UNION ALL {_LARGE} UNION ALL {_ORPHAN} UNION ALL {_unstable('repo_edges')})"
_EXPORTS = """, exports AS (SELECT 1 AS repo_id, src AS path, dst, CASE WHEN type = 're-export' THEN 're-export' WHEN is_type_only THEN 'default' ELSE 'named' END AS kind, type FROM raw_edges)"""
_SRC_ROLE = (
    "CASE WHEN contains(name, '.test.') OR contains(name, '.spec.') OR contains(lp, '__tests__') THEN 'test' WHEN name IN ('index.ts', 'index.js', 'main.ts', 'main.js') THEN 'entry-point' "
    "WHEN ends_with(name, '.d.ts') OR contains(name, '.types.') OR contains(name, '.interface.') THEN 'type-definition' WHEN contains(name, 'config') OR contains(name, '.rc.') THEN 'config' "
    + " ".join("WHEN " + " OR ".join(f"contains(lp, '{p}')" for p in ps) + f" THEN '{r}'" for r, ps in ROLE_PATHS)
    + " "
    + " ".join("WHEN " + " OR ".join(f"contains(name, '{p}')" for p in ps) + f" THEN '{r}'" for r, ps in ROLE_NAMES)
    + " ELSE 'unknown' END"
)
_ROLES = f", roles AS (SELECT repo_id, path, {_SRC_ROLE} AS role FROM (SELECT repo_id, path, lower(path) AS lp, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM repo_files))"
_IMP = """, deg AS (SELECT repo_id, id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT repo_id, src AS id, 0 AS i, 1 AS o FROM repo_edges UNION ALL SELECT repo_id, dst, 1, 0 FROM repo_edges) GROUP BY repo_id, id),
cnt AS (SELECT repo_id, count(*) AS n FROM repo_files GROUP BY repo_id),
imp AS (SELECT f.repo_id, f.path, coalesce(d.i, 0) AS in_degree, coalesce(d.o, 0) AS out_degree, CASE WHEN c.n <= 1 THEN 0.5 ELSE least(1.0, least(1.0, coalesce(d.i, 0) / greatest(1.0, c.n * 0.1::DOUBLE)) * 0.7::DOUBLE + least(1.0, coalesce(d.o, 0) / greatest(1.0, c.n * 0.1::DOUBLE)) * 0.3::DOUBLE) END::DOUBLE AS importance
  FROM repo_files f JOIN cnt c USING (repo_id) LEFT JOIN deg d ON f.repo_id = d.repo_id AND f.path = d.id)"""
_crit = lambda c: f"CASE WHEN {c} >= 0.8 THEN 'critical' WHEN {c} >= 0.6 THEN 'high' WHEN {c} >= 0.3 THEN 'medium' ELSE 'low' END"
_ENT = f""", near AS (SELECT repo_id, id, list_sort(coalesce(list(DISTINCT d) FILTER (WHERE d IS NOT NULL), [])) AS dep, list_sort(coalesce(list(DISTINCT b) FILTER (WHERE b IS NOT NULL), [])) AS by FROM (SELECT repo_id, src AS id, 'file:' || dst AS d, NULL AS b FROM repo_edges UNION ALL SELECT repo_id, dst, NULL, 'file:' || src FROM repo_edges) GROUP BY repo_id, id),
ent AS (SELECT f.repo_id, 'file:' || f.path AS id, f.path, regexp_extract(f.path, '([^/]*)$', 1) AS name, r.role,
    (SELECT arg_min(l.name, l.rank) FROM layers l WHERE l.repo_id = f.repo_id AND contains(lower(f.path), '/' || lower(l.name) || '/')) AS layer,
    i.importance, {_crit('i.importance')} AS criticality, f.complexity, greatest(0.0, least(1.0, 1 - least(1.0, f.complexity / 50) * (0.5 + i.importance * 0.5)))::DOUBLE AS health, coalesce(n.dep, []) AS depends_on, coalesce(n.by, []) AS depended_on_by
  FROM repo_files f JOIN roles r ON f.repo_id = r.repo_id AND f.path = r.path JOIN imp i ON f.repo_id = i.repo_id AND f.path = i.path LEFT JOIN near n ON f.repo_id = n.repo_id AND f.path = n.id)"""
_TOP = f"CASE WHEN contains(path, '/') AND NOT list_contains({_list(NO_DOMAINS)}, lower(split_part(path, '/', 1))) THEN split_part(path, '/', 1) END"
_HUMAN = "array_to_string(list_transform(string_split(regexp_replace(regexp_replace(d, '[-_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_DOM = f""", dom AS (SELECT repo_id, 'domain:' || d AS id, {_HUMAN} AS name, count(*) AS file_count, sum(lines_of_code)::BIGINT AS lines_of_code, list_sort(coalesce(list(DISTINCT language) FILTER (WHERE language IS NOT NULL), [])) AS languages, 0.6::DOUBLE AS confidence
  FROM (SELECT *, {_TOP} AS d FROM repo_files) WHERE d IS NOT NULL GROUP BY repo_id, d HAVING count(*) >= 2)"""
_CAP = (
    ", evid AS ("
    + " UNION ".join(f"SELECT repo_id, '{n}' AS name, '{c}' AS category, path, regexp_extract(path, '([^/]*)$', 1) AS ind FROM repo_files WHERE regexp_matches(path, '(?i){rx}')" for n, c, _, _, rx in CAPABILITIES if rx)
    + "), cap AS (SELECT repo_id, 'capability:' || regexp_replace(lower(name), '\\s+', '-', 'g') AS id, name, category, count(*) AS n_evidence, least(1.0, count(*) * 0.3)::DOUBLE AS confidence, list_sort(list(DISTINCT 'file:' || path)) AS implemented_by FROM evid GROUP BY repo_id, name, category)"
)
_W = "CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 4 WHEN 'high' THEN 7 ELSE 10 END"
_EXPO = f"CAST(floor(100 * (1 - exp(-sum({_W} * greatest(1, len(affected))) / 25)) + 0.5) AS INTEGER)"
_ALL = BASE + _LAYERS + _SIGNALS + _SCORES + _BEST + _RISKS + _ROLES + _IMP + _ENT + _DOM + _CAP + f", expo AS (SELECT repo_id, {_EXPO} AS exposure FROM risks GROUP BY repo_id)"
_HEALTH = """, hl AS (SELECT e.repo_id, avg(len(depends_on)) AS ad, max(len(depends_on)) AS md, avg(complexity) AS ac, avg(CASE WHEN complexity > 20 THEN 1.0 ELSE 0 END) AS hc FROM ent e GROUP BY e.repo_id),
hd AS (SELECT h.repo_id, CAST(floor(least(100.0, coalesce(b.confidence, 0) * 70 + least(1.0, coalesce(l.n, 0) / 3) * 30) + 0.5) AS INTEGER) AS architecture,
  CAST(greatest(0, 100 - CASE WHEN ad > 15 THEN 30 WHEN ad > 10 THEN 20 WHEN ad > 5 THEN 10 ELSE 0 END - CASE WHEN md > 30 THEN 20 WHEN md > 20 THEN 10 ELSE 0 END) AS INTEGER) AS dependency,
  CAST(greatest(0, 100 - CASE WHEN ac > 20 THEN 40 WHEN ac > 10 THEN 20 WHEN ac > 5 THEN 5 ELSE 0 END - CASE WHEN hc > 0.3 THEN 30 WHEN hc > 0.1 THEN 15 ELSE 0 END) AS INTEGER) AS complexity,
  0 AS knowledge, CAST(100 - coalesce(x.exposure, 0) AS INTEGER) AS risk
  FROM hl h LEFT JOIN best b USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM layers GROUP BY repo_id) l USING (repo_id) LEFT JOIN expo x USING (repo_id)),
he AS (SELECT *, CAST(floor(architecture * 0.25::DOUBLE + dependency * 0.2::DOUBLE + complexity * 0.25::DOUBLE + knowledge * 0.15::DOUBLE + risk * 0.15::DOUBLE + 0.5) AS INTEGER) AS overall FROM hd)"""
_STYLE = "CASE WHEN lower(stem) IN ('', 'index', 'main') THEN NULL WHEN regexp_matches(stem, '^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(stem, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches(stem, '[A-Z]') THEN 'camelCase' WHEN regexp_matches(stem, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(stem, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$') THEN 'snake_case' END"
_SEM_NODES = """, sn AS (SELECT repo_id, id, 'domain' AS kind, name AS label, file_count / greatest(1, sum(file_count) OVER (PARTITION BY repo_id)) AS weight FROM dom UNION ALL
  SELECT repo_id, 'layer:' || name, 'layer', name, 0.5 FROM layers UNION ALL SELECT repo_id, id, 'capability', name, confidence FROM cap UNION ALL SELECT repo_id, id, 'entity', name, importance FROM ent)"""
_PERC = "CASE WHEN sum({0}) OVER (PARTITION BY repo_id) = 0 THEN 0.0 ELSE floor({0} / sum({0}) OVER (PARTITION BY repo_id) * 100 * {1} + 0.5) / {1} END::DOUBLE AS percentage"
_COMP = _ALL + """, bound AS (SELECT repo_id, greatest(max(len(depended_on_by)), 1) AS bi, greatest(max(len(depends_on)), 1) AS bo, greatest(max(complexity), 1) AS bc FROM ent GROUP BY repo_id),
crit AS (SELECT *, importance * 0.3::DOUBLE + fi * 0.25::DOUBLE + fo * 0.15::DOUBLE + fc * 0.2::DOUBLE + 0.05::DOUBLE AS score FROM (SELECT e.*, len(depended_on_by) / bi AS fi, len(depends_on) / bo AS fo, e.complexity / bc AS fc FROM ent e JOIN bound USING (repo_id)))"""
_IGNORED_NAMES = "|".join(P.glob_regex(x)[1][4:] for x in DEFAULT_IGNORE)

_IDENT = """, prof AS (SELECT f.repo_id, count(*) AS n, any_value(l.languages) AS languages FROM repo_files f LEFT JOIN (SELECT repo_id, list(language ORDER BY n DESC, language) AS languages FROM (SELECT repo_id, language, sum(lines_of_code) AS n FROM repo_files WHERE language IS NOT NULL GROUP BY repo_id, language) GROUP BY repo_id) l USING (repo_id) GROUP BY f.repo_id),
own AS (SELECT r.*, b.pattern, b.confidence AS sure, p.n, p.languages, coalesce(p.languages[1], 'unknown') AS lang, CASE main_language WHEN 'typescript' THEN [{'name': 'React', 'category': 'frontend'}, {'name': 'Vitest', 'category': 'testing'}, {'name': 'ESLint', 'category': 'other'}]
  WHEN 'javascript' THEN [{'name': 'Express', 'category': 'backend'}, {'name': 'Jest', 'category': 'testing'}, {'name': 'Webpack', 'category': 'build'}] WHEN 'python' THEN [{'name': 'Django', 'category': 'backend'}]
  WHEN 'go' THEN [{'name': 'Turborepo', 'category': 'build'}, {'name': 'Prisma', 'category': 'orm'}] WHEN 'java' THEN [{'name': 'Playwright', 'category': 'testing'}] ELSE [] END AS frameworks,
  CASE main_language WHEN 'typescript' THEN 'application' WHEN 'javascript' THEN 'service' WHEN 'go' THEN 'monorepo' ELSE CASE WHEN package_manager IN ('npm', 'pnpm', 'yarn', 'bun') THEN 'library' ELSE 'unknown' END END AS project_type
  FROM repository r LEFT JOIN best b USING (repo_id) LEFT JOIN prof p USING (repo_id)),
ident AS (SELECT repo_id, regexp_extract(rtrim(root_path, '/'), '([^/]*)$', 1) AS name, project_type, frameworks, CASE main_language WHEN 'typescript' THEN 'vitest' WHEN 'javascript' THEN 'jest' WHEN 'java' THEN 'playwright' END AS test_framework, package_manager,
  'A ' || lang || ' ' || replace(project_type, 'unknown', 'project') || CASE WHEN coalesce(pattern, 'unknown') <> 'unknown' THEN ' using ' || pattern || ' architecture' ELSE '' END AS description, n, languages, lang, pattern, sure,
  main_language IN ('typescript', 'javascript', 'java') IS TRUE AS has_tests, main_language = 'typescript' IS TRUE AS has_linting, repo_id % 2 = 0 AS has_documentation, total_files IS NOT NULL AS uses_semver FROM own)"""
# -- impact: all dependents as bounded levels, and what they touch
_IMPACT = (
    graphs.bounded()
    + """, scope AS (SELECT target, id AS member FROM reached UNION ALL SELECT target, target FROM l0),
cols AS (SELECT 'domain' AS kind, repo_id || '|' || belongs_to_domain AS id, repo_id || '|' || path AS member, NULL::DOUBLE AS value FROM cur WHERE belongs_to_domain IS NOT NULL
  UNION ALL SELECT 'risk', repo_id || '|' || path || '#' || r, repo_id || '|' || path, CASE WHEN contains(r, 'cycle') OR contains(r, 'circular') THEN 7 ELSE 4 END FROM (SELECT *, unnest(risks) AS r FROM cur)
  UNION ALL SELECT 'critical', 'critical:' || repo_id || '|' || path, repo_id || '|' || path, importance FROM cur WHERE criticality = 'critical'
  UNION ALL SELECT 'layer', belongs_to_layer, repo_id || '|' || path, NULL FROM cur WHERE belongs_to_layer IS NOT NULL),
hits AS (SELECT *, row_number() OVER (PARTITION BY target, kind ORDER BY id) AS n FROM (SELECT target, kind, id, min(c.member) AS witness, max(value) AS value FROM scope s JOIN cols c USING (member) GROUP BY target, kind, id)),
eff AS MATERIALIZED (SELECT * FROM hits WHERE n <= 500),
first_path AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS n FROM reached) WHERE n = 1),
steps AS (SELECT target, p[i] AS dependency, p[i + 1] AS dependent FROM (SELECT target, p, unnest(range(1, len(p))) AS i FROM first_path)),
lay AS (SELECT DISTINCT repo_id || '|' || path AS member, belongs_to_layer AS layer FROM cur WHERE belongs_to_layer IS NOT NULL),
crossed AS MATERIALIZED (SELECT DISTINCT target, a.layer AS from_layer, b.layer AS to_layer, dependent, dependency FROM steps s JOIN lay a ON a.member = s.dependency JOIN lay b ON b.member = s.dependent WHERE a.layer <> b.layer),
trunc AS MATERIALIZED (SELECT target, 'max-entities' AS kind, 500 AS "limit", id AS at FROM rest
  UNION ALL SELECT target, 'max-depth', 8, arg_min(id, p) FROM l9 WHERE target NOT IN (SELECT target FROM rest) GROUP BY target
  UNION ALL SELECT target, 'max-evidence-paths', 1, id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS n FROM reached) WHERE n = 2),
sums AS (SELECT target, count(*) FILTER (WHERE kind = 'domain')::DOUBLE AS nd, coalesce(sum(value) FILTER (WHERE kind = 'critical'), 0) AS sc, coalesce(sum(value) FILTER (WHERE kind = 'risk'), 0) AS sr,
  1 - coalesce(product(1 - greatest(0, least(1, value))) FILTER (WHERE kind = 'critical'), 1) AS pc, 1 - coalesce(product(1 - greatest(0, least(1, value / 10))) FILTER (WHERE kind = 'risk'), 1) AS pr FROM eff GROUP BY target),
base AS (SELECT t.target, coalesce(r.n, 0) AS n_impacted, r.least_depth AS minimum_depth, coalesce(r.direct, 0) AS n_direct, coalesce(nd, 0) AS nd, coalesce(sc, 0) AS sc, coalesce(sr, 0) AS sr, coalesce(pc, 0) AS pc, coalesce(pr, 0) AS pr, coalesce(x.n, 0)::DOUBLE AS nb
  FROM l0 t LEFT JOIN (SELECT target, count(*) AS n, min(depth) AS least_depth, count(*) FILTER (WHERE depth = 1) AS direct FROM reached GROUP BY target) r USING (target) LEFT JOIN sums USING (target) LEFT JOIN (SELECT target, count(*) AS n FROM crossed GROUP BY target) x USING (target)),
"""
    + "scored AS MATERIALIZED (SELECT target, n_impacted, minimum_depth, n_direct, "
    + ", ".join(
        f"floor(({e} * {w}::DOUBLE * 100 + 2.220446049250313e-16) * 100 + 0.5) / 100 AS {n}"
        for n, e, w in (("reach", "n_impacted / (n_impacted + 1)", 0.35), ("critical", "pc", 0.25), ("domain", "nd / (nd + 1)", 0.15), ("risk", "pr", 0.15), ("boundary", "nb / (nb + 1)", 0.1))
    )
    + ", nd, sc, sr, nb FROM base) "
)
_COMPONENT = " UNION ALL ".join(
    f"SELECT s.target, '{k}' AS kind, {raw}::DOUBLE AS raw, {k} AS contribution, CASE WHEN st{' OR pa' if k == 'boundary' else ''}{f' OR mo_{more}' if more else ''} THEN 'partial' ELSE 'available' END AS status FROM scored s JOIN flags USING (target)"
    for k, raw, more in (("reach", "n_impacted", ""), ("critical", "sc", "critical"), ("domain", "nd", "domain"), ("risk", "sr", "risk"), ("boundary", "nb", "layer"))
)
_FLAGS = """, flags AS (SELECT t.target, EXISTS (SELECT 1 FROM trunc x WHERE x.target = t.target AND x.kind <> 'max-evidence-paths') AS st, EXISTS (SELECT 1 FROM trunc x WHERE x.target = t.target AND x.kind = 'max-evidence-paths') AS pa, """
_FLAGS += ", ".join(f"EXISTS (SELECT 1 FROM hits h WHERE h.target = t.target AND h.kind = '{k}' AND h.n = 501) AS mo_{k}" for k in ("critical", "domain", "risk", "layer")) + " FROM l0 t) "

SQL = {
    "impact_batch": _IMPACT + "SELECT target, n_impacted, minimum_depth, n_direct, reach, critical, domain, risk FROM scored",
    "impact_scores": _IMPACT + "SELECT target, n_impacted, minimum_depth, n_direct, reach, critical, domain, risk, boundary, floor((reach + critical + domain + risk + boundary + 2.220446049250313e-16) * 100 + 0.5) / 100 AS total FROM scored",
    "impact_truncations": _IMPACT + "SELECT * FROM trunc",
    "impact_effects": _IMPACT + "SELECT target, kind, id, witness FROM eff",
    "impact_crossings": _IMPACT + "SELECT * FROM crossed",
    "impact_components": _IMPACT.rstrip() + _FLAGS + _COMPONENT,
    "component_union": _IMPACT + "SELECT CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS kind, id FROM reached GROUP BY id UNION ALL SELECT DISTINCT kind, id FROM eff UNION ALL SELECT DISTINCT 'crossing', from_layer || ':' || to_layer || ':' || dependent || ':' || dependency FROM crossed",
    "impact_targets": BASE
    + """, f AS (SELECT DISTINCT path FROM repo_files WHERE repo_id = 1), n AS (SELECT path AS id, path FROM f UNION ALL SELECT 'copy:' || path, path FROM f WHERE path LIKE '%a%'),
      own AS (SELECT 'file:' || path AS target, path AS id FROM f),
      other AS (SELECT './' || replace(path, '/', '//') AS target, path AS np FROM f UNION ALL SELECT '.' || chr(92) || path, path FROM f UNION ALL SELECT 'no/' || path, 'no/' || path FROM f)
      SELECT target, id, NULL::VARCHAR AS error FROM own UNION ALL
      SELECT o.target, CASE WHEN count(DISTINCT n.id) = 1 THEN min(n.id) END, CASE count(DISTINCT n.id) WHEN 0 THEN 'missing' WHEN 1 THEN NULL ELSE 'ambiguous' END FROM other o LEFT JOIN n ON n.path = o.np GROUP BY o.target""",
    "language_distribution": BASE + f"SELECT repo_id, language, file_count, {_PERC.format('file_count', 100)} FROM (SELECT repo_id, language, count(*) AS file_count FROM repo_files WHERE language IS NOT NULL GROUP BY repo_id, language)",
    "language_breakdown_by_loc": BASE + f"SELECT repo_id, language, lines_of_code, {_PERC.format('lines_of_code', 10)} FROM (SELECT repo_id, language, sum(lines_of_code)::BIGINT AS lines_of_code FROM repo_files WHERE language IS NOT NULL GROUP BY repo_id, language)",
    "layer_inference": BASE + _LAYERS + "SELECT * FROM layers",
    "directional_evidence": BASE + f", z AS ({_DIRECTION}) SELECT * FROM z",
    "architecture_signals": BASE + _SIGNALS + "SELECT * FROM signals",
    "pattern_scores": BASE + _SIGNALS + _SCORES + "SELECT * FROM scores",
    "best_pattern": BASE + _SIGNALS + _SCORES + _BEST + "SELECT * FROM best",
    "service_topology": BASE + f"SELECT repo_id, count(DISTINCT a) AS n_services, count(*) AS n_files FROM (SELECT repo_id, {_AREA} AS a FROM repo_files) WHERE a <> '' GROUP BY repo_id",
    "naming_convention": BASE + f""", st AS (SELECT repo_id, {_STYLE} AS style FROM (SELECT repo_id, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?:\\.d)?\\.[^.]+$', ''), '\\.(?:test|spec)$', '') AS stem FROM repo_files)),
      c AS (SELECT repo_id, style, count(*) AS n FROM st WHERE style IS NOT NULL GROUP BY repo_id, style), t AS (SELECT *, sum(n) OVER (PARTITION BY repo_id)::BIGINT AS total, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, style) AS rn FROM c)
      SELECT repo_id, style, n, total, floor(n / total * 1000 + 0.5) / 10 AS percentage FROM t WHERE rn = 1 AND total >= 3 AND n / total >= 0.2""",
    "source_root_convention": BASE + "SELECT repo_id, count(*) FILTER (WHERE starts_with(path, 'src/')) AS in_src, count(*) AS total FROM repo_files GROUP BY repo_id HAVING count(*) >= 3 AND count(*) FILTER (WHERE starts_with(path, 'src/')) / count(*) >= 0.6",
    "test_layout": BASE
    + """, tf AS (SELECT repo_id, CASE WHEN regexp_matches(path, '[-_]?[vV]iew\\.\\w+$') THEN 'tests/' || path ELSE regexp_replace(path, '[-_]?[hH]elper(\\.\\w+)$', '.test\\1') END AS path FROM repo_files)
      SELECT repo_id, count(*) AS test_files, count(*) FILTER (WHERE regexp_matches(path, '(?i)\\.(?:test|spec)\\.[^.]+$')) AS colocated, CASE WHEN count(*) FILTER (WHERE regexp_matches(path, '(?i)\\.(?:test|spec)\\.[^.]+$')) >= count(*) / 2 THEN 'co-located' ELSE 'dedicated-directory' END AS style FROM tf WHERE regexp_matches(path, '(?i)(?:^|/)(?:__tests__/|test/|tests/)|\\.(?:test|spec)\\.[^.]+$') GROUP BY repo_id""",
    "export_style": BASE + _EXPORTS + ", p AS (SELECT repo_id, path, bool_or(kind = 'default') AS d, bool_or(kind = 'named') AS n FROM exports GROUP BY repo_id, path) SELECT repo_id, count(*) FILTER (WHERE d) AS default_files, count(*) FILTER (WHERE n) AS named_files, CASE WHEN count(*) FILTER (WHERE d) > count(*) FILTER (WHERE n) THEN 'default' ELSE 'named' END AS style FROM p GROUP BY repo_id HAVING count(*) FILTER (WHERE d OR n) > 0",
    "barrel_pattern": BASE + "SELECT 1 AS repo_id, count(DISTINCT src) AS file_count, count(*) AS re_exports FROM raw_edges WHERE type = 're-export'",
    "dynamic_imports": BASE + "SELECT 1 AS repo_id, src AS path, dst AS source FROM raw_edges WHERE type = 'dynamic-import'",
    "risk_high_complexity": BASE + f", z AS ({_HIGH}) SELECT * FROM z",
    "risk_large_file": BASE + f", z AS ({_LARGE}) SELECT * FROM z",
    "risk_excessive_imports": BASE + f", z AS (SELECT src AS path, count(*) AS n FROM raw_edges GROUP BY src) SELECT 1 AS repo_id, {_rid('excessive-imports', 'path')} AS id, 'excessive-imports' AS type, CASE WHEN n >= 40 THEN 'high' ELSE 'medium' END AS severity, [path] AS affected, n::DOUBLE AS measured FROM z WHERE n >= 20",
    "risk_orphan": BASE + f", z AS ({_ORPHAN}) SELECT * FROM z",
    "risk_unstable": BASE + f", ie AS (SELECT DISTINCT 1 AS repo_id, src, dst FROM raw_edges WHERE type = 'import'), z AS ({_unstable('ie')}) SELECT * FROM z",
    "risk_barrel": BASE + f", z AS (SELECT src AS path, count(*) AS n FROM raw_edges WHERE type = 're-export' GROUP BY src) SELECT 1 AS repo_id, {_rid('barrel-explosion', 'path')} AS id, 'barrel-explosion' AS type, CASE WHEN n >= 30 THEN 'high' ELSE 'medium' END AS severity, [path] AS affected, n::DOUBLE AS measured FROM z WHERE n >= 15",
    "barrel_pattern_whole": BASE + _EXPORTS + ", z AS (SELECT path, count(*) AS n FROM exports GROUP BY path HAVING bool_and(kind = 're-export')) SELECT 1 AS repo_id, count(*) AS file_count, sum(n)::BIGINT AS re_exports FROM z HAVING count(*) > 0",
    "risk_unstable_whole": BASE + f", ie AS (SELECT DISTINCT 1 AS repo_id, src, dst FROM raw_edges), z AS ({_unstable('ie')}) SELECT * FROM z",
    "risk_barrel_whole": BASE + _EXPORTS + f", z AS (SELECT path, count(*) AS n FROM exports GROUP BY path HAVING bool_and(kind = 're-export')) SELECT 1 AS repo_id, {_rid('barrel-explosion', 'path')} AS id, 'barrel-explosion' AS type, CASE WHEN n >= 30 THEN 'high' ELSE 'medium' END AS severity, [path] AS affected, n::DOUBLE AS measured FROM z WHERE n >= 15",
    "all_risks": BASE + _RISKS + "SELECT * FROM risks",
    "importance": BASE + _IMP + "SELECT repo_id, path, in_degree, out_degree, round(importance, 6) AS importance FROM imp",
    "entity_roles": BASE + _ROLES + "SELECT * FROM roles",
    "entity_purposes": BASE + _ROLES + "SELECT repo_id, path, CASE role " + " ".join(f"WHEN '{r}' THEN '{t.replace('{}', '')}'" for r, t in S.PURPOSES.items()) + " END || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS purpose FROM roles",
    "entities": _ALL + "SELECT repo_id, id, path, name, role, layer, round(importance, 6) AS importance, criticality, complexity, round(health, 6) AS health, depends_on, depended_on_by FROM ent",
    "entity_filter_page": _ALL + "SELECT repo_id, path, role FROM ent WHERE role = 'service' AND criticality = 'low' ORDER BY repo_id, path LIMIT 20 OFFSET 5",
    "entity_by_id": BASE + "SELECT repo_id, entity_id, complexity FROM cur WHERE entity_id LIKE 'file:src/generated/%'",
    "domains": BASE + _DOM + "SELECT * FROM dom",
    "domain_dependencies": BASE + _DOM + f", pl AS (SELECT repo_id, path, 'domain:' || {_TOP} AS d FROM repo_files) SELECT DISTINCT e.repo_id, a.d AS src_domain, b.d AS dst_domain FROM repo_edges e JOIN pl a ON e.repo_id = a.repo_id AND e.src = a.path JOIN pl b ON e.repo_id = b.repo_id AND e.dst = b.path JOIN dom x ON x.repo_id = a.repo_id AND x.id = a.d JOIN dom y ON y.repo_id = b.repo_id AND y.id = b.d WHERE a.d <> b.d",
    "capabilities": BASE + _CAP + "SELECT * FROM cap",
    "profile": BASE + "SELECT f.repo_id, count(*) AS total_files, sum(lines_of_code)::BIGINT AS total_lines, CASE WHEN count(*) < 20 THEN 'tiny' WHEN count(*) < 100 THEN 'small' WHEN count(*) < 500 THEN 'medium' WHEN count(*) < 5000 THEN 'large' ELSE 'massive' END AS repository_size, any_value(l.languages) AS languages FROM repo_files f LEFT JOIN (SELECT repo_id, list(language ORDER BY n DESC, language) AS languages FROM (SELECT repo_id, language, sum(lines_of_code) AS n FROM repo_files WHERE language IS NOT NULL GROUP BY repo_id, language) GROUP BY repo_id) l USING (repo_id) GROUP BY f.repo_id",
    "semantic_nodes": _ALL + _SEM_NODES + "SELECT repo_id, id, kind, label, round(weight::DOUBLE, 6) AS weight FROM sn",
    "semantic_edges": _ALL
    + _SEM_NODES
    + f""", se AS (SELECT repo_id, 'file:' || path AS src, 'domain:' || {_TOP} AS dst, 'belongs-to' AS kind, 1.0::DOUBLE AS weight, 0.6::DOUBLE AS confidence, 1 AS rk FROM repo_files UNION ALL
      SELECT repo_id, id, 'layer:' || layer, 'belongs-to', 1.0, 0.8, 2 FROM ent WHERE layer IS NOT NULL UNION ALL SELECT repo_id, unnest(implemented_by), id, 'serves', confidence, confidence, 3 FROM cap UNION ALL SELECT repo_id, id, unnest(depends_on), 'depends-on', 0.5, 0.9, 4 FROM ent),
      f AS (SELECT *, row_number() OVER (PARTITION BY repo_id, src, dst ORDER BY rk) AS rn FROM se WHERE dst IS NOT NULL)
      SELECT f.repo_id, src, dst, kind, round(weight, 6) AS weight, round(confidence, 6) AS confidence FROM f SEMI JOIN sn a ON f.repo_id = a.repo_id AND f.src = a.id SEMI JOIN sn b ON f.repo_id = b.repo_id AND f.dst = b.id WHERE rn = 1""",
    "complexity_profile": _ALL
    + """SELECT repo_id, floor(avg(complexity) * 100 + 0.5) / 100 AS average_complexity, max(complexity) AS max_complexity, arg_min(path, (-complexity, path)) AS most_complex, count(*) FILTER (WHERE complexity <= 5) AS low,
      count(*) FILTER (WHERE complexity > 5 AND complexity <= 15) AS medium, count(*) FILTER (WHERE complexity > 15 AND complexity <= 30) AS high, count(*) FILTER (WHERE complexity > 30) AS critical,
      floor(count(*) FILTER (WHERE complexity > 15) / count(*) * 100 * 10 + 0.5) / 10 AS complex_percentage, floor(avg(len(depended_on_by)) * 100 + 0.5) / 100 AS afferent, floor(avg(len(depends_on)) * 100 + 0.5) / 100 AS efferent,
      floor(avg(CASE WHEN len(depended_on_by) + len(depends_on) > 0 THEN len(depends_on) / (len(depended_on_by) + len(depends_on)) ELSE 0 END) * 100 + 0.5) / 100 AS instability FROM ent GROUP BY repo_id""",
    "risk_exposure": BASE + _RISKS + f"SELECT repo_id, {_EXPO} AS exposure FROM risks GROUP BY repo_id",
    "risk_assessment": BASE + _RISKS + "SELECT repo_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("info", "low", "medium", "high", "critical")) + f", {_EXPO} AS exposure FROM risks GROUP BY repo_id",
    "risks_by_category": BASE + _RISKS + "SELECT repo_id, type, count(*) AS n FROM risks GROUP BY repo_id, type",
    "top_risks": BASE + _RISKS + f"SELECT repo_id, place, id, type, severity, n_affected FROM (SELECT repo_id, id, type, severity, len(affected) AS n_affected, row_number() OVER (PARTITION BY repo_id ORDER BY {_W} DESC, len(affected) DESC, id) AS place FROM risks) WHERE place <= 10",
    "health": _ALL + _HEALTH + "SELECT * FROM he",
    "critical_components": _COMP
    + f"""SELECT repo_id, path, {_crit('score')} AS criticality, floor(score * 1000 + 0.5) / 1000 AS score, floor(importance * 1000 + 0.5) / 1000 AS centrality, floor(fi * 1000 + 0.5) / 1000 AS fan_in, floor(fo * 1000 + 0.5) / 1000 AS fan_out, floor(fc * 1000 + 0.5) / 1000 AS complexity,
      CASE WHEN fi <= 0.7 AND fc <= 0.7 AND importance <= 0.7 AND fo <= 0.7 THEN {_crit('score')} || ' criticality based on composite scoring' ELSE {_crit('score')} || ' criticality due to ' || concat_ws(', ', CASE WHEN fi > 0.7 THEN 'high fan-in (' || len(depended_on_by) || ' dependents)' END,
        CASE WHEN fc > 0.7 THEN 'high complexity (' || complexity || ')' END, CASE WHEN importance > 0.7 THEN 'high graph centrality' END, CASE WHEN fo > 0.7 THEN 'high fan-out (' || len(depends_on) || ' dependencies)' END) END AS reason FROM crit WHERE score >= 0.3""",
    "identity": _ALL + _IDENT + " SELECT repo_id, name, project_type, list_transform(frameworks, lambda f: f.name || ':' || f.category) AS frameworks, test_framework, package_manager, description, has_tests, has_linting, has_documentation, uses_semver, false AS has_ci, false AS has_changelog, false AS has_contributing, false AS has_docker FROM ident",
    "story": _COMP
    + _HEALTH
    + _IDENT
    + f""", ra AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS worst, count(*) FILTER (WHERE severity = 'high') AS high, {_EXPO} AS exposure FROM risks GROUP BY repo_id),
      tops AS (SELECT repo_id, list(upper(severity) || ': ' || type || ' (affects ' || len(affected) || ' file' || CASE WHEN len(affected) = 1 THEN '' ELSE 's' END || ').' ORDER BY place) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_W} DESC, len(affected) DESC, id) AS place FROM risks) WHERE place <= 3 GROUP BY repo_id),
      cc AS (SELECT repo_id, count(*) AS k, list(name ORDER BY s DESC, path) AS names FROM (SELECT *, floor(score * 1000 + 0.5) / 1000 AS s FROM crit WHERE score >= 0.8) GROUP BY repo_id),
      ly AS (SELECT repo_id, count(*) AS k, array_to_string(list(name ORDER BY rank), ', ') AS names FROM layers GROUP BY repo_id), dm AS (SELECT repo_id, count(*) AS k FROM dom GROUP BY repo_id),
      low AS (SELECT repo_id, overall, list_min([struct_pack(v := architecture, i := 0, n := 'architecture'), struct_pack(v := dependency, i := 1, n := 'dependency'), struct_pack(v := complexity, i := 2, n := 'complexity'), struct_pack(v := knowledge, i := 3, n := 'knowledge'), struct_pack(v := risk, i := 4, n := 'risk')]) AS w FROM he)
      SELECT i.repo_id, i.name || ' is a ' || CASE WHEN coalesce(n, 0) < 20 THEN 'tiny' WHEN n < 100 THEN 'small' WHEN n < 500 THEN 'medium' WHEN n < 5000 THEN 'large' ELSE 'massive' END || ' ' || project_type || CASE WHEN len(languages) = 1 THEN ' written in ' || lang ELSE ' written primarily in ' || lang || ' with ' || (coalesce(len(languages), 0) - 1) || CASE WHEN coalesce(len(languages), 0) = 2 THEN ' additional language' ELSE ' additional languages' END END
        || CASE WHEN len(frameworks) > 0 THEN ', using ' || array_to_string(list_transform(frameworks, lambda f: f.name), ', ') ELSE '' END || '. ' || description || '.' AS summary,
      'Heuristic analysis matched a ' || coalesce(pattern, 'unknown') || ' architecture' || CASE WHEN floor(coalesce(sure, 0) * 100 + 0.5) > 0 THEN ' (' || CAST(floor(sure * 100 + 0.5) AS INTEGER) || '% heuristic match)' ELSE '' END || CASE WHEN ly.k IS NULL THEN '' WHEN ly.k = 1 THEN ' with 1 layer: ' || ly.names ELSE ' with ' || ly.k || ' layers: ' || ly.names END || '.' AS architecture,
      CASE WHEN dm.k IS NULL THEN 'No distinct business domains were identified. The codebase may be a single-domain application or a library.' WHEN dm.k = 1 THEN 'The codebase contains 1 identified business domain.' ELSE 'The codebase contains ' || dm.k || ' identified business domains.' END AS domains,
      CASE WHEN overall IS NULL THEN 'Heuristic health is unavailable because no source files were parsed.' ELSE 'Heuristic health: ' || overall || '/100 (' || CASE WHEN overall >= 85 THEN 'excellent' WHEN overall >= 70 THEN 'good' WHEN overall >= 50 THEN 'fair' WHEN overall >= 30 THEN 'poor' ELSE 'critical' END || ').' || CASE WHEN w.v < 60 THEN ' Key concern: the ' || w.n || ' heuristic signal is ' || w.v || '/100.' ELSE '' END END AS health,
      CASE WHEN cc.k IS NULL THEN 'No critical-severity components were identified.' ELSE 'The critical path runs through ' || cc.k || CASE WHEN cc.k = 1 THEN ' component: ' ELSE ' components: ' END || array_to_string(cc.names[1:5], ' -> ') || '.' END AS critical,
      CASE WHEN ra.total IS NULL THEN ['No risks were detected.'] ELSE list_filter(list_concat([ra.total || CASE WHEN ra.total = 1 THEN ' risk' ELSE ' risks' END || ' detected (risk exposure: ' || exposure || '/100).', CASE WHEN worst = 1 THEN '1 critical-severity risk requires immediate attention.' WHEN worst > 1 THEN worst || ' critical-severity risks require immediate attention.' END,
        CASE WHEN high = 1 THEN '1 high-severity risk should be addressed in the near term.' WHEN high > 1 THEN high || ' high-severity risks should be addressed in the near term.' END], t), lambda x: x IS NOT NULL) END AS risks
      FROM ident i LEFT JOIN ly USING (repo_id) LEFT JOIN dm USING (repo_id) LEFT JOIN low USING (repo_id) LEFT JOIN cc USING (repo_id) LEFT JOIN ra USING (repo_id) LEFT JOIN tops USING (repo_id)""",
    "knowledge_health": _ALL
    + """, notes AS (SELECT repo_id, """ + I.NORM_SQL.format("relative_path") + """ AS path, count(*) AS k FROM manifest GROUP BY ALL), nz AS (SELECT e.repo_id, count(*) AS n, sum(CASE WHEN k IS NULL THEN 0 ELSE least(1.0, k / 5) END) AS density, count(k) AS covered, coalesce(sum(k), 0) AS notes, avg(len(depends_on)) AS ad, max(len(depends_on)) AS md, avg(e.complexity) AS ac, avg(CASE WHEN e.complexity > 20 THEN 1.0 ELSE 0 END) AS hc FROM ent e LEFT JOIN notes USING (repo_id, path) GROUP BY e.repo_id),
      hd AS (SELECT nz.repo_id, CAST(floor(least(100.0, coalesce(b.confidence, 0) * 70) + 0.5) AS INTEGER) AS architecture, CAST(greatest(0, 100 - CASE WHEN ad > 15 THEN 30 WHEN ad > 10 THEN 20 WHEN ad > 5 THEN 10 ELSE 0 END - CASE WHEN md > 30 THEN 20 WHEN md > 20 THEN 10 ELSE 0 END) AS INTEGER) AS dependency,
        CAST(greatest(0, 100 - CASE WHEN ac > 20 THEN 40 WHEN ac > 10 THEN 20 WHEN ac > 5 THEN 5 ELSE 0 END - CASE WHEN hc > 0.3 THEN 30 WHEN hc > 0.1 THEN 15 ELSE 0 END) AS INTEGER) AS complexity, CAST(floor(density / n * 50 + covered / n * 30 + least(1.0, notes / n) * 20 + 0.5) AS INTEGER) AS knowledge, CAST(100 - coalesce(x.exposure, 0) AS INTEGER) AS risk
        FROM nz LEFT JOIN best b USING (repo_id) LEFT JOIN expo x USING (repo_id)) SELECT *, CAST(floor(architecture * 0.25::DOUBLE + dependency * 0.2::DOUBLE + complexity * 0.25::DOUBLE + knowledge * 0.15::DOUBLE + risk * 0.15::DOUBLE + 0.5) AS INTEGER) AS overall FROM hd""",
    "ignore_filter": BASE + f"SELECT repo_id, path, len(list_filter(string_split(path, '/'), lambda s: regexp_full_match(s, '(?i){_IGNORED_NAMES}'))) > 0 OR regexp_matches(path, '(?i)^src/[^/]*/data(?:/.*)?$') OR regexp_matches(path, '(?i)^.*/util/[^/]*\\.py(?:/.*)?$') AS ignored FROM held_manifest",
    "path_normalise": f"SELECT DISTINCT file_id, relative_path, {I.NORM_SQL.format('relative_path')} AS path, regexp_replace({I.NORM_SQL.format('relative_path')}, '/?[^/]*$', '') AS dir, lower(regexp_extract(regexp_extract(relative_path, '([^/]*)$', 1), '\\.([^.]+)$', 1)) AS ext FROM manifest",
    "package_root": f"SELECT path, split_part(path, '/', 1) AS root, CASE WHEN regexp_extract(path, '^((?:packages|apps)/[^/]+)', 1) <> '' THEN regexp_extract(path, '^((?:packages|apps)/[^/]+)', 1) WHEN split_part(path, '/', 1) <> '' AND NOT contains(split_part(path, '/', 1), '.') THEN split_part(path, '/', 1) ELSE 'root' END AS module FROM (SELECT DISTINCT {I.NORM_SQL.format('relative_path')} AS path FROM manifest)",
    "candidate_expansion": BASE + "SELECT DISTINCT path, path || ';' || array_to_string(list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'], lambda e: regexp_replace(path, '\\.[^./]+$', '') || e), ';') AS candidates FROM repo_files",
    "integrity_violations": BASE + """SELECT 'snapshot-id-unique' AS rule, repo_id || '|' || version AS id FROM snapshots GROUP BY repo_id, version HAVING count(*) > 1 UNION ALL
      SELECT DISTINCT 'dependency-known', r.repo_id || '|' || r.dep FROM (SELECT repo_id, unnest(depends_on) AS dep FROM cur) r ANTI JOIN cur c ON r.repo_id = c.repo_id AND r.dep = c.entity_id UNION ALL
      SELECT DISTINCT 'repository-known', CAST(repo_id AS VARCHAR) FROM cur WHERE repo_id NOT IN (SELECT repo_id FROM repository) UNION ALL
      SELECT 'score-range', repo_id || '|' || entity_id FROM cur WHERE NOT (importance BETWEEN 0 AND 1) OR NOT (health_score BETWEEN 0 AND 1)""",
    "recovery_status": "SELECT repo_id, version, CASE WHEN NOT bool_or(belongs_to_domain IS NOT NULL) THEN 'cleanup' WHEN NOT bool_and(CASE WHEN belongs_to_domain IS NOT NULL THEN importance <= 1 END) THEN 'quarantine' ELSE 'valid' END AS status FROM entity_states GROUP BY repo_id, version",
}
SQL["recovery_selection"] = f"SELECT repo_id, max(version) AS version FROM ({SQL['recovery_status']}) WHERE status = 'valid' GROUP BY repo_id"
