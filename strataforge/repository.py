"""One repository: analyse, refresh, query, compare, impact. Results are DataFrames; versions live in a Store."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import architecture as A
from strataforge.operators import cycles as C
from strataforge.operators import diffs as D
from strataforge.operators import graph as G
from strataforge.operators import impact as IM
from strataforge.operators import integrity as U
from strataforge.operators import intelligence as N
from strataforge.operators import knowledge as K
from strataforge.operators import synthesis as S
from strataforge.operators import traverse as T
from strataforge.runtime import cut
from strataforge.sources import gitio, parse, scan
from strataforge.sources.store import Store
from strataforge.streaming.changes import EventBus

KEYS = ["repo_id"]
VOLATILE = ("createdAt", "updatedAt", "detectedAt", "analyzedAt", "lastAnalyzedAt", "identifiedAt", "durationMs", "modifiedAtMs")


def analyse_files(files: DataFrame, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of parsed FILE rows with a ``repo_id`` (several repositories, or sides of a comparison, in one run).

    ``edges`` are given where they're known from a repair of earlier ones; else the graph is built.
    """
    if edges is None:
        nodes, edges = G.build_graph(files, KEYS)
    else:
        nodes = files.select(*KEYS, F.col("path").alias("id"), F.lit("file").alias("kind")).unionByName(edges.filter("is_external").select(*KEYS, F.col("dst").alias("id"), F.lit("external").alias("kind"))).distinct()
    # what many tables come from is kept, so that they don't work it out again each
    edges, nodes = cut(edges), cut(nodes)
    flat = files.select("repo_id", "path", "language", "complexity", F.col("linesOfCode").alias("lines_of_code"), "size", "imports", "exports", F.size("imports").alias("n_imports"))
    inner = edges.filter(~F.col("is_external"))
    cycles = C.cycles(inner.select("repo_id", "src", "dst"), KEYS)
    risks = K.all_risks(
        [K.high_complexity(flat), K.large_file(flat), K.excessive_imports(flat), K.orphan_files(flat, edges), K.unstable_modules(edges), K.barrel_explosion(flat), K.cycle_risks(cycles, KEYS)]
    )
    risks = cut(risks)
    layers = A.infer_layers(flat, KEYS)
    entities = cut(S.entities(flat, edges, nodes, layers, risks))
    imports = flat.select("repo_id", "path", F.explode("imports.source").alias("source"))
    caps, doms = S.capabilities(flat, imports=imports), S.domains(flat)
    best = A.best_pattern(A.score_patterns(A.signals(flat, edges, KEYS), KEYS), KEYS)
    exposure = N.risk_exposure(risks)
    arch = best.join(layers.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_layers")), "repo_id", "left").select("repo_id", "confidence", "n_layers")
    health = N.health(entities, arch, exposure)
    critical = N.critical_components(entities)
    profile = S.profile(flat)
    sem_nodes, sem_edges = S.semantic_graph(entities, doms, caps, layers, flat)
    return {
        "files": files, "nodes": nodes, "edges": edges, "cycles": cycles, "risks": risks, "layers": layers, "entities": entities, "domains": doms, "domain_edges": S.domain_edges(flat, inner), "capabilities": caps,
        "architecture": best, "health": health, "complexity": N.complexity_profile(entities), "risk_assessment": N.risk_assessment(risks), "critical": critical, "profile": profile,
        "semantic_nodes": sem_nodes, "semantic_edges": sem_edges, "modules": G.module_boundaries(flat, edges, KEYS),
    }


def story_of(tables: dict[str, DataFrame], repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identity, story) of analysed tables; ``repositories`` as for :func:`intelligence.identity`."""
    who = N.identity(repositories, tables["architecture"], tables["profile"])
    told = N.story(who, tables["profile"], tables["architecture"], tables["layers"], tables["domains"], tables["health"], tables["critical"], tables["risk_assessment"], N.top_risks(tables["risks"]))
    return who, told


class Repository:
    def __init__(self, spark: SparkSession, root: str, store: str, repo_id: str = "repository", bus: EventBus | None = None):
        self.spark, self.root, self.repo_id = spark, root, repo_id
        self.store, self.bus = Store(spark, store), bus or EventBus()

    # -- analysis --------------------------------------------------------------------------------
    def _texts(self, rows: DataFrame, repo_id: str | None = None) -> DataFrame:
        language = scan.P.language("relativePath")
        return rows.filter(language.isNotNull()).select(F.lit(repo_id or self.repo_id).alias("repo_id"), F.col("relativePath").alias("path"), language.alias("language"), "content")

    def _parsed(self, root: str, repo_id: str | None = None) -> DataFrame:
        return parse.parse(self._texts(scan.read_files(self.spark, root), repo_id), KEYS)

    def analyse(self) -> int:
        """Full analysis; an unchanged repository keeps its version."""
        self.bus.emit("analysis:started", self.root)
        return self._publish(self._parsed(self.root))

    def refresh(self, changed: list[str]) -> int:
        """Incremental analysis: of the files only ``changed`` are read, of these only such with new content are parsed, and only their edges are built.

        A changed configuration, a directory or an unknown repository calls for a full scan (parsed files are still reused). Where files were
        added or taken away the imports of all files are resolved anew, out of what was parsed before. The tables equal those of a full analysis.
        ``dirty`` holds the ids that are connected to a change; all files if the architecture changed.
        """
        version = self.store.latest(self.repo_id)
        if version is None:
            return self.analyse()
        self.bus.emit("analysis:refreshing", changed)
        old = self.store.read(self.repo_id, "files", version).select(*KEYS, *parse._NAMES)
        if scan.needs_full_scan(old.select(F.col("path").alias("relativePath")), changed, self.root):
            return self._publish(parse.parse_incremental(self._texts(scan.read_files(self.spark, self.root)), old, KEYS))
        paths = self.spark.createDataFrame([(c,) for c in changed], "path string").distinct()
        fresh = parse.parse_incremental(self._texts(scan.read_changed(self.spark, self.root, changed)), old.join(paths, "path", "left_semi").select(*old.columns), KEYS)
        return self._publish(old.join(paths, "path", "left_anti").select(*old.columns).unionByName(fresh), paths)

    def _publish(self, files: DataFrame, changed: DataFrame | None = None) -> int:
        latest = self.store.latest(self.repo_id)
        version = (latest or 0) + 1
        staged = str(self.store.root / "staging" / f"{self.repo_id}-{version}")
        files.write.mode("overwrite").parquet(staged)
        files = self.spark.read.parquet(staged)
        then = None if latest is None else self.store.read(self.repo_id, "files", latest)
        if then is not None and D.state_hash(files.drop("id"), KEYS).collect() == D.state_hash(then.drop("id"), KEYS).collect():
            self.bus.emit("analysis:unchanged", latest)
            return latest
        edges = None
        if changed is not None and G.same_keys(files, then, [*KEYS, "path"]):
            sources = changed.withColumn("repo_id", F.lit(self.repo_id))
            rebuilt = G.build_graph(files, KEYS, sources)[1]
            nodes = files.select(*KEYS, F.col("path").alias("id")).unionByName(self.store.read(self.repo_id, "nodes", latest).filter("kind = 'external'").select(*KEYS, "id"))
            edges = G.repair(self.store.read(self.repo_id, "edges", latest), rebuilt, sources.withColumnRenamed("path", "id"), nodes, KEYS)
        tables = analyse_files(files, edges)
        if changed is not None:
            tables["dirty"] = self._dirty(tables, latest, changed)
        self.store.publish(self.repo_id, version, tables, latest)
        self.bus.emit("analysis:ready", version)
        return version

    def _dirty(self, tables: dict[str, DataFrame], latest: int, changed: DataFrame) -> DataFrame:
        same = all(D.state_hash(tables[n], KEYS).collect() == D.state_hash(self.store.read(self.repo_id, n, latest), KEYS).collect() for n in ("architecture", "layers"))
        if not same:
            return tables["nodes"].filter("kind = 'file'").select("id")
        return T.dirty_closure(self.store.read(self.repo_id, "edges", latest), tables["edges"], changed.withColumnRenamed("path", "id"))

    def restore(self) -> int | None:
        return self.store.recover(self.repo_id)

    # -- queries ---------------------------------------------------------------------------------
    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.read(self.repo_id, name, version)

    def entities(self, domain: str | None = None, layer: str | None = None, criticality: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        out = self.table("entities")
        if domain:
            held = self.table("domains").filter((F.col("id") == domain) | (F.col("name") == domain)).select(F.expr("substring(id, 8)").alias("d"))
            out = out.withColumn("d", S.domain_of("path")).join(held, "d", "left_semi").drop("d")
        for column, value in (("layer", layer), ("criticality", criticality)):
            if value:
                out = out.filter(F.col(column) == value)
        out = out.orderBy("path").offset(offset)
        return out if limit is None else out.limit(limit)

    def entity(self, entity_id: str) -> DataFrame:
        return self.table("entities").filter(F.col("id") == entity_id)

    def _about(self) -> DataFrame:
        root = os.path.abspath(self.root)
        package, names = scan.read_json_config(os.path.join(root, "package.json")), os.listdir(root)
        version = (package or {}).get("version")
        row = (self.repo_id, root, [f["name"] for f in scan.frameworks(package)], scan.package_manager(names), package is not None, any(n.lower().startswith("readme") for n in names), version if isinstance(version, str) else None)
        return self.spark.createDataFrame([row], "repo_id string, root_path string, frameworks array<string>, package_manager string, has_package_json boolean, has_readme boolean, version string")

    def _tables(self, names: Sequence[str], version: int | None = None) -> dict[str, DataFrame]:
        """Tables of one version, so that what's put together fits."""
        version = self.store.latest(self.repo_id) if version is None else version
        return {n: self.table(n, version) for n in names}

    def identity(self, version: int | None = None) -> DataFrame:
        return N.identity(self._about(), *self._tables(["architecture", "profile"], version).values())

    def story(self, version: int | None = None) -> DataFrame:
        names = ["profile", "architecture", "layers", "domains", "health", "critical", "risk_assessment", "risks"]
        return story_of(self._tables(names, version), self._about())[1]

    def knowledge(self, version: int | None = None) -> dict[str, DataFrame]:
        """What conventions and patterns the files show: naming, source root, test layout, export style, barrels, dynamic imports."""
        files = self.table("files", version).select("repo_id", "path", "language", "imports", "exports")
        return {
            "naming": K.naming_convention(files, KEYS), "source_root": K.source_root(files, KEYS), "test_layout": K.test_layout(files, KEYS), "export_style": K.export_style(files, KEYS),
            "barrels": K.barrel_pattern(files, KEYS), "dynamic_imports": K.dynamic_imports(files, KEYS),
        }

    def overview(self) -> dict[str, DataFrame]:
        """One consistent version at a glance; raises if a newer one is published meanwhile."""
        version = self.store.latest(self.repo_id)
        if version is None:
            raise KeyError(f"{self.repo_id} has no version")
        names = ["health", "architecture", "profile", "complexity", "risk_assessment", "critical", "domains", "capabilities"]
        out = self._tables(names, version) | {"top_risks": N.top_risks(self.table("risks", version)), "story": self.story(version)}
        if self.store.latest(self.repo_id) != version:
            raise IM.StaleAnalysis(f"version {version} was replaced")
        return out

    def history(self, limit: int | None = None) -> list[int]:
        versions = self.store.versions(self.repo_id)[::-1]
        return versions if limit is None else versions[:limit]

    def diff(self, before: int, after: int) -> dict[str, DataFrame]:
        """Change set of two versions: entities, domains, risks, relationships, memberships."""
        a, b = (lambda n: self.table(n, before)), (lambda n: self.table(n, after))
        columns = ["role", "criticality", "complexity", "risks", "depends_on", "layer"]
        return {
            "entities": D.diff_by_key(a("entities"), b("entities"), ["id"], columns), "fields": D.field_changes(a("entities"), b("entities"), ["id"], columns),
            "domains": D.diff_by_key(a("domains"), b("domains"), ["id"], ["file_count", "lines_of_code"]), "risks": D.diff_by_key(a("risks"), b("risks"), ["id"], ["severity"]),
            "relationships": D.added_removed_kept(a("edges"), b("edges"), ["src", "dst"]).filter("side <> 'kept'"), "layer_changes": D.membership_changes(a("entities"), b("entities"), ["id"], "layer"),
        }

    # -- impact ----------------------------------------------------------------------------------
    def impact(self, paths: list[str], tables: dict[str, DataFrame] | None = None, expected_version: int | None = None, **bounds: int) -> IM.Impact:
        """Impact of files by id or path. Raises LookupError for a path that's no file or several, StaleAnalysis if ``expected_version`` isn't the newest."""
        if tables is None:
            version = self.store.latest(self.repo_id) or 0
            IM.guard(self.repo_id, version, self.repo_id, version, expected_version)
        t = tables or self._tables(["nodes", "edges", "entities", "risks", "critical", "capabilities"])
        asked = IM.resolve_ids(self.spark.createDataFrame([(p,) for p in paths], "target string"), t["nodes"].withColumn("path", F.col("id"))).collect()
        wrong = [f"{r.target}: {r.error}" for r in asked if r.error]
        if wrong:
            raise LookupError("; ".join(sorted(wrong)))
        targets = self.spark.createDataFrame([(r.id,) for r in asked], "target string")
        e = t["entities"]
        domains = e.select(S.domain_of("path").alias("id"), F.col("path").alias("member")).filter("id IS NOT NULL")
        capabilities = t["capabilities"].select("id", F.explode("implemented_by").alias("m")).select("id", F.regexp_replace("m", "^file:", "").alias("member"))
        risks = t["risks"].select("id", "severity", F.explode("affected").alias("member"))
        critical = t["critical"].select(F.col("path").alias("id"), F.col("path").alias("member"), "score")
        layers = e.filter("layer IS NOT NULL").select(F.col("path").alias("member"), "layer")
        return IM.impact(t["edges"], targets, domains=domains, capabilities=capabilities, critical=critical, risks=risks, layers=layers, **bounds)

    def working_tree_impact(self, max_paths: int = 10_000, **bounds: int) -> tuple[DataFrame, IM.Impact]:
        """(targets with their resolution, impact) of uncommitted changes against the newest analysis.

        More than ``max_paths`` changed files that are known raise, so that none is left out unseen.
        """
        changes = gitio.working_tree_changes(self.spark, self.root, max_paths)
        known = self.table("entities").select("path", F.col("path").alias("id"))
        both = known.withColumn("side", F.lit("before")).unionByName(known.withColumn("side", F.lit("after")))
        resolved = IM.resolve_targets(changes, both)
        ids = [r.target for r in resolved.filter("resolved").select("target").distinct().limit(max_paths + 1).toLocalIterator()]
        if len(ids) > max_paths:
            raise ValueError(f"more than {max_paths} changed files")
        return resolved, self.impact(ids, **bounds)

    def _tree_impact(self, changes: DataFrame, before: str, after: str, **bounds: int) -> tuple[DataFrame, dict[str, IM.Impact]]:
        """Both trees run through one pipeline, told apart by repo_id; impact per side."""
        folder = str(self.store.root / "trees")
        os.makedirs(folder, exist_ok=True)
        with gitio.materialise_tree(self.root, before, folder=folder) as old, gitio.materialise_tree(self.root, after, folder=folder) as new:
            files = self._parsed(old, "before").unionByName(self._parsed(new, "after"))
            staged = f"{folder}/parsed-{uuid.uuid4().hex}"
            files.write.mode("overwrite").parquet(staged)
        tables = analyse_files(self.spark.read.parquet(staged))
        ents = tables["entities"].select(F.col("repo_id").alias("side"), "path", F.col("path").alias("id"))
        resolved = IM.resolve_targets(changes, ents)
        out = {}
        for side in ("before", "after"):
            own = {n: t.filter(F.col("repo_id") == side) for n, t in tables.items()}
            out[side] = self.impact([r.target for r in resolved.filter((F.col("side") == side) & F.col("resolved")).toLocalIterator()], own, **bounds)
        return resolved, out

    def commit_impact(self, sha: str, parent: str | None = None, max_files: int = 500, **bounds: int) -> tuple[DataFrame, dict[str, IM.Impact]]:
        changes = gitio.commit_changes(self.spark, self.root, sha, parent, max_files)
        parents = gitio.commit_parents(self.root, sha)
        return self._tree_impact(changes, parent or (parents[0] if parents else gitio.EMPTY_TREE), sha, **bounds)

    def range_impact(self, base: str, head: str, max_files: int = 500, **bounds: int) -> tuple[DataFrame, dict[str, IM.Impact]]:
        return self._tree_impact(gitio.range_changes(self.spark, self.root, base, head, max_files), base, head, **bounds)

    def violations(self) -> DataFrame:
        """Broken references of the newest version; none if it's sound."""
        names = ["files", "nodes", "edges", "cycles", "entities", "risks", "domains", "capabilities", "layers", "architecture", "semantic_nodes", "semantic_edges", "critical", "complexity", "risk_assessment", "health"]
        return U.suite(self._tables(names))
