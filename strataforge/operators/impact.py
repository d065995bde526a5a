"""Change impact: who depends on a target, what that touches, and a score; for any number of targets in one run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.operators import parts
from strataforge.operators import traverse as T
from strataforge.operators.intelligence import weight
from strataforge.rules import IMPACT_LABELS, IMPACT_WEIGHTS

EPSILON = 2.220446049250313e-16


@dataclass
class Impact:
    """``impacted``: target, id, depth, predecessor; ``paths``: the first canonical paths; ``scores``: one row per target; ``truncations``;
    ``effects``: target, kind, id, witness (the first affected id in scope); ``crossings``: target, from_layer, to_layer, dependent, dependency;
    ``components``: target, kind, raw, normalized, weight, contribution, status; ``warnings``: target, warning."""

    impacted: DataFrame
    paths: DataFrame
    scores: DataFrame
    truncations: DataFrame
    effects: DataFrame
    crossings: DataFrame
    components: DataFrame
    warnings: DataFrame

    def evidence(self) -> DataFrame:
        """(target, evidence_id, entity_id, reason): for each impacted id, effect and crossing."""
        reason = F.when(F.col("depth") == 1, "direct-dependent").otherwise("transitive-dependent")
        structural = self.impacted.select("target", F.concat(F.lit("evidence:"), "id", F.lit(":"), reason).alias("evidence_id"), F.col("id").alias("entity_id"), reason.alias("reason"))
        name = F.create_map(*[F.lit(x) for kv in _REASONS.items() for x in kv])
        named = lambda r, i, e: F.concat(F.lit("evidence:semantic:"), r, F.lit(":"), i, F.lit(":"), e)
        semantic = self.effects.withColumn("reason", F.element_at(name, F.col("kind"))).select("target", named(F.col("reason"), F.col("id"), F.col("witness")).alias("evidence_id"), F.col("witness").alias("entity_id"), "reason")
        crossing = F.concat_ws(":", "from_layer", "to_layer", "dependent", "dependency")
        layers = self.crossings.select("target", named(F.lit("layer-boundary"), crossing, F.col("dependent")).alias("evidence_id"), F.col("dependent").alias("entity_id"), F.lit("layer-boundary").alias("reason"))
        return structural.unionByName(semantic).unionByName(layers)


#: Why an effect counts, by its kind.
_REASONS = {"domain": "domain-membership", "capability": "capability-implementation", "critical": "critical-component", "risk": "risk-reference", "layer": "architecture-layer-membership"}


class StaleAnalysis(ValueError):
    """The analysis isn't the one that was asked for."""


def guard(repository_id: str, analysis_version: int, state_repository_id: str, state_version: int, expected_version: int | None = None) -> None:
    """Raise unless the state is the repository's and of the version that is asked for and expected."""
    if not repository_id.strip():
        raise ValueError("a repository id is required")
    for version in (analysis_version, expected_version):
        if version is not None and (isinstance(version, bool) or not isinstance(version, int) or version < 0):
            raise ValueError(f"a version is a whole number of at least 0, not {version!r}")
    if expected_version is not None and expected_version != analysis_version:
        raise StaleAnalysis(f"expected version {expected_version}, received {analysis_version}")
    if state_repository_id != repository_id:
        raise StaleAnalysis(f"the state belongs to {state_repository_id}, not to {repository_id}")
    if state_version != analysis_version:
        raise StaleAnalysis(f"the state has version {state_version}, not {analysis_version}")


def resolve_ids(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, id, error): each target as a file's id: the id itself (a ``file:`` before it is left out), or else the one file whose normalised id
    or path it is. ``error`` is ``missing`` or ``ambiguous`` where that isn't one file, then ``id`` is null.

    ``targets`` (target), ``nodes`` (id, kind, path). Null targets are missing.
    """
    asked = targets.select("target").distinct().withColumn("_t", F.regexp_replace("target", "^file:", "")).withColumn("_n", P.normalise("_t"))
    files = nodes.filter("kind = 'file'").select("id", "path").distinct()
    exact = files.select(F.col("id").alias("_t"), F.col("id").alias("_exact")).distinct()
    names = files.select("id", F.explode(F.array_distinct(F.array(P.normalise("id"), P.normalise(F.coalesce("path", "id"))))).alias("_n"))
    held = names.groupBy("_n").agg(F.count_distinct("id").alias("_k"), F.min("id").alias("_one"))
    out = asked.join(exact, "_t", "left").join(held, "_n", "left")
    found = F.coalesce("_exact", F.when(F.col("_k") == 1, F.col("_one")))
    return out.select("target", found.alias("id"), F.when(found.isNotNull(), None).when(F.col("_k") > 1, "ambiguous").otherwise("missing").alias("error"))


def _round2(x: Column) -> Column:
    return F.floor((x + EPSILON) * 100 + 0.5) / 100


def _effects(scope: DataFrame, kind: str, table: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(target, kind, id, witness, value) of the first ``limit`` ids in scope, and the targets that have more.

    ``table`` (id, member, value). The limit is a top-k by id, below the shuffle.
    """
    hit = scope.join(table.select("id", "member", "value"), "member").groupBy("target", "id").agg(F.min("member").alias("witness"), F.max("value").alias("value"))
    placed = hit.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("id"))).filter(F.col("_n") <= limit + 1)
    return placed.filter(F.col("_n") <= limit).select("target", F.lit(kind).alias("kind"), "id", "witness", "value"), placed.filter(F.col("_n") > limit).select("target")


def _by_levels(
    adj: DataFrame, starts: DataFrame, given: dict[str, DataFrame | None], layers: DataFrame | None, max_depth: int, max_entities: int, max_paths: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, paths, truncations, effects, crossings and measures of each target across the cluster, for parts of any size."""
    spark = starts.sparkSession
    t = T.by_levels(adj, starts, max_depth, max_entities)
    nodes = t.nodes.select("target", "id", "depth", "predecessor")
    scope = nodes.select("target", F.col("id").alias("member")).unionByName(starts.select("target", F.col("target").alias("member")))
    paths = T.canonical_paths(t, max_paths)
    order = Window.partitionBy("target").orderBy("id")
    omitted = nodes.select("target", "id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_paths + 1).filter(F.col("_n") == max_paths + 1)
    truncations = t.truncations.unionByName(omitted.select("target", F.lit("max-evidence-paths").alias("kind"), F.lit(max_paths).alias("limit"), F.col("id").alias("at")))

    effects = spark.createDataFrame([], "target string, kind string, id string, witness string, value double")
    more = {}
    for kind, table in given.items():
        if table is not None:
            own, more[kind] = _effects(scope, kind, table, max_entities)
            effects = effects.unionByName(own)

    if layers is None:
        crossings = spark.createDataFrame([], "target string, from_layer string, to_layer string, dependent string, dependency string")
    else:
        steps = paths.select("target", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1))).alias("s")).select("target", F.col("s.0").alias("dependency"), F.col("s.1").alias("dependent"))
        a = layers.select(F.col("member").alias("dependency"), F.col("layer").alias("from_layer"))
        b = layers.select(F.col("member").alias("dependent"), F.col("layer").alias("to_layer"))
        crossings = steps.join(a, "dependency").join(b, "dependent").filter("from_layer <> to_layer").select("target", "from_layer", "to_layer", "dependent", "dependency").distinct()

    rest = lambda kind, scale: F.aggregate(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", (F.col("value") / scale).alias("p"))))), F.lit(1.0), lambda left, x: left * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"])))
    )
    per = effects.filter("kind IN ('domain', 'critical', 'risk')").groupBy("target").agg(
        F.count_if(F.col("kind") == "domain").cast("double").alias("_domain"), F.sum(F.when(F.col("kind") == "critical", F.col("value"))).alias("_critical"), F.sum(F.when(F.col("kind") == "risk", F.col("value"))).alias("_risk"),
        (1 - rest("critical", 1)).alias("_pc"), (1 - rest("risk", 10)).alias("_pr"),
    )
    cut_off = truncations.groupBy("target").agg(F.bool_or(F.col("kind") != "max-evidence-paths").alias("_structural"), F.bool_or(F.col("kind") == "max-evidence-paths").alias("_path"))
    reach = nodes.groupBy("target").agg(F.count(F.lit(1)).alias("n_impacted"), F.min("depth").alias("minimum_depth"), F.count_if(F.col("depth") == 1).alias("n_direct"))
    out = starts.join(reach, "target", "left").join(per, "target", "left").join(crossings.groupBy("target").agg(F.count(F.lit(1)).cast("double").alias("_boundary")), "target", "left").join(cut_off, "target", "left")
    for kind, table in more.items():
        out = out.join(table.withColumn(f"_more_{kind}", F.lit(True)), "target", "left")
    return nodes, paths, truncations, effects.drop("value"), crossings, out


def impact(
    edges: DataFrame,
    targets: DataFrame,
    *,
    domains: DataFrame | None = None,
    capabilities: DataFrame | None = None,
    critical: DataFrame | None = None,
    risks: DataFrame | None = None,
    layers: DataFrame | None = None,
    max_depth: int = T.DEFAULT_DEPTH,
    max_entities: int = T.DEFAULT_ENTITIES,
    max_paths: int = T.DEFAULT_PATHS,
    part: Callable[[Column], Column] | None = None,
) -> Impact:
    """``targets`` (target); ``domains`` and ``capabilities`` (id, member), ``critical`` (id, member, score), ``risks`` (id, member, severity),
    ``layers`` (member, layer).

    The scope of a target is itself and everything impacted. A collection that isn't given scores nothing and is warned of. Of a
    collection the first ``max_entities`` ids count; more are warned of and make its component partial.
    Boundary crossings come from the first ``max_paths`` canonical paths only, as do truncations of paths.
    ``part`` names the part of an id; no edge may lead from one part to another. What a target touches is measured where it is searched, so neither
    scopes nor effects are shuffled or held, unless a part is too large for a task.
    """
    if not 0 <= max_depth <= T.HARD_DEPTH or not 0 < max_entities <= T.HARD_ENTITIES or not 0 <= max_paths <= T.HARD_PATHS:
        raise ValueError(f"bounds beyond {T.HARD_DEPTH} levels, {T.HARD_ENTITIES} entities or {T.HARD_PATHS} paths")
    spark = edges.sparkSession
    starts = targets.select("target").filter("target IS NOT NULL").distinct()
    none = F.lit(None).cast("double")
    given = {
        "domain": None if domains is None else domains.withColumn("value", none), "capability": None if capabilities is None else capabilities.withColumn("value", none),
        "critical": None if critical is None else critical.withColumn("value", F.col("score").cast("double")), "risk": None if risks is None else risks.withColumn("value", weight(F.col("severity")).cast("double")),
        "layer": None if layers is None else layers.select(F.col("layer").alias("id"), "member", none.alias("value")),
    }
    known = [k for k, v in given.items() if v is not None]
    things = [given[k].select(F.lit(i).alias("kind"), "member", "id", "value") for i, k in enumerate(known)]
    packed = parts.gather(T.adjacency(edges, "dependents", once=False), starts, things, part)
    if packed is None:
        nodes, paths, truncations, effects, crossings, out = _by_levels(T.adjacency(edges, "dependents"), starts, given, layers, max_depth, max_entities, max_paths)
    else:
        bounds, own = (max_depth, max_entities), parts.Impacts(known, max_entities, max_paths)
        nodes, paths = parts.nodes(packed, T.NODE[:4], *bounds), parts.paths(packed, max_paths, *bounds)
        truncations = parts.truncations(packed, *bounds, max_paths)
        effects = parts.each_target(packed, "target string, kind string, id string, witness string", own.effect_rows, *bounds)
        crossings = parts.each_target(packed, "target string, from_layer string, to_layer string, dependent string, dependency string", own.crossing_rows, *bounds)
        out = parts.each_target(packed, own.measures(), own.measure_rows, *bounds)
    warnings = spark.createDataFrame([], "target string, warning string")
    for kind, table in given.items():
        label = IMPACT_LABELS[kind]
        if table is None:
            warnings = warnings.unionByName(starts.select("target", F.lit(f"Semantic enrichment incomplete: {label} unavailable").alias("warning")))
        else:
            warnings = warnings.unionByName(out.filter(f"_more_{kind}").select("target", F.lit(f"Semantic enrichment truncated {label} to {max_entities}").alias("warning")))

    # one row per target: counts, what remains of independent exposures, and which components are partial
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in out.columns else F.lit(False)
    saturate = lambda n: n / (n + 1)
    out = out.na.fill(0, ["n_impacted", "n_direct"])
    values = {
        "reach": (F.col("n_impacted").cast("double"), saturate(F.col("n_impacted")), F.lit(False), True), "domain": (zero("_domain"), saturate(zero("_domain")), no("_more_domain"), domains is not None),
        "critical": (zero("_critical"), zero("_pc"), no("_more_critical"), critical is not None), "risk": (zero("_risk"), zero("_pr"), no("_more_risk"), risks is not None),
        "boundary": (zero("_boundary"), saturate(zero("_boundary")), no("_path") | no("_more_layer"), layers is not None),
    }
    rows = []
    for kind, (raw, normalized, partial, known) in values.items():
        status = F.when(no("_structural") | partial, "partial").otherwise("available") if known else F.lit("unavailable")
        part = normalized if known else F.lit(0.0)
        out = out.withColumn(kind, _round2(part * IMPACT_WEIGHTS[kind] * 100))
        rows.append(F.struct(F.lit(kind).alias("kind"), (raw if known else F.lit(0.0)).alias("raw"), part.cast("double").alias("normalized"), F.lit(IMPACT_WEIGHTS[kind]).alias("weight"), F.col(kind).alias("contribution"), status.alias("status")))
    out = out.withColumns({"total": _round2(sum((F.col(c) for c in IMPACT_WEIGHTS), F.lit(0.0))), "_rows": F.array(*rows)})
    scores = out.select("target", "n_impacted", "minimum_depth", "n_direct", *IMPACT_WEIGHTS, "total")
    return Impact(nodes, paths, scores, truncations, effects, crossings, out.select("target", F.inline("_rows")), warnings)


def path_relationships(paths: DataFrame, held: DataFrame) -> DataFrame:
    """(target, id, step, dependent, dependency, type, is_type_only, specifier_count): the relationship of each step of canonical
    paths, out of ``held`` (the rows of ``traverse.relationships``)."""
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1))
    steps = paths.select("target", "id", F.posexplode(pairs).alias("step", "s")).select("target", "id", (F.col("step") + 1).alias("step"), F.col("s.0").alias("at"), F.col("s.1").alias("next"))
    return steps.join(held, ["at", "next"]).select("target", "id", "step", *T.RELATIONSHIP)


def resolve_targets(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """(side, path, target, resolved): each changed path looked up on the side it belongs to.

    ``changes`` (kind, path, previousPath), ``entities`` (side, path, id). Added paths are looked up after, deleted ones
    before, others on both sides (a rename by its old path before).
    """
    sides = F.when(F.col("kind") == "added", F.array(F.lit("after"))).when(F.col("kind") == "deleted", F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))
    each = changes.withColumn("side", F.explode(sides)).withColumn("path", F.when((F.col("side") == "before") & F.col("previousPath").isNotNull(), F.col("previousPath")).otherwise(F.col("path")))
    held = entities.select("side", "path", F.col("id").alias("target"))
    return each.select("side", "path").distinct().join(held, ["side", "path"], "left").withColumn("resolved", F.col("target").isNotNull())


def summarise(i: Impact) -> DataFrame:
    """Union over all targets: distinct impacted ids and the greatest total (null without targets)."""
    a = i.impacted.agg(F.count_distinct("id").alias("n_impacted"), F.count_distinct(F.when(F.col("depth") == 1, F.col("id"))).alias("n_direct"))
    b = i.scores.agg(F.max("total").alias("max_total"), F.count(F.lit(1)).alias("n_targets"))
    return a.select(F.lit(1).alias("_k"), "*").join(b.select(F.lit(1).alias("_k"), "*"), "_k").drop("_k")


def cumulative(i: Impact) -> DataFrame:
    """(kind, id): the union over all targets of what is affected, by category: direct and transitive ids (direct where both), effects of each kind
    and crossings. One row an id, so that no union is gathered."""
    depth = i.impacted.groupBy("id").agg(F.min("depth").alias("depth"))
    ids = depth.select(F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"), "id")
    crossings = i.crossings.select(F.lit("crossing").alias("kind"), F.concat_ws(":", "from_layer", "to_layer", "dependent", "dependency").alias("id"))
    return ids.unionByName(i.effects.select("kind", "id").distinct()).unionByName(crossings.distinct())
