"""Queries of change streams and state differences, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import diffs as D
from strataforge.plans import inputs as I
from strataforge.plans.inputs import BASE
from strataforge.rules import HEALTH_WEIGHTS
from strataforge.runtime import table
from strataforge.streaming import changes as W


def _changes(s: SparkSession, d: str) -> DataFrame:
    """User events as changes of a path; one epoch per ten days."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return e.select(F.concat(F.lit("file-"), "user_id").alias("path"), kind.alias("kind"), F.floor(F.dayofmonth("ts") / 10).cast("int").alias("epoch"), F.col("event_id").alias("sequence"), F.col("ts").alias("at"))


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Versions 1 and the newest full one of each repository."""
    st, snap = table(s, d, "entity_states"), table(s, d, "snapshots").filter("is_full_snapshot")
    first = snap.groupBy("repo_id").agg(F.min("version").alias("version"))
    cols = "kind entity_name path architecture_role criticality complexity risks depends_on belongs_to_domain belongs_to_layer".split()
    before = st.join(first, ["repo_id", "version"]).groupBy("repo_id", "entity_id").agg(F.max_by(F.struct(*cols), "ingested_at").alias("h")).select("repo_id", "entity_id", *[f"h.{c}" for c in cols])
    newest = snap.groupBy("repo_id").agg(F.max("version").alias("version"))
    after = st.join(newest, ["repo_id", "version"]).groupBy("repo_id", "entity_id").agg(F.max_by(F.struct(*cols), "ingested_at").alias("h")).select("repo_id", "entity_id", *[f"h.{c}" for c in cols])
    return before, after


KEY = ["repo_id", "entity_id"]
COLS = "architecture_role criticality complexity risks depends_on belongs_to_domain belongs_to_layer".split()


def _summary(s: SparkSession, d: str) -> DataFrame:
    """A summary row of each full version, out of its entities."""
    st = table(s, d, "entity_states").join(table(s, d, "snapshots").filter("is_full_snapshot").select("repo_id", "version").distinct(), ["repo_id", "version"])
    cols = "complexity criticality risks depends_on belongs_to_domain belongs_to_layer path architecture_role".split()
    held = st.groupBy("repo_id", "version", "entity_id").agg(F.max_by(F.struct(*cols), "ingested_at").alias("h")).select("repo_id", "version", *[f"h.{c}" for c in cols])
    whole = lambda x: F.floor(x + 0.5).cast("double")
    n_risks, n_deps = F.size("risks"), F.size("depends_on")
    out = held.groupBy("repo_id", "version").agg(
        whole(F.count("belongs_to_layer") / F.count(F.lit(1)) * 100).alias("health_architecture"), whole(F.greatest(F.lit(0.0), 100 - F.avg(n_deps) * 5)).alias("health_dependency"),
        whole(F.greatest(F.lit(0.0), 100 - F.avg("complexity") * 2)).alias("health_complexity"), F.lit(0.0).alias("health_knowledge"), whole(F.greatest(F.lit(0.0), 100 - F.avg(n_risks) * 10)).alias("health_risk"),
        (F.floor(F.avg("complexity") * 100 + 0.5) / 100).alias("complexity_average"), F.max("complexity").alias("complexity_max"), (F.floor(F.avg((n_deps > 0).cast("int")) * 100 + 0.5) / 100).alias("complexity_instability"),
        whole(100 * (1 - F.exp(-F.sum(n_risks) * 4 / 25))).alias("risk_overall"), F.sum(n_risks).alias("risk_total"), F.count_if((n_risks > 0) & (F.col("criticality") == "critical")).alias("risk_critical"),
        F.count(F.lit(1)).alias("entities_total"), F.count_distinct(F.regexp_replace("path", "/?[^/]*$", "")).alias("modules_total"), F.count_distinct("belongs_to_domain").alias("domains_total"),
        F.count_distinct("belongs_to_layer").alias("capabilities_total"), F.lit(0).alias("knowledge_total"), F.count_if(F.col("criticality") == "critical").alias("critical_total"), F.lit(0).alias("duration_ms"),
    )
    return out.withColumn("health_overall", whole(sum((F.col(f"health_{n}") * w for n, w in HEALTH_WEIGHTS.items()), F.lit(0.0))))


def _hashed(s: SparkSession, d: str) -> DataFrame:
    best = F.when(F.col("capabilities_total") > 3, "layered").otherwise("unknown")
    row = _summary(s, d).select("repo_id", "version", F.concat(F.lit('dna "'), F.col("repo_id").cast("string"), F.lit('"')).alias("id"), F.col("entities_total").alias("entity_count"), F.col("modules_total").alias("module_count"), (F.col("health_overall") / 4).alias("health_score"), best.alias("architecture"))
    return D.snapshot_hash(row).select("repo_id", "version", "hash")


def _diffs(s: SparkSession, d: str) -> DataFrame:
    out = D.version_diff(D.snapshot_metrics(_summary(s, d)))
    each = [F.element_at("dimension_deltas", n).alias(f"d_{n}") for n in HEALTH_WEIGHTS]
    return out.select("repo_id", "from_version", "to_version", "health_delta", *each, F.round("significance", 9).alias("significance"))


QUERIES = {
    "change_kind_fold": lambda s, d: W.fold_changes(_changes(s, d)),
    "sequence_dedupe": lambda s, d: W.accepted(_changes(s, d).withColumn("epoch", (F.col("sequence") * 7919 % 3).cast("int")), ["path"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last")),
    "debounce_sessions": lambda s, d: W.debounced(_changes(s, d), ["kind"], 600_000),
    "debounce_flushes": lambda s, d: W.flushed(_changes(s, d), ["kind"], 600_000, 3_600_000),
    "overflow_epochs": lambda s, d: W.overflows(_changes(s, d), ["kind"], 100),
    "state_added_removed": lambda s, d: D.added_removed_kept(*_two(s, d), KEY),
    "state_changes": lambda s, d: D.diff_by_key(*_two(s, d), KEY, COLS),
    "field_changes": lambda s, d: D.field_changes(*_two(s, d), KEY, COLS).groupBy("repo_id", "field").agg(F.count(F.lit(1)).alias("n")),
    "membership_changes": lambda s, d: D.membership_changes(*_two(s, d), KEY, "architecture_role"),
    "edge_changes": lambda s, d: D.added_removed_kept(*[x.select("repo_id", "entity_id", F.explode("depends_on").alias("dep")) for x in _two(s, d)], ["repo_id", "entity_id", "dep"]),
    "state_hash": lambda s, d: D.state_hash(_two(s, d)[1], ["repo_id"]),
    "snapshot_metrics": lambda s, d: D.snapshot_metrics(_summary(s, d)).select("repo_id", "version", F.explode("metrics").alias("metric", "value")),
    "version_diff": _diffs,
    "history": lambda s, d: D.history(table(s, d, "snapshots").select("repo_id", "version", "trigger_kind"), 3),
    "snapshot_hash": _hashed,
}

_CH = """WITH ch AS (SELECT 'file-' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, CAST(floor(day(ts) / 10) AS INTEGER) AS epoch, event_id AS sequence, ts AS tm FROM events)"""
_HELD = lambda agg: f"""SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.repo_id, e.entity_id ORDER BY e.ingested_at DESC) AS rn FROM entity_states e JOIN (SELECT repo_id, {agg}(version) AS version FROM snapshots WHERE is_full_snapshot GROUP BY repo_id) n ON e.repo_id = n.repo_id AND e.version = n.version) WHERE rn = 1"""
_TWO = f"WITH a AS ({_HELD('min')}), b AS ({_HELD('max')})"
_norm = lambda t, c: f"list_sort({t}.{c})" if c in ("risks", "depends_on") else f"{t}.{c}"
_MET = """WITH held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, version, entity_id ORDER BY ingested_at DESC) AS rn FROM entity_states SEMI JOIN (SELECT repo_id, version FROM snapshots WHERE is_full_snapshot) s USING (repo_id, version)) WHERE rn = 1),
dims AS (SELECT repo_id, version, floor(count(belongs_to_layer) / count(*) * 100 + 0.5) AS architecture, floor(greatest(0, 100 - avg(len(depends_on)) * 5) + 0.5) AS dependency, floor(greatest(0, 100 - avg(complexity) * 2) + 0.5) AS complexity, 0 AS knowledge,
  floor(greatest(0, 100 - avg(len(risks)) * 10) + 0.5) AS risk, avg(complexity) AS ac, max(complexity) AS mc, avg(CASE WHEN len(depends_on) > 0 THEN 1 ELSE 0 END) AS ins, sum(len(risks)) AS nr, count(*) FILTER (WHERE len(risks) > 0 AND criticality = 'critical') AS rc,
  count(*) AS ne, count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) AS nm, count(DISTINCT belongs_to_domain) AS nd, count(DISTINCT belongs_to_layer) AS nl, count(*) FILTER (WHERE criticality = 'critical') AS nc FROM held GROUP BY repo_id, version),
m AS (SELECT *, floor(architecture * 0.25::DOUBLE + dependency * 0.2::DOUBLE + complexity * 0.25::DOUBLE + knowledge * 0.15::DOUBLE + risk * 0.15::DOUBLE + 0.5) AS overall FROM dims)"""
_METRICS = {
    "health.overall": "overall", "health.architecture": "architecture", "health.dependency": "dependency", "health.complexity": "complexity", "health.knowledge": "knowledge", "health.risk": "risk",
    "complexity.average": "floor(ac * 100 + 0.5) / 100", "complexity.max": "mc", "complexity.instability": "floor(ins * 100 + 0.5) / 100", "risk.overall": "floor(100 * (1 - exp(-nr * 4 / 25)) + 0.5)", "risk.total": "nr", "risk.critical": "rc",
    "entities.total": "ne", "modules.total": "nm", "domains.total": "nd", "capabilities.total": "nl", "knowledge.total": "0", "critical.total": "nc", "duration.ms": "0",
}
_MERGE = "CASE WHEN p = 'none' THEN k WHEN p = 'created' THEN CASE WHEN k = 'deleted' THEN 'none' ELSE 'created' END ELSE CASE WHEN k = 'deleted' THEN 'deleted' ELSE 'modified' END END"

SQL = {
    "change_kind_fold": _CH + f", f AS (SELECT path, list_reduce(list_prepend('none', list(kind ORDER BY sequence)), lambda p, k: {_MERGE}) AS kind FROM ch GROUP BY path) SELECT * FROM f WHERE kind <> 'none'",
    "sequence_dedupe": _CH
    + """, c AS (SELECT path, CAST(sequence * 7919 % 3 AS INTEGER) AS epoch, sequence, tm FROM ch), w AS (SELECT *, max(epoch) OVER (PARTITION BY path ORDER BY tm, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
      max(sequence) OVER (PARTITION BY path, epoch ORDER BY tm, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM c) SELECT path, count(*) AS n, max(sequence) AS last FROM w WHERE (e IS NULL OR epoch >= e) AND (s IS NULL OR sequence > s) GROUP BY path""",
    "debounce_sessions": _CH
    + """, g AS (SELECT kind, tm, CASE WHEN tm - lag(tm) OVER (PARTITION BY kind ORDER BY tm) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM ch), h AS (SELECT kind, tm, sum(fresh) OVER (PARTITION BY kind ORDER BY tm ROWS UNBOUNDED PRECEDING) AS n FROM g)
      SELECT kind, min(tm) AS started, max(tm) AS ended, count(*) AS n FROM h GROUP BY kind, h.n""",
    "debounce_flushes": _CH.replace("WITH ch", "WITH RECURSIVE ch", 1)
    + """, g AS (SELECT kind, epoch_ms(tm) AS t, tm, CASE WHEN epoch_ms(tm) - lag(epoch_ms(tm)) OVER (PARTITION BY kind ORDER BY tm) < 600000 THEN 0 ELSE 1 END AS fresh FROM ch), h AS (SELECT kind, t, tm, sum(fresh) OVER (PARTITION BY kind ORDER BY tm ROWS UNBOUNDED PRECEDING) AS s FROM g),
      starts AS (SELECT kind, s, min(t) AS t FROM h GROUP BY kind, s UNION ALL SELECT kind, s, (SELECT min(h.t) FROM h WHERE h.kind = starts.kind AND h.s = starts.s AND h.t >= starts.t + 3600000) FROM starts WHERE t IS NOT NULL),
      parts AS (SELECT h.kind, h.tm, (SELECT max(x.t) FROM starts x WHERE x.kind = h.kind AND x.s = h.s AND x.t <= h.t) AS start FROM h) SELECT kind, min(tm) AS started, max(tm) AS ended, count(*) AS n FROM parts GROUP BY kind, start""",
    "overflow_epochs": _CH + " SELECT kind, epoch, count(DISTINCT path) AS n_paths, count(DISTINCT path) > 100 AS overflow FROM ch GROUP BY kind, epoch",
    "state_added_removed": _TWO + " SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed' ELSE 'kept' END AS side FROM a FULL OUTER JOIN b ON a.repo_id = b.repo_id AND a.entity_id = b.entity_id",
    "state_changes": _TWO
    + f", z AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed' WHEN {' OR '.join(f'{_norm("a", c)} IS DISTINCT FROM {_norm("b", c)}' for c in COLS)} THEN 'modified' END AS change FROM a FULL OUTER JOIN b ON a.repo_id = b.repo_id AND a.entity_id = b.entity_id) SELECT * FROM z WHERE change IS NOT NULL",
    "field_changes": _TWO
    + ", z AS ("
    + " UNION ALL ".join(f"SELECT a.repo_id, '{c}' AS field FROM a JOIN b ON a.repo_id = b.repo_id AND a.entity_id = b.entity_id WHERE {_norm('a', c)} IS DISTINCT FROM {_norm('b', c)}" for c in COLS)
    + ") SELECT repo_id, field, count(*) AS n FROM z GROUP BY repo_id, field",
    "membership_changes": _TWO + " SELECT a.repo_id, a.entity_id, a.architecture_role AS before, b.architecture_role AS after FROM a JOIN b ON a.repo_id = b.repo_id AND a.entity_id = b.entity_id WHERE a.architecture_role IS DISTINCT FROM b.architecture_role",
    "edge_changes": _TWO
    + ", x AS (SELECT DISTINCT repo_id, entity_id, unnest(depends_on) AS dep FROM a), y AS (SELECT DISTINCT repo_id, entity_id, unnest(depends_on) AS dep FROM b) SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.entity_id, y.entity_id) AS entity_id, coalesce(x.dep, y.dep) AS dep, CASE WHEN x.dep IS NULL THEN 'added' WHEN y.dep IS NULL THEN 'removed' ELSE 'kept' END AS side FROM x FULL OUTER JOIN y ON x.repo_id = y.repo_id AND x.entity_id = y.entity_id AND x.dep = y.dep",
    "snapshot_metrics": _MET + " UNION ALL ".join(f" SELECT repo_id, version, '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM m" for k, v in _METRICS.items()),
    "version_diff": _MET
    + """, p AS (SELECT a.*, b.version AS pv, b.overall AS po, b.architecture AS pa, b.dependency AS pp, b.complexity AS pc, b.risk AS pr, b.ne AS pe, b.nd AS pd FROM m a ASOF JOIN m b ON a.repo_id = b.repo_id AND a.version > b.version)
      SELECT repo_id, pv AS from_version, version AS to_version, CAST(overall - po AS DOUBLE) AS health_delta, CAST(architecture - pa AS DOUBLE) AS d_architecture, CAST(dependency - pp AS DOUBLE) AS d_dependency, CAST(complexity - pc AS DOUBLE) AS d_complexity, 0::DOUBLE AS d_knowledge, CAST(risk - pr AS DOUBLE) AS d_risk,
      round(least(1.0::DOUBLE, least(1.0, abs(ne - pe) / greatest(1, pe)) * 0.4::DOUBLE + CASE WHEN nd <> pd THEN 0.15::DOUBLE ELSE 0 END + least(1.0, abs(overall - po) / 20) * 0.3::DOUBLE), 9) AS significance FROM p""",
    "history": "SELECT * FROM (SELECT repo_id, version, trigger_kind, lag(version) OVER (PARTITION BY repo_id ORDER BY version) AS parent_version, row_number() OVER (PARTITION BY repo_id ORDER BY version DESC) AS place FROM snapshots) WHERE place <= 3",
    "snapshot_hash": _MET
    + """ SELECT repo_id, version, sha256('{"id":"dna \\"' || repo_id || '\\"","version":' || version || ',"entityCount":' || ne || ',"moduleCount":' || nm || ',"healthScore":' || CASE WHEN overall % 4 = 0 THEN CAST(CAST(overall / 4 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(overall / 4 AS DOUBLE) AS VARCHAR) END
      || ',"architecture":"' || CASE WHEN nl > 3 THEN 'layered' ELSE 'unknown' END || '"}')[1:16] AS hash FROM m""",
}
