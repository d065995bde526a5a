"""Architecture, risks, scores and impact: golden values."""

import pytest

from strataforge.operators import architecture as A
from strataforge.operators import impact as IM
from strataforge.operators import integrity as U
from strataforge.operators import intelligence as N
from strataforge.operators import knowledge as K
from strataforge.operators import synthesis as S
from tests.conftest import rows

RISK = "repo_id int, id string, type string, severity string, affected array<string>, measured double"


def files(spark, paths, **f):
    return spark.createDataFrame([(1, p, f.get("language", "typescript"), f.get("complexity", 1), f.get("loc", 10), 100) for p in paths], "repo_id int, path string, language string, complexity int, lines_of_code int, size int")


def no_edges(spark):
    return spark.createDataFrame([], "repo_id int, src string, dst string")


@pytest.mark.parametrize(
    ("paths", "pattern", "confidence"),
    [
        (["src/models/a.ts", "src/views/a.ts", "src/controllers/a.ts"], "mvc", 0.84),
        (["src/domain/a.ts", "src/ports/a.ts", "src/adapters/persistence/a.ts"], "hexagonal", 0.9),
        (["src/index.ts", "src/helpers.ts"], "unknown", 0.0),
        (["services/orders/a.ts", "services/users/a.ts", "services/payments/a.ts", "apps/api-gateway/a.ts"], "microservice", 0.82),
        (["src/domain/entities/a.ts", "src/application/use-cases/a.ts", "src/infrastructure/persistence/a.ts", "src/presentation/controllers/a.ts"], "clean", 0.9),
    ],
)
def test_patterns(spark, paths, pattern, confidence):
    got = A.best_pattern(A.score_patterns(A.signals(files(spark, paths), no_edges(spark), ["repo_id"]), ["repo_id"]), ["repo_id"]).collect()
    assert (got[0].pattern, round(got[0].confidence, 3)) == (pattern, confidence) if got else pattern == "unknown"


def test_direction_lifts_confidence(spark):
    f = files(spark, ["src/domain/a.ts", "src/ports/p.ts", "src/adapters/x.ts"])
    e = spark.createDataFrame([(1, "src/adapters/x.ts", "src/ports/p.ts")], "repo_id int, src string, dst string")
    got = A.best_pattern(A.score_patterns(A.signals(f, e, ["repo_id"]), ["repo_id"]), ["repo_id"]).first()
    assert (got.pattern, got.confidence) == ("hexagonal", 0.98)


@pytest.mark.parametrize(("risks", "want"), [([("low", ["a"])], 8), ([("low", ["a"]), ("low", ["b"])], 15), ([("critical", ["a", "b", "c"])], 70), ([("high", ["a", "a"])], 24)])
def test_exposure(spark, risks, want):
    df = spark.createDataFrame([(1, str(i), "t", s, a, 1.0) for i, (s, a) in enumerate(risks)], RISK)
    assert N.risk_exposure(df).first().exposure == want


def test_domains_and_languages(spark):
    rows_ = [("src/components/app.ts", "typescript", 10), ("src/components/view.ts", "typescript", 5), ("lib/logger.ts", "typescript", 7), ("lib/cache.js", "javascript", 78)]
    f = spark.createDataFrame([(1, p, l, 1, n, 1) for p, l, n in rows_], "repo_id int, path string, language string, complexity int, lines_of_code int, size int")
    e = spark.createDataFrame([(1, "src/components/app.ts", "lib/logger.ts")], "repo_id int, src string, dst string")
    assert {r.language: r.percentage for r in S.language_breakdown(f).collect()} == {"javascript": 78.0, "typescript": 22.0}
    assert {r.id: r.lines_of_code for r in S.domains(f).collect()} == {"domain:src": 15, "domain:lib": 85}
    assert rows(S.domain_edges(f, e)) == [(1, "domain:src", "domain:lib")]
    ui = S.capabilities(f).filter("name = 'UI Rendering'").first()
    assert ui.implemented_by == ["file:src/components/app.ts", "file:src/components/view.ts"]


def test_roles(spark):
    want = {"a/b.test.ts": "test", "src/index.ts": "entry-point", "x.d.ts": "type-definition", "app.config.js": "config", "src/services/u.ts": "service", "src/userRepo.ts": "repository", "q.ts": "unknown"}
    f = files(spark, list(want))
    assert {r.path: r.role for r in f.select("path", S.role("path").alias("role")).collect()} == want


def test_risk_rules_and_nulls(spark):
    f = spark.createDataFrame([(1, "a", 45, 1200), (1, "b", None, None), (1, "c", 20, 500), (2, "solo", 1, 1)], "repo_id int, path string, complexity int, lines_of_code int")
    e = spark.createDataFrame([(1, "a", "c")], "repo_id int, src string, dst string")
    assert rows(K.high_complexity(f), "affected", "severity") == [(["a"], "critical"), (["c"], "medium")]
    assert rows(K.large_file(f), "affected", "severity") == [(["a"], "high"), (["c"], "medium")]
    assert rows(K.orphan_files(f, e), "affected") == [(["b"],)]  # a repository of one file has no orphans
    assert K.high_complexity(f.limit(0)).count() == 0


def test_naming_and_tests(spark):
    f = files(spark, ["a/one-two.ts", "a/three-four.ts", "a/five-six.test.ts", "a/index.ts", "a/X.ts"])
    got = K.naming_convention(f).first()
    assert (got.style, got.n, got.total, got.percentage) == ("kebab-case", 3, 4, 75.0)
    assert K.test_layout(f).first().style == "co-located"


FIX = {"chain": [("A", "B"), ("B", "C")], "fan-out": [("A", "B"), ("A", "C"), ("A", "D")], "fan-in": [("A", "X"), ("B", "X"), ("C", "X")], "cycle": [("A", "B"), ("B", "C"), ("C", "A")]}


@pytest.mark.parametrize(("name", "target", "impacted", "total"), [("chain", "C", {"A": 2, "B": 1}, 23.33), ("fan-out", "B", {"A": 1}, 17.5), ("fan-in", "X", {"A": 1, "B": 1, "C": 1}, 26.25), ("cycle", "A", {"B": 2, "C": 1}, 23.33)])
def test_impact_golden(spark, name, target, impacted, total):
    i = IM.impact(spark.createDataFrame(FIX[name], "src string, dst string"), spark.createDataFrame([(target,)], "target string"))
    assert {r.id: r.depth for r in i.impacted.collect()} == impacted
    assert i.scores.first().total == total


def test_impact_semantics(spark):
    e, t = spark.createDataFrame(FIX["chain"], "src string, dst string"), spark.createDataFrame([("C",)], "target string")
    dom = spark.createDataFrame([("d1", "A"), ("d2", "B")], "id string, member string")
    crit = spark.createDataFrame([("k", "B", 0.75)], "id string, member string, score double")
    risk = spark.createDataFrame([("r", "B", "high")], "id string, member string, severity string")
    lay = spark.createDataFrame([("A", "application"), ("B", "application"), ("C", "presentation")], "member string, layer string")
    one = lambda **k: IM.impact(e, t, **k).scores.first().total
    assert one(domains=dom) == 33.33 and one(critical=crit) == 42.08 and one(risks=risk) == 33.83 and one(layers=lay) == 28.33
    assert one(domains=dom, critical=crit, risks=risk, layers=lay) == 67.58
    cut = IM.impact(e, t, max_entities=1)
    assert cut.scores.first().total == 17.5 and rows(cut.truncations, "kind", "at") == [("max-entities", "A")]
    assert IM.summarise(cut).first().max_total == 17.5


def test_health_without_entities(spark):
    ents = spark.createDataFrame([], "repo_id int, path string, complexity int, depends_on array<string>, depended_on_by array<string>, importance double")
    none = spark.createDataFrame([], "repo_id int, confidence double, n_layers int"), spark.createDataFrame([], "repo_id int, exposure int")
    assert N.health(ents, *none).count() == 0 and N.critical_components(ents).count() == 0


def test_integrity_and_recovery(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    v = U.violations([U.duplicates(e, ["id"], "unique"), U.dangling(spark.createDataFrame([("x",)], "id string"), e, ["id"], "known")])
    assert rows(v) == [("known", "x"), ("unique", "a")]
    rec = spark.createDataFrame([(1, 1, "a", True), (1, 1, "b", True), (1, 2, "a", True), (1, 3, "a", True), (1, 3, "b", False)], "repo_id int, version int, namespace string, readable boolean")
    status = U.recovery_status(rec, ["a", "b"])
    assert {r.version: r.status for r in status.collect()} == {1: "valid", 2: "cleanup", 3: "quarantine"} and U.recovered(status).first().version == 1
