"""Risk queries over all edges and exports, on fixtures."""

from strataforge.plans import analysis
from strataforge.plans import inputs as I
from tests.conftest import rows

RAW = "src string, dst string, type string, is_type_only boolean, specifier_count int, is_external boolean"


def _raw(spark, monkeypatch):
    """``barrel``: 16 re-exports; ``mixed``: 16 re-exports and a named export; ``busy``: 9 imports out, 9 other edges in; ``spread``: 8 edges out of other types than import."""
    held = [("barrel", f"x{i}", "re-export") for i in range(16)] + [("mixed", f"x{i}", "re-export") for i in range(16)] + [("mixed", "y", "require")]
    held += [("busy", f"x{i}", "import") for i in range(9)] + [(f"x{i}", "busy", "require") for i in range(9)] + [("spread", f"x{i}", "require") for i in range(8)]
    raw = spark.createDataFrame([(s, d, t, False, 1, False) for s, d, t in held], RAW)
    monkeypatch.setattr(I, "raw_edges", lambda s, d: raw)


def test_unstable_over_all_edges(spark, monkeypatch):
    _raw(spark, monkeypatch)
    got = {r.affected[0] for r in analysis.QUERIES["risk_unstable_whole"](spark, "").collect()}
    assert got == {"barrel", "mixed", "spread"}  # not busy, half of whose edges come in


def test_barrels_have_re_exports_only(spark, monkeypatch):
    _raw(spark, monkeypatch)
    assert rows(analysis.QUERIES["barrel_pattern_whole"](spark, "")) == [(1, 1, 16)]
    assert rows(analysis.QUERIES["risk_barrel_whole"](spark, ""), "affected", "measured") == [(["barrel"], 16.0)]


def test_all_risks_hold_cycles_and_excessive_imports(spark, monkeypatch):
    paths = ["a.ts", "b.ts", *[f"x{i}.ts" for i in range(20)]]
    files = spark.createDataFrame([(1, p, "typescript", 1, 10, 100) for p in paths], "repo_id int, path string, language string, complexity int, lines_of_code int, size int")
    edges = spark.createDataFrame([(1, "a.ts", p) for p in paths[1:]] + [(1, "b.ts", "a.ts")], "repo_id int, src string, dst string")
    monkeypatch.setattr(I, "repo_files", lambda s, d: files)
    monkeypatch.setattr(I, "repo_edges", lambda s, d: edges)
    monkeypatch.setattr(analysis, "_exports", lambda s, d: None)
    got = rows(analysis.QUERIES["all_risks"](spark, ""), "type", "affected")
    assert got == [("circular-dependency", ["a.ts", "b.ts"]), ("excessive-imports", ["a.ts"]), ("unstable-module", ["a.ts"])]
