"""Scan, parse, git, store and the facade on real directories."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from strataforge.operators import integrity as U
from strataforge.repository import Repository
from strataforge.sources import gitio, parse, scan
from strataforge.sources.store import Conflict, Store
from tests.conftest import rows


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=n", *args], check=True, capture_output=True)
    return subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, text in {
        "package.json": json.dumps({"name": "x", "version": "1.0.0", "dependencies": {"react": "18"}, "devDependencies": {"vue": 3}}), "pnpm-lock.yaml": "", "README.md": "hi", ".gitignore": "# c\nsecret.ts\n",
        "src/a.ts": "import { b } from './b';\nexport const a = () => b;\n", "src/b.ts": "import { c } from './c';\nexport const b = 1;\n\n", "src/c.ts": "export const c = 2;\n", "secret.ts": "x", "node_modules/m/i.js": "x", "src/my file+1.py": "def f():\n    return 1\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan(spark, tree):
    m = scan.scan(spark, str(tree))
    m = spark.createDataFrame(m.collect(), m.schema)  # held apart from the directory
    got = {r.relativePath: (r.language, r.analyzable, r.linesOfCode) for r in m.collect()}
    assert got["src/b.ts"] == ("typescript", True, 2) and got["src/my file+1.py"] == ("python", True, 2) and got["README.md"] == (None, False, 0)
    assert not {"secret.ts", "node_modules/m/i.js", "pnpm-lock.yaml"} & got.keys()
    row = scan.repository_row(spark, str(tree), m).first()
    assert (row.packageManager, row.hasReadme, row.version, row.frameworks) == ("pnpm", True, "1.0.0", ["React"])
    (tree / "src/c.ts").unlink()
    (tree / "src/b.ts").write_text("x\ny\nz\n")
    n = scan.scan_incremental(spark, str(tree), m, ["src/c.ts", "src/b.ts"])
    after = {r.relativePath: r.linesOfCode for r in n.collect()}
    assert after["src/b.ts"] == 3 and "src/c.ts" not in after and after.keys() == {r.relativePath for r in scan.scan(spark, str(tree)).collect()}
    assert scan.needs_full_scan(m, ["package.json"], str(tree)) and scan.needs_full_scan(m, ["src"], str(tree)) and scan.needs_full_scan(None, [], str(tree))


def test_json_config(tmp_path):
    p = tmp_path / "tsconfig.json"
    p.write_text('{ // c\n "a": "http://x", /* d */ "b": [1,2,],\n}')
    assert scan.read_json_config(str(p), True) == {"a": "http://x", "b": [1, 2]} and scan.read_json_config(str(tmp_path / "none")) is None
    p.write_text("[]")
    with pytest.raises(ValueError):
        scan.read_json_config(str(p))


def test_parse_languages(spark):
    src = {
        ("a.ts", "typescript"): "import x, { y as z } from './m';\nexport class K extends B implements I { m() { if (a) {} } }\nexport default x;\n",
        ("a.py", "python"): "import os\nfrom .m import q as r\nclass C(B):\n    z = 1\n    def m(self): pass\ndef f(a, b=1):\n    '''Doc.'''\n    if a: pass\n    elif b: pass\n    for _ in b: pass\nX = 1\n_y = 2\n",
        ("a.go", "go"): 'package p\nimport (\n\t"fmt"\n)\ntype S struct { A int }\nfunc (s *S) M() {}\nfunc Run(a int) error { if a > 1 { return nil }; return nil }\n',
        ("A.java", "java"): "package p;\nimport java.util.List;\npublic class A extends B implements C, D { private int n; public A() {} int m(int x) { return x > 0 ? 1 : 2; } }\n",
        ("a.rs", "rust"): "use std::io;\npub struct S { a: i32 }\nimpl S { pub fn m(&self) {} }\npub fn run(x: i32) { match x { _ => {} } }\n",
        ("A.cs", "csharp"): "using System;\npublic class A : B, I { private int n; public void M(int x) { foreach (var y in z) {} } }\n",
        ("a.zz", "zz"): "x", ("n.py", "python"): None, ("bad.py", "python"): "def (",
    }
    out = {r.path: r for r in parse.parse(spark.createDataFrame([(p, l, t) for (p, l), t in src.items()], "path string, language string, content string")).collect()}
    assert [(i.source, [s.name for s in i.specifiers]) for i in out["a.ts"].imports] == [("./m", ["x", "y"])] and out["a.ts"].classes[0].implements == ["I"]
    assert [(e.name, e.type) for e in out["a.ts"].exports] == [("K", "named"), ("x", "default"), ("default", "default")]
    py = out["a.py"]
    assert py.functions[0].complexity == 3 and py.functions[0].docComment == "Doc." and sorted(e.name for e in py.exports) == ["C", "X", "f"] and py.classes[0].properties == ["z"]
    assert out["a.go"].classes[0].methods == ["M"] and [f.name for f in out["a.go"].functions] == ["Run"] and out["a.go"].complexity == 2
    assert out["A.java"].classes[0].implements == ["C", "D"] and out["A.java"].complexity == 2 and out["A.java"].imports[0].source == "java.util.List"
    assert out["a.rs"].classes[0].methods == ["m"] and [f.name for f in out["a.rs"].functions] == ["run"]
    assert out["A.cs"].classes[0].extends == "B" and out["A.cs"].complexity == 2
    assert out["a.zz"].error.startswith("unsupported") and out["n.py"].error is None and out["bad.py"].error.startswith("SyntaxError")


def test_parse_incremental(spark):
    s = "path string, language string, content string"
    old = parse.parse(spark.createDataFrame([("a.py", "python", "x = 1"), ("b.py", "python", "y = 1")], s)).cache()
    new = parse.parse_incremental(spark.createDataFrame([("a.py", "python", "x = 1"), ("b.py", "python", "z = 1"), ("c.py", "python", "")], s), old)
    assert {r.path: [e.name for e in r.exports] for r in new.collect()} == {"a.py": ["x"], "b.py": ["z"], "c.py": []}
    assert tuple(parse.coverage(spark.createDataFrame([("a.py",), ("q.zz",)], "path string"), parse.parse(spark.createDataFrame([("a.py", "python", "x"), ("q.zz", "zz", "")], s))).first()) == (2, 1, 1, 0)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.apply([("save", "n", "b", 1), ("save", "n", "a/x", {"k": [1]})], [("missing", "n", "b")])
    assert s.list("n") == ["a/x", "b"] and s.load("n", "a/x") == {"k": [1]}
    with pytest.raises(Conflict):
        s.apply([("save", "n", "b", 2)], [("equals", "n", "b", 5)])
    with pytest.raises(ValueError):
        s.apply([("save", "n", "b", 2), ("delete", "n", "b", None)])
    with pytest.raises(ValueError):
        s.apply([("save", "n", "c", 2), ("save", "n", "d", float("nan"))])
    assert s.load("n", "b") == 1 and not s.exists("n", "c")
    df = spark.createDataFrame([(1,)], "x int")
    s.publish("r", 1, {"t": df}, None)
    s.publish("r", 2, {"t": df.union(df)}, 1)
    with pytest.raises(Conflict):
        s.publish("r", 3, {"t": df}, 1)
    assert s.latest("r") == 2 and s.read("r", "t").count() == 2
    (tmp_path / "s/tables/r/v00000003/manifest.json").unlink()
    (tmp_path / "s/tables/r/v00000002/manifest.json").write_text("{broken")
    assert s.recover("r") == 1 and s.versions("r") == [1] and (tmp_path / "s/quarantine/r/v00000002").exists()


def test_git_and_facade(spark, tree, tmp_path):
    git(tree, "init", "-q")
    git(tree, "add", "-A")
    first = git(tree, "commit", "-qm", "one")
    repo = Repository(spark, str(tree), str(tmp_path / "store"))
    assert repo.analyse() == 1 and repo.analyse() == 1  # unchanged
    assert rows(repo.table("edges"), "src", "dst") == [("src/a.ts", "src/b.ts"), ("src/b.ts", "src/c.ts")]
    assert repo.violations().count() == 0
    names = ["files", "nodes", "edges", "cycles", "entities", "risks", "domains", "capabilities", "layers", "architecture", "semantic_nodes", "semantic_edges", "critical", "complexity", "risk_assessment", "health"]
    held = {n: repo.table(n) for n in names}
    held["entities"] = held["entities"].filter("id <> 'file:src/b.ts'")
    held["health"] = held["health"].withColumn("overall", F.lit(3))
    wrong = {r.rule for r in U.suite(held).collect()}
    assert {"dependency-known", "dependency-reciprocal", "file-is-entity", "health-follows", "complexity-follows"} <= wrong
    assert {r.id: r.depth for r in repo.impact(["src/c.ts"]).impacted.collect()} == {"src/a.ts": 2, "src/b.ts": 1}
    (tree / "src/c.ts").write_text("export const c = 3;\n")
    (tree / "src/d.ts").write_text("import { c } from './c';\n")
    w = gitio.working_tree_changes(spark, str(tree))
    assert rows(w, "kind", "path", "untracked") == [("added", "src/d.ts", True), ("modified", "src/c.ts", False)]
    resolved, impact = repo.working_tree_impact()
    assert impact.scores.first().target == "src/c.ts" and resolved.filter("NOT resolved").count() == 1
    assert repo.refresh(["src/c.ts", "src/d.ts"]) == 2
    full = repo.table("edges").select("src", "dst")
    assert rows(full) == [("src/a.ts", "src/b.ts"), ("src/b.ts", "src/c.ts"), ("src/d.ts", "src/c.ts")]
    d = repo.diff(1, 2)
    assert rows(d["relationships"], "src", "dst", "side") == [("src/d.ts", "src/c.ts", "added")] and ("file:src/d.ts", "added") in rows(d["entities"])
    git(tree, "add", "-A")
    git(tree, "mv", "src/b.ts", "src/bb.ts")
    second = git(tree, "commit", "-qm", "two")
    c = gitio.commit_changes(spark, str(tree), second)
    assert rows(c, "kind", "path") == [("added", "src/d.ts"), ("modified", "src/c.ts"), ("renamed", "src/bb.ts")] and gitio.commit_parents(str(tree), second) == [first]
    assert gitio.range_changes(spark, str(tree), first, second).count() == 3
    assert gitio.commit_changes(spark, str(tree), first).count() > 5  # against the empty tree
    with pytest.raises(gitio.GitError):
        gitio.commit_changes(spark, str(tree), second, "0" * 40)
    resolved, sides = repo.commit_impact(second, max_depth=2)
    assert {r.id for r in sides["before"].impacted.filter("target = 'src/c.ts'").collect()} == {"src/a.ts", "src/b.ts"}
    assert {r.id for r in sides["after"].impacted.filter("target = 'src/c.ts'").collect()} == {"src/bb.ts", "src/d.ts"}
    assert repo.restore() == 2 and repo.history(1) == [2] and repo.entities(limit=1).count() == 1


def test_refresh_equals_a_full_run(spark, tree, tmp_path):
    """Only the files that are named are read; the tables are those of a full analysis."""
    from strataforge.operators import diffs as D

    def hashes(repo):
        names = ["files", "edges", "entities", "risks", "health", "semantic_edges"]
        return {n: [tuple(r) for r in D.state_hash(repo.table(n), ["repo_id"]).collect()] for n in names}

    repo = Repository(spark, str(tree), str(tmp_path / "one"))
    repo.analyse()
    hidden = (tree / "src/b.ts").read_text()
    (tree / "src/b.ts").write_text("this isn't read")
    (tree / "src/c.ts").write_text("import { a } from './a';\nexport const c = a ? 1 : 2;\n")
    assert repo.refresh(["src/c.ts"]) == 2
    (tree / "src/b.ts").write_text(hidden)
    full = Repository(spark, str(tree), str(tmp_path / "two"))
    full.analyse()
    assert hashes(repo) == hashes(full)
    assert rows(repo.table("dirty")) == [("src/a.ts",), ("src/b.ts",), ("src/c.ts",)]
    assert repo.refresh(["src/c.ts"]) == 2  # unchanged
    _errors_and_overview(repo, tree)
    (tree / "src/[x].ts").write_text("import './b';\n")
    (tree / "src/a.ts").unlink()
    assert repo.refresh(["src/[x].ts", "src/a.ts"]) == 3
    assert rows(repo.table("edges"), "src", "dst") == [("src/[x].ts", "src/b.ts"), ("src/b.ts", "src/c.ts")]


def _errors_and_overview(repo, tree):
    from strataforge.operators.impact import StaleAnalysis, guard

    with pytest.raises(LookupError, match="missing"):
        repo.impact(["src/none.ts"])
    with pytest.raises(StaleAnalysis):
        repo.impact(["src/c.ts"], expected_version=3)
    for wrong in (("", 1, "", 1), ("r", -1, "r", -1), ("r", 1, "r", 1, True)):
        with pytest.raises(ValueError):
            guard(*wrong)
    for stale in (("r", 1, "q", 1), ("r", 1, "r", 2)):
        with pytest.raises(StaleAnalysis):
            guard(*stale)
    seen = repo.overview()
    assert seen["health"].count() == 1 and seen["story"].first().summary.startswith(tree.name + " is a tiny ")
    assert repo.identity().first().project_type in ("library", "unknown", "application", "service", "monorepo") and set(repo.knowledge()) >= {"naming", "barrels"}


def test_store_survives_a_crash(spark, tmp_path):
    import json
    import os
    import socket
    import subprocess

    s = Store(spark, str(tmp_path / "s"))
    s.apply([("save", "n", "a", 1), ("save", "n", "b", 1)])
    dead = subprocess.Popen(["true"])
    dead.wait()
    (tmp_path / "s/.lock").write_text(f"{socket.gethostname()} {dead.pid}")  # its process died after the first of two keys
    (tmp_path / "s/.journal").write_text(json.dumps([["kv/n/a.json", "2"], ["kv/n/b.json", "2"], ["kv/n/c.json", None]]))
    (tmp_path / "s/kv/n/a.json").write_text("2")
    assert s.load("n", "b") == 2 and s.load("n", "a") == 2 and not (tmp_path / "s/.journal").exists() and not (tmp_path / "s/.lock").exists()
    df = spark.createDataFrame([(1,), (2,)], "x int").repartition(2)
    s.publish("r", 1, {"t": df}, None)
    assert s.valid("r", 1)
    part = sorted((tmp_path / "s/tables/r/v00000001/t").glob("*.parquet"))[-1]
    held = part.read_bytes()
    part.unlink()
    assert not s.valid("r", 1)
    part.write_bytes(held[:-20])
    os.utime(part)
    assert not s.valid("r", 1)


def test_parser_keeps_repositories_apart(spark):
    f = spark.createDataFrame([(1, "a.ts", "typescript", "import './b'"), (2, "a.ts", "typescript", "import './b'"), (1, "b.ts", "typescript", "")], "repo_id int, path string, language string, content string")
    out = parse.parse(f, ["repo_id"])
    assert rows(out, "repo_id", "path") == [(1, "a.ts"), (1, "b.ts"), (2, "a.ts")]
    from strataforge.operators import graph as G

    assert rows(G.build_graph(out, ["repo_id"])[1], "repo_id", "src", "dst") == [(1, "a.ts", "b.ts")]
    assert parse.parse_incremental(f, out, ["repo_id"]).count() == 3
