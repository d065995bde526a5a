"""Full analysis of generated source trees: wall time, peak memory, refresh and batch impact. ``python bench_trees.py [medium|large]``; one JSON line.

A tree has files that import the one before, export a value and hold a function with some conditions, spread over modules, and notes.
"""

from __future__ import annotations

import json
import os
import resource
import shutil
import sys
import tempfile
import time

#: Source files, notes, modules and conditions a function of each tree.
TREES = {"medium": (1_000, 100, 32, 4), "large": (10_000, 1_000, 128, 4)}


def grow(root: str, files: int, notes: int, modules: int, conditions: int) -> None:
    name = lambda i: f"src/module-{i % modules:06d}/file-{i:06d}"
    for i in range(files):
        path = f"{root}/{name(i)}.ts"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        before = f"import {{ value as before }} from '../{name(i - 1)[4:]}';\n" if i else "const before = 0;\n"
        checks = "".join(f"  total += input > {k} ? {k} : before;\n" for k in range(conditions))
        with open(path, "w") as f:
            f.write(f"{before}export const value = {i};\nexport function run{i}(input: number): number {{\n  let total = 0;\n{checks}  return total;\n}}\n")
    os.makedirs(f"{root}/docs", exist_ok=True)
    for i in range(notes):
        with open(f"{root}/docs/note-{i:06d}.md", "w") as f:
            f.write(f"# Note {i}\n")
    for n in ("package.json", "tsconfig.json"):
        with open(f"{root}/{n}", "w") as f:
            f.write('{"name": "tree", "version": "1.0.0"}\n' if n[0] == "p" else "{}\n")


def resident() -> int:
    """Peak resident megabytes of this process and the JVM."""
    total = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/status") as f:
                held = dict(line.split(":", 1) for line in f)
        except OSError:
            continue
        if held.get("Name", "").strip() == "java" and held.get("PPid", "").strip() == str(os.getpid()):
            total += int(held["VmHWM"].split()[0]) // 1024
    return total


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from strataforge.repository import Repository

    size, cpus = sys.argv[1] if len(sys.argv) > 1 else "medium", os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root, store = tempfile.mkdtemp(prefix="tree-"), tempfile.mkdtemp(prefix="store-")
    try:
        grow(root, *TREES[size])
        spark.range(1000).count()  # the session is warm
        out: dict = {"tree": size, "files": TREES[size][0]}
        start = time.perf_counter()
        repo = Repository(spark, root, store)
        repo.analyse()
        out["analyse_s"] = round(time.perf_counter() - start, 1)
        last = f"src/module-{(TREES[size][0] - 1) % TREES[size][2]:06d}/file-{TREES[size][0] - 1:06d}.ts"
        with open(f"{root}/{last}", "a") as f:
            f.write("export const more = 1;\n")
        start = time.perf_counter()
        repo.refresh([last])
        out["refresh_s"] = round(time.perf_counter() - start, 1)
        paths = [r.path for r in repo.table("files").select("path").orderBy("path").limit(1000).collect()]
        start = time.perf_counter()
        n = repo.impact(paths).scores.count()
        took = time.perf_counter() - start
        out |= {"impact_targets": n, "impact_s": round(took, 1), "targets_per_s": round(n / took, 1), "peak_mb": resident()}
        print(json.dumps(out))
    finally:
        shutil.rmtree(root, ignore_errors=True)
        shutil.rmtree(store, ignore_errors=True)


if __name__ == "__main__":
    main()
