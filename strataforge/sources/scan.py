"""Repository scan: walk, ignore rules, manifest, configuration, incremental rescan."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.rules import DEFAULT_IGNORE, FRAMEWORKS, LANGUAGES, MAX_FILE_SIZE
from strataforge.schemas import MANIFEST

#: A change of one of these names calls for a full rescan.
CONFIG_NAMES = r"(^|/)(\.gitignore|package\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb?|tsconfig[^/]*\.json)$"
#: Lock files in order of precedence.
LOCKS = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("bun.lock", "bun"), ("package-lock.json", "npm"))


def read_ignore(root: str) -> list[str]:
    """Default patterns and the lines of the root's .gitignore without blanks and comments."""
    path = Path(root) / ".gitignore"
    own = path.read_text("utf-8", "replace").splitlines() if path.is_file() else []
    return [*DEFAULT_IGNORE, *[x.strip() for x in own if x.strip() and not x.strip().startswith("#")]]


def _base(root: str) -> str:
    """A local folder by its full path; a folder of any other file system as it is."""
    return root.rstrip("/") if "://" in root else os.path.abspath(root)


def _rows(raw: DataFrame, base: str, content: bool) -> DataFrame:
    local = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"\+", "%2B")) if "://" not in base else F.col("path")
    rel = F.substring(local, len(base) + 2, 1 << 20)
    text = [F.make_valid_utf8(F.col("content").cast("string")).alias("content")] if content else []
    return raw.select(local.alias("path"), rel.alias("relativePath"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modifiedAtMs"), *text)


def list_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, relativePath, size, modifiedAtMs) of regular files below ``root`` that no pattern covers.

    Only names and sizes are read: content is pruned from the binary source, so ignored files cost a listing.
    """
    base = _base(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return _rows(raw, base, False).filter(~P.ignored("relativePath", read_ignore(root) if ignore is None else ignore))


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """The same with ``content`` (bytes that are no UTF-8 are replaced), for files that can be analysed.

    The source reads the bytes where the task runs, on any file system that Spark knows. Names and sizes are left to it, so that files of
    other kinds or beyond the greatest size aren't opened.
    """
    base = _base(root)
    names = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in extension) for extension in LANGUAGES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(base).filter(F.col("length") <= MAX_FILE_SIZE)
    return _rows(raw, base, True).filter(~P.ignored("relativePath", read_ignore(root) if ignore is None else ignore))


def read_changed(spark: SparkSession, root: str, changed: list[str], ignore: list[str] | None = None) -> DataFrame:
    """Rows of :func:`read_files` for the ``changed`` paths alone; those that are gone, ignored, too large or of no language give none."""
    base = _base(root)
    here = [c for c in sorted(set(changed)) if os.path.isfile(os.path.join(base, c)) and re.search(r"\.(?:" + "|".join(LANGUAGES) + r")$", c, re.I)]
    if not here:
        return spark.createDataFrame([], "path string, relativePath string, size bigint, modifiedAtMs bigint, content string")
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f"{base}/{c}") for c in here]
    raw = spark.read.format("binaryFile").load(escaped).filter(F.col("length") <= MAX_FILE_SIZE)
    return _rows(raw, base, True).filter(~P.ignored("relativePath", read_ignore(root) if ignore is None else ignore))


def manifest(files: DataFrame) -> DataFrame:
    """MANIFEST rows of (path, relativePath, size, modifiedAtMs, content): language by extension, whether it's analysed
    (a language and at most a megabyte), non-blank lines."""
    lang = P.language("relativePath")
    analyzable = F.coalesce(lang.isNotNull() & (F.col("size") <= MAX_FILE_SIZE), F.lit(False))
    lines = F.size(F.filter(F.split("content", "\n"), lambda l: l.rlike(r"\S")))
    return files.select("path", "relativePath", "size", "modifiedAtMs", lang.alias("language"), analyzable.alias("analyzable"), F.when(analyzable & F.col("content").isNotNull(), lines).otherwise(0).alias("linesOfCode"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a directory. Files that aren't analysed aren't read."""
    rest = list_files(spark, root).filter(~F.coalesce(P.language("relativePath").isNotNull() & (F.col("size") <= MAX_FILE_SIZE), F.lit(False)))
    return manifest(read_files(spark, root).filter(P.language("relativePath").isNotNull()).unionByName(rest.withColumn("content", F.lit(None).cast("string"))))


def scanned(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("analyzable") & F.col("language").isNotNull()).select("path", "relativePath", "language", "size")


def needs_full_scan(previous: DataFrame | None, changed: list[str], root: str) -> bool:
    """A configuration file changed, a changed path is or was a directory, or nothing is known yet."""
    if previous is None:
        return True
    if any(re.search(CONFIG_NAMES, c) or os.path.isdir(os.path.join(root, c)) for c in changed):
        return True
    below = F.lit(False)
    for c in changed:
        below = below | F.col("relativePath").startswith(c.rstrip("/") + "/")
    return not previous.filter(below).isEmpty()


def scan_incremental(spark: SparkSession, root: str, previous: DataFrame | None, changed: list[str]) -> DataFrame:
    """The manifest after changes: unchanged rows stay, changed files are read again, deleted ones go."""
    if needs_full_scan(previous, changed, root):
        return scan(spark, root)
    keys = spark.createDataFrame([(c,) for c in changed], "relativePath string")
    kept = previous.join(keys, "relativePath", "left_anti").select(*[c.split()[0] for c in MANIFEST.split(", ")])
    here = [(os.path.join(os.path.abspath(root), c), c, os.path.getsize(p), int(os.path.getmtime(p) * 1000)) for c in sorted(set(changed)) if os.path.isfile(p := os.path.join(root, c))]
    listed = spark.createDataFrame(here, "path string, relativePath string, size bigint, modifiedAtMs bigint").filter(~P.ignored("relativePath", read_ignore(root)))
    rows = listed.join(read_changed(spark, root, changed).select("relativePath", "content"), "relativePath", "left")
    return kept.unionByName(manifest(rows.select("path", "relativePath", "size", "modifiedAtMs", "content")))


def read_json_config(path: str, comments: bool = False) -> dict | None:
    """A JSON object; None if the file is missing. With ``comments`` comments and trailing commas are taken out first."""
    if not os.path.isfile(path):
        return None
    text = Path(path).read_text("utf-8-sig")
    if comments:
        text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
        text = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no object")
    return value


def package_manager(names: list[str]) -> str | None:
    held = {os.path.basename(n) for n in names}
    return next((manager for lock, manager in LOCKS if lock in held), None)


def frameworks(package: dict | None) -> list[dict]:
    """Known frameworks among all kinds of dependencies; a later kind's version wins."""
    package = package or {}
    deps: dict[str, str] = {}
    for kind in ("dependencies", "devDependencies", "peerDependencies"):
        deps |= {k: v for k, v in (package.get(kind) or {}).items() if isinstance(v, str)}
    found = {FRAMEWORKS[k]: v for k, v in deps.items() if k in FRAMEWORKS}
    return [{"name": n, "version": v, "confidence": 1.0} for n, v in sorted(found.items())]


def repository_row(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """One row: name, metadata flags, package manager, totals."""
    package = read_json_config(os.path.join(root, "package.json"))
    names = os.listdir(root)
    meta = (
        os.path.basename(os.path.abspath(root)), package_manager(names), any(re.match(r"(?i)readme(\.|$)", n) for n in names), any(re.match(r"(?i)licen[cs]e(\.|$)", n) for n in names),
        ".gitignore" in names, "tsconfig.json" in names, package is not None, (package or {}).get("description") if isinstance((package or {}).get("description"), str) else None,
        (package or {}).get("version") if isinstance((package or {}).get("version"), str) else None, [f["name"] for f in frameworks(package)],
    )
    total = rows.agg(F.count(F.lit(1)).alias("totalFiles"), F.coalesce(F.sum("linesOfCode"), F.lit(0)).alias("totalLinesOfCode"))
    columns = "name string, packageManager string, hasReadme boolean, hasLicense boolean, hasGitIgnore boolean, hasTsConfig boolean, hasPackageJson boolean, description string, version string, frameworks array<string>"
    one = spark.createDataFrame([meta], columns).withColumn("_k", F.lit(1))
    return one.join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


def content_fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): digest over sorted (path, digest) pairs; row digests add up, so it folds map-side. Null content counts as deleted."""
    digest = F.sha2(F.concat_ws(":", "relativePath", F.coalesce(F.sha2("content", 256), F.lit("deleted"))), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)"))
    return files.agg(F.sha2(F.concat_ws(":", part(1).cast("string"), part(13).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("fingerprint"))
