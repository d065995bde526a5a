"""Git as a source: working tree, commits, ranges and historical trees, by driver-side child processes.

Metadata of one commit or range is small and bounded; file contents of a tree are read by tasks after materialising.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import subprocess
import tarfile
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strataforge.schemas import CHANGED_FILE

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
ZERO = "0" * 40
WORKING = "kind string, path string, previousPath string, staged boolean, unstaged boolean, untracked boolean, contentKind string"


class GitError(RuntimeError):
    pass


def git(root: str, *args: str, timeout: float = 30) -> str:
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-C", root, *args], capture_output=True, timeout=timeout)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip()[:500])
    return done.stdout.decode("utf-8", "surrogateescape")


def content_kind(path: str) -> str:
    """symlink, submodule (a directory with .git), binary (NUL in the first 8192 bytes), text or unknown."""
    if os.path.islink(path):
        return "symlink"
    if os.path.isdir(path):
        return "submodule" if os.path.exists(os.path.join(path, ".git")) else "unknown"
    try:
        with open(path, "rb") as f:
            return "binary" if b"\0" in f.read(8192) else "text"
    except OSError:
        return "unknown"


_KIND = {"A": "added", "D": "deleted", "T": "type-changed", "M": "modified", "R": "renamed", "C": "added"}


def working_tree_changes(spark: SparkSession, root: str, max_paths: int = 10_000) -> DataFrame:
    """Changes of the working tree against HEAD; a conflict or too many paths raise."""
    parts = git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--find-renames=50%", timeout=15).split("\0")
    rows, i = [], 0
    while i < len(parts):
        entry = parts[i]
        i += 1
        if len(entry) < 4:
            continue
        x, y, path, previous = entry[0], entry[1], entry[3:], None
        if "U" in (x, y) or (x, y) in (("A", "A"), ("D", "D")):
            raise GitError(f"conflict at {path}")
        if "R" in (x, y) or "C" in (x, y):
            previous = parts[i]
            i += 1
        untracked = x == "?"
        code = "A" if untracked else next((c for c in "RADTM" if c in (x, y)), "M")
        rows.append((_KIND[code], path, previous, x not in " ?", y not in " ?", untracked, content_kind(os.path.join(root, path))))
    if len(rows) > max_paths:
        raise GitError(f"{len(rows)} changed paths exceed {max_paths}")
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), WORKING)


def commit_parents(root: str, sha: str) -> list[str]:
    return git(root, "show", "-s", "--format=%P", sha).split()


def _changes(spark: SparkSession, root: str, old: str, new: str, max_files: int) -> DataFrame:
    raw = git(root, "diff-tree", "-r", "--raw", "-z", "--no-abbrev", "--find-renames=50%", old, new).split("\0")
    numstat = git(root, "diff-tree", "-r", "--numstat", "-z", "--find-renames=50%", old, new).split("\0")
    binary, i = set(), 0
    while i < len(numstat):
        fields = numstat[i].split("\t")
        i += 1
        if len(fields) < 3:
            continue
        path = fields[2]
        if not path:
            path, i = numstat[i + 1], i + 2
        if fields[0] == "-":
            binary.add(path)
    rows, i = [], 0
    while i < len(raw):
        head = raw[i]
        i += 1
        if not head.startswith(":"):
            continue
        old_mode, new_mode, old_sha, new_sha, status = head[1:].split(" ")
        path, previous = raw[i], None
        i += 1
        if status[0] in "RC":
            previous, path = path, raw[i]
            i += 1
        mode = new_mode if status[0] != "D" else old_mode
        link = mode == "160000"
        kind = "submodule" if link else "symlink" if mode == "120000" else "binary" if path in binary else "text"
        nil = lambda v: None if set(v) == {"0"} else v
        rows.append((_KIND[status[0]], path, previous, nil(old_sha), nil(new_sha), nil(old_mode), nil(new_mode), kind, path in binary, link))
    if len(rows) > max_files:
        raise GitError(f"{len(rows)} changed files exceed {max_files}")
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[2] or "", r[0])), CHANGED_FILE)


def commit_changes(spark: SparkSession, root: str, sha: str, parent: str | None = None, max_files: int = 500) -> DataFrame:
    """Changed files of a commit against its parent; a merge needs one of its parents named, a root is compared with the empty tree."""
    parents = commit_parents(root, sha)
    if parent is None:
        if len(parents) > 1:
            raise GitError("a merge commit needs a parent")
        parent = parents[0] if parents else EMPTY_TREE
    elif parent not in parents:
        raise GitError(f"{parent} is no direct parent")
    return _changes(spark, root, parent, sha, max_files)


def range_changes(spark: SparkSession, root: str, base: str, head: str, max_files: int = 500) -> DataFrame:
    """Changed files between two trees that share exactly one merge base."""
    try:
        bases = git(root, "merge-base", "--all", base, head).split()
    except GitError:
        bases = []
    if len(bases) != 1:
        raise GitError("no merge base" if not bases else "ambiguous merge base")
    return _changes(spark, root, base, head, max_files)


@contextlib.contextmanager
def materialise_tree(root: str, tree: str, max_bytes: int = 256 << 20, max_files: int = 50_000, folder: str | None = None) -> Iterator[str]:
    """A directory with the files of a tree, gone afterwards. Archive size, file count and extracted size are bounded; no entry
    may leave the directory. On a cluster ``folder`` has to be shared."""
    target = tempfile.mkdtemp(prefix="tree-", dir=folder)
    try:
        archive = subprocess.run(["git", "-C", root, "archive", "--format=tar", tree], capture_output=True, timeout=60)
        if archive.returncode:
            raise GitError(archive.stderr.decode("utf-8", "replace")[:500])
        if len(archive.stdout) > max_bytes:
            raise GitError("archive exceeds its bound")
        import io

        with tarfile.open(fileobj=io.BytesIO(archive.stdout)) as tar:
            members = tar.getmembers()
            if sum(m.isfile() for m in members) > max_files or sum(m.size for m in members) > max_bytes:
                raise GitError("tree exceeds its bound")
            if any(".git" in Path(m.name).parts for m in members):
                raise GitError("tree holds a repository")
            tar.extractall(target, filter="data")
        yield target
    finally:
        shutil.rmtree(target, ignore_errors=True)
