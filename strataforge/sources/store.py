"""Versioned storage of analysis tables and a small key-value store, on a plain file system.

Tables of a version are written first, then its manifest, then the ``latest`` pointer by compare-and-set under a lock
file; readers follow the pointer, so they never see half a version. Several keys change together by a journal: it's written before any
key, whoever comes next finishes it. The lock of a process that has died is taken over.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import socket
import threading
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote, unquote

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

FORMAT = 2


class Conflict(RuntimeError):
    """A precondition doesn't hold."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    # -- keys ------------------------------------------------------------------------------------
    def _path(self, namespace: str, key: str) -> Path:
        return self.root / "kv" / quote(namespace, safe="") / f"{quote(key, safe='')}.json"

    def _abandoned(self, path: Path) -> bool:
        """Whether the lock's owner is a process of this machine that has died."""
        try:
            host, pid = path.read_text().split()
            if host != socket.gethostname():
                return False
            os.kill(int(pid), 0)
        except ProcessLookupError:
            return True
        except (OSError, ValueError):
            return False
        return False

    @contextlib.contextmanager
    def _lock(self, wait: float = 5) -> Iterator[None]:
        path, until = self.root / ".lock", time.monotonic() + wait
        while True:
            draft = self.root / f".lock-{os.getpid()}-{threading.get_ident()}"
            draft.write_text(f"{socket.gethostname()} {os.getpid()}")
            try:
                os.link(draft, path)  # fails if the lock is held; the owner's name is there from the first moment
                break
            except FileExistsError:
                if self._abandoned(path):
                    path.unlink(missing_ok=True)
                    continue
                if time.monotonic() > until:
                    raise Conflict("the store is locked") from None
                time.sleep(0.02)
            finally:
                draft.unlink(missing_ok=True)
        try:
            self._finish()
            yield
        finally:
            path.unlink(missing_ok=True)

    @property
    def _journal(self) -> Path:
        return self.root / ".journal"

    def _finish(self) -> None:
        """Carry out the journal of a process that died between its keys. Only under the lock."""
        if self._journal.exists():
            self._carry_out(json.loads(self._journal.read_text()))
            self._journal.unlink()

    def _carry_out(self, entries: list) -> None:
        for name, text in entries:
            path = self.root / name
            path.unlink(missing_ok=True) if text is None else self._write(path, text)

    def _write(self, path: Path, text: str) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        draft = path.with_suffix(".draft")
        draft.write_text(text)
        os.replace(draft, path)

    def save(self, namespace: str, key: str, value) -> None:
        self.apply([("save", namespace, key, value)])

    def load(self, namespace: str, key: str):
        raw = self.inspect(namespace, key)
        return None if raw is None else json.loads(raw)

    def inspect(self, namespace: str, key: str) -> str | None:
        if self._journal.exists():
            with self._lock():
                pass
        return self._raw(namespace, key)

    def _raw(self, namespace: str, key: str) -> str | None:
        path = self._path(namespace, key)
        return path.read_text() if path.exists() else None

    def exists(self, namespace: str, key: str) -> bool:
        return self._path(namespace, key).exists()

    def delete(self, namespace: str, key: str) -> None:
        self.apply([("delete", namespace, key, None)])

    def list(self, namespace: str) -> list[str]:
        folder = self.root / "kv" / quote(namespace, safe="")
        return sorted(unquote(p.stem) for p in folder.glob("*.json")) if folder.exists() else []

    def apply(self, mutations: list[tuple], preconditions: list[tuple] = ()) -> None:
        """All ``("save"|"delete", namespace, key, value)`` or none. Preconditions: ``("missing"|"equals"|"raw", namespace, key, value)``.

        A key may be mutated once. Values are serialised before anything changes; a failure restores what was there.
        """
        targets = [(m[1], m[2]) for m in mutations]
        if len(set(targets)) < len(targets):
            raise ValueError("a key is mutated twice")
        texts = [json.dumps(m[3], sort_keys=True, allow_nan=False) if m[0] == "save" else None for m in mutations]
        with self._lock():
            for kind, namespace, key, *value in preconditions:
                raw = self._raw(namespace, key)
                holds = raw is None if kind == "missing" else raw == value[0] if kind == "raw" else raw is not None and json.loads(raw) == value[0]
                if not holds:
                    raise Conflict(f"{kind} {namespace}/{key}")
            before = [[str(self._path(n, k).relative_to(self.root)), self._raw(n, k)] for n, k in targets]
            entries = [[name, text] for (name, _), text in zip(before, texts, strict=True)]
            self._write(self._journal, json.dumps(entries))
            try:
                self._carry_out(entries)
            except OSError:
                self._carry_out(before)
                raise
            finally:
                self._journal.unlink(missing_ok=True)

    # -- versions --------------------------------------------------------------------------------
    def _version(self, repo: str, version: int) -> Path:
        return self.root / "tables" / quote(repo, safe="") / f"v{version:08d}"

    def publish(self, repo: str, version: int, tables: dict[str, DataFrame], expect_latest: int | None) -> None:
        """Write a version and move the pointer if it still is ``expect_latest`` (None: no version yet)."""
        folder = self._version(repo, version)
        shutil.rmtree(folder, ignore_errors=True)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(folder / name))
        held = {n: {"schema": df.schema.simpleString(), "rows": self._rows(folder / n)} for n, df in tables.items()}
        self._write(folder / "manifest.json", json.dumps({"format": FORMAT, "tables": held}))
        condition = ("missing", "latest", repo) if expect_latest is None else ("equals", "latest", repo, expect_latest)
        self.apply([("save", "latest", repo, version)], [condition])

    @staticmethod
    def _rows(folder: Path) -> int:
        """Rows of a table by the footers of all its files, each of which is read."""
        return sum(pq.ParquetFile(f).metadata.num_rows for f in sorted(folder.glob("*.parquet")))

    def latest(self, repo: str) -> int | None:
        return self.load("latest", repo)

    def versions(self, repo: str) -> list[int]:
        folder = self.root / "tables" / quote(repo, safe="")
        return sorted(int(p.name[1:]) for p in folder.glob("v*")) if folder.exists() else []

    def read(self, repo: str, name: str, version: int | None = None) -> DataFrame:
        version = self.latest(repo) if version is None else version
        if version is None:
            raise KeyError(f"{repo} has no version")
        return self.spark.read.parquet(str(self._version(repo, version) / name))

    def valid(self, repo: str, version: int) -> bool:
        """Whether a version has its manifest in a known format, and every table has its schema and, by the footers of all its files, its rows."""
        folder = self._version(repo, version)
        try:
            held = json.loads((folder / "manifest.json").read_text())
            if held["format"] > FORMAT:
                return False
            return all(self.spark.read.parquet(str(folder / n)).schema.simpleString() == t["schema"] and self._rows(folder / n) == t["rows"] for n, t in held["tables"].items())
        except Exception:  # noqa: BLE001
            return False

    def recover(self, repo: str) -> int | None:
        """Newest valid version. Versions without a manifest are deleted, other broken ones moved aside; the pointer is repaired."""
        best = None
        for version in reversed(self.versions(repo)):
            folder = self._version(repo, version)
            if self.valid(repo, version):
                best = version if best is None else best
            elif not (folder / "manifest.json").exists():
                shutil.rmtree(folder)
            else:
                aside = self.root / "quarantine" / quote(repo, safe="") / folder.name
                aside.parent.mkdir(parents=True, exist_ok=True)
                shutil.rmtree(aside, ignore_errors=True)
                shutil.move(str(folder), str(aside))
        if best != self.latest(repo):
            self.apply([("save", "latest", repo, best) if best is not None else ("delete", "latest", repo, None)])
        return best
