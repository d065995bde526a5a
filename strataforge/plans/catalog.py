"""All core queries and their SQL, by name."""

from __future__ import annotations

import importlib
import pkgutil

import strataforge.plans as _here


def _modules():
    names = sorted(m.name for m in pkgutil.iter_modules(_here.__path__))
    return [importlib.import_module(f"strataforge.plans.{n}") for n in names if n != "catalog"]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in getattr(m, "SQL", {}).items()}
