"""Path algebra in built-in expressions (no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataforge.rules import LANGUAGES, RESOLVE_EXTENSIONS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(path: Column | str, root: str = "") -> Column:
    """Forward slashes, no leading ``./``, no doubled separators; below ``root`` (case-insensitive) relative to it."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    p = F.regexp_replace(p, r"/+", "/")
    if root:
        p = F.regexp_replace(p, rf"(?i)^{re.escape(root.rstrip('/'))}/", "")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def collapse(path: Column | str) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(_c(path), "/"), F.array().cast("array<string>"), step), "/")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language(path: Column | str) -> Column:
    """Language by extension; null if unknown."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.nullif(extension(path), F.lit("")))


def segments(path: Column | str) -> Column:
    return F.split(F.lower(_c(path)), "/")


def has_segment(path: Column | str, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, names)))


def module_of(path: Column | str) -> Column:
    """``packages/x`` or ``apps/x``, else the first segment if it has no extension, else ``root``."""
    p = _c(path)
    first = F.split_part(p, F.lit("/"), F.lit(1))
    area = F.regexp_extract(p, r"^((?:packages|apps)/[^/]+)", 1)
    return F.when(area != "", area).when((first != "") & ~first.contains("."), first).otherwise("root")


def package_root(specifier: Column | str) -> Column:
    """Package of an external specifier: ``node:x`` whole, two segments of a scope, else the first segment."""
    s = _c(specifier)
    scoped = F.regexp_extract(s, r"^(@[^/]+/[^/]+)", 1)
    return F.when(s.startswith("node:"), s).when(scoped != "", scoped).otherwise(F.split_part(s, F.lit("/"), F.lit(1)))


def candidates(base: Column | str) -> Column:
    """Paths that a specifier may mean, in order: itself; with an extension its stem under each known one; else each
    extension and each index file, interleaved."""
    b = _c(base)
    exts = F.array(*map(F.lit, RESOLVE_EXTENSIONS))
    stem = F.regexp_replace(b, r"\.[^./]+$", "")
    with_ext = F.transform(exts, lambda e: F.concat(stem, e))
    without = F.flatten(F.transform(exts, lambda e: F.array(F.concat(b, e), F.concat(b, F.lit("/index"), e))))
    return F.concat(F.array(b), F.when(basename(b).rlike(r".\.[^.]+$"), with_ext).otherwise(without))


def specifier_bases(source: Column | str, specifier: Column | str) -> Column:
    """Base paths of an internal specifier, in order; empty for an external one."""
    s = _c(specifier)
    folder = dirname(source)
    relative = collapse(F.concat(folder, F.lit("/"), s))
    alias = F.regexp_replace(s, r"^[@~]/", "")
    workspace = F.regexp_extract(s, r"^@[^/]+/([^/]+)", 1)
    sub = F.regexp_extract(s, r"^@[^/]+/[^/]+/(.+)$", 1)
    areas = F.array(F.concat(F.lit("packages/"), workspace), F.concat(F.lit("apps/"), workspace))
    in_area = F.flatten(
        F.transform(
            areas,
            lambda a: F.when(sub != "", F.array(F.concat(a, F.lit("/"), sub), F.concat(a, F.lit("/src/"), sub))).otherwise(F.array(F.concat(a, F.lit("/src/index")), F.concat(a, F.lit("/index")))),
        )
    )
    return (
        F.when(s.startswith("."), F.array(relative))
        .when(s.rlike(r"^[@~]/"), F.array(F.concat(F.lit("src/"), alias), alias))
        .when(s.startswith("/"), F.array(F.substring(s, 2, 100_000)))
        .when(workspace != "", in_area)
        .otherwise(F.array().cast("array<string>"))
    )


def glob_regex(pattern: str) -> tuple[bool, str]:
    """(whole path?, regular expression) of an ignore pattern: without ``/`` it matches any segment."""
    whole = "/" in pattern.strip("/")
    out, p, i = "", pattern.strip("/"), 0
    while i < len(p):
        if p[i] == "*":
            deep = p.startswith("**", i)
            out += ".*" if deep or not whole else "[^/]*"
            i += 2 if deep else 1
            continue
        out += "." if p[i] == "?" else re.escape(p[i])
        i += 1
    return whole, rf"(?i)^{out}(?:/.*)?$" if whole else rf"(?i)^{out}$"


def ignored(path: Column | str, patterns: list[str]) -> Column:
    """Whether an ignore pattern covers a path. Negated patterns (``!``) never match."""
    p = _c(path)
    rules = [glob_regex(x) for x in patterns if x and not x.startswith("!")]
    names, paths = [r for whole, r in rules if not whole], [r for whole, r in rules if whole]
    out = F.lit(False)
    if names:
        joined = "|".join(f"(?:{r[4:]})" for r in names)
        out = out | F.exists(F.split(p, "/"), lambda s: s.rlike(f"(?i){joined}"))
    for r in paths:
        out = out | p.rlike(r)
    return out


def humanise(name: Column | str) -> Column:
    """``order-lines`` or ``orderLines`` as ``Order Lines``."""
    spaced = F.regexp_replace(F.regexp_replace(_c(name), r"[-_]", " "), r"([a-z])([A-Z])", "$1 $2")
    return F.array_join(F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
