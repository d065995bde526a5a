"""Source files that nobody wrote by hand here: generated, minified or bundled, copied, or data saved as code.

Four kinds of evidence, the first that says anything decides:

1. attribute files (``.gitattributes``) mark paths as generated or vendored, or as neither; for each of these two attributes by itself
   a deeper file, and within a file a later line, takes precedence;
2. the content, where it was read: a tool's or a copy's mark in the leading comments, minified lines, number tables;
3. path patterns: mined from the files that 1 and 2 mark (a directory name, a directory under its parent, a file name's
   ending), besides patterns in common use. The more specific pattern takes precedence, so that ``domain/vendor`` stays
   hand-written where ``vendor`` isn't;
4. shape: bytes per line of code, or a size beyond what is analysed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.rows import flat_map
from strataforge.runtime import cut

#: A pattern is mined if this many marked files in so many repositories bear it, and this share of the files read with it: for
#: directory names; for endings and directories under a parent among files that no directory name tells.
MIN_MARKED, MIN_REPOSITORIES, MIN_SHARE, MIN_SHARE_REST = 3, 2, 0.3, 0.6
#: A directory under its parent is hand-written if of so many files read with it at most this share is marked.
MIN_READ_PLAIN, MAX_SHARE_PLAIN = 5, 0.1
#: Bytes per line of code, and the size that isn't analysed.
LONG_LINES, MAX_ANALYSED = 300, 1_000_000

#: Directories of copies and of tools' output, anywhere.
KNOWN_DIRS = tuple(
    "node_modules bower_components jspm_packages site-packages dist-packages .venv third_party third-party thirdparty 3rdparty vendored __generated__ generated autogen generated-sources generated_sources .yarn pods carthage".split()
)
#: Directories that are so only outside a source root.
OUTSIDE_SOURCE_DIRS = tuple("vendor external externals deps contrib dist gen obj target build codegen .next .nuxt".split())
#: File names.
KNOWN_FILES = (
    r"(?i)(?:[.\-]min\.[cm]?js|\.bundle\.[cm]?js|\.chunk\.[cm]?js|[.\-][0-9a-f]{8,}\.[cm]?js|\.pb\.\w+|_pb\.[jt]s|_pb2(?:_grpc)?\.pyi?|\.g\.cs|\.designer\.cs|\.generated\.\w+|[._]gen\.\w+|_generated\.\w+|^zz_generated.*)$"
    r"|\w(?:Grpc|OuterClass)\.java$|_bindings\.rs$|\w_string\.go$|[A-Za-z]\w*[\-@]v?\d+\.\d+\.\d+\.\w+$"
)
_VERSIONED = r"^[A-Za-z][\w.]*[@\-]v?\d+\.\d+(?:\.\d+)*$"

# -- content -----------------------------------------------------------------------------------------
_LEADING = re.compile(r"\A(?:﻿|\s|//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|--[^\n]*)*")
_GENERATED = re.compile(
    r"(?i)\bcode generated by\b|@generated\b|<auto-?generated|\bauto-?generated (?:file|by|from|code)\b|\b(?:was|is|been) (?:auto(?:matically)?[- ]?)?generated (?:by|from|with)\b"
    r"|\bgenerated (?:by|from)\b[^\n]*(?:do not|don't) (?:edit|modify|change)|\bchanges (?:\w+ ){0,3}(?:will|may) be (?:overwritten|lost)|\bdo not edit\b[^\n]*generated"
)
_COPIED = re.compile(
    r"(?i)\bcopied from (?:the )?upstream\b|\bthird[- ]party code\b|\bimported copy\b|\bvendored (?:from|copy)\b|\bupstream project\b|\bbundled copy of\b|\A\s*/\*!\s*\S+ v?\d+\.\d+"
    r"|\A\s*(?://|#|/\*+)\s*[\w.\-]+ v?\d+\.\d+\.\d+\s*[,|(]"
)
_NUMBERS = re.compile(r"(?:[+\-]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?)[uUlLfF]?\s*,\s*){20,}")
_BLOB = re.compile(r"[\"'`][A-Za-z0-9+/=\\]{1500,}[\"'`]")
_DENSE = re.compile(r"[;{}(),=!?:&|]")


def content_mark(content: str | None) -> str | None:
    """``generated``, ``copied``, ``minified`` or ``data``; None where the content doesn't tell."""
    if not content:
        return None
    lead = _LEADING.match(content).group()
    if lead:
        if _GENERATED.search(lead):
            return "generated"
        if _COPIED.search(lead):
            return "copied"
    n = len(content)
    numbers = sum(len(m.group()) for m in _NUMBERS.finditer(content))
    if numbers > 0.5 * n:
        return "data"
    if n > 3000 and sum(len(m.group()) for m in _BLOB.finditer(content)) > 0.5 * n:
        return "data"
    long = [line for line in content.split("\n") if len(line) > 400]
    if long and sum(map(len, long)) > 0.6 * n:
        joined = "".join(long)
        if len(_DENSE.findall(joined)) > 0.12 * len(joined) and joined.count(" ") < 0.1 * len(joined):
            return "minified"
    return None


def _marks(rows: Iterator[tuple]) -> Iterator[tuple]:
    for file_id, repo_id, path, language, content in rows:
        if language is not None:
            yield file_id, content_mark(content), None, None, None, None, None, None
        if path and re.search(r"(^|/)\.gitattributes$", path):
            for rule in attribute_rules(path, content):
                yield None, None, repo_id, *rule


_MARKS = "file_id bigint, mark string, repo_id bigint, dir string, line int, regex string, attribute string, state boolean"


# -- attribute files ---------------------------------------------------------------------------------
def glob_to_regex(pattern: str) -> str:
    """An attribute pattern as a regular expression over the path of a file below the attribute file's directory.

    A pattern without a slash is one for names at any depth; one that ends with a slash is for directories and so for no file.
    """
    if pattern.endswith("/"):
        return r"(?!)"
    anchored = "/" in pattern
    p, out, i = pattern.removeprefix("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif p[i:] == "**" and (i == 0 or p[i - 1] == "/"):
            out, i = out + r".+", i + 2
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += r"[^/]*"
        elif p[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inner = p[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return rf"^(?:{'' if anchored else '(?:.*/)?'}{out})$"


_LINE = re.compile(r"\s*(?:\"((?:[^\"\\]|\\.)*)\"|(\S+))((?:\s+\S+)+)\s*")
_ATTRIBUTE = re.compile(r"([\-!]?)(?:linguist-|gitlab-)?(generated|vendored)(?:=(\w+))?")


def attribute_rules(path: str, content: str | None) -> Iterator[tuple[str, int, str, str, bool | None]]:
    """(directory, line, regular expression, attribute, state) of an attribute file's generated and vendored marks.

    States: set (true), unset (false) and, after ``!``, unspecified again (None). Of one attribute on a line the last state holds. Macros
    (``[attr]name ...``) of the same file stand for their attributes.
    """
    directory, macros = path.rpartition("/")[0], {}
    for number, line in enumerate((content or "").splitlines(), 1):
        m = _LINE.fullmatch(line)
        if not m or m[2] and m[2][0] in "#!":
            continue
        pattern, words = m[1] if m[1] is not None else m[2], m[3].split()
        if pattern.startswith("[attr]"):
            macros[pattern[6:]] = words
            continue
        states: dict[str, bool | None] = {}
        for word in (w for word in words for w in macros.get(word, [word])):
            if a := _ATTRIBUTE.fullmatch(word):
                states[a[2]] = None if a[1] == "!" else not a[1] and (a[3] or "true").lower() in ("true", "set", "1")
        for attribute, state in states.items():
            yield directory, number, glob_to_regex(pattern), attribute, state


def normal_path(path: Column) -> Column:
    """Forward slashes, no ``./``, no empty or doubled separators."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./)+|^/", "")


def latest(manifest: DataFrame, columns: list[str]) -> DataFrame:
    """The row of each file with the latest ``scanned_at``; observations fold map-side."""
    held = F.max(F.struct("scanned_at", *columns)).alias("_h")
    return manifest.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(held).select("file_id", *[F.col(f"_h.{c}").alias(c) for c in columns])


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, declared) of files that an attribute file marks as generated or vendored (true), or as not (false).

    ``rules`` has repo_id, dir, line, regex, attribute and state. An attribute's last state holds; a file with neither state isn't in the result.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = paths.select("file_id", "repo_id", "path", F.explode(above).alias("dir"))
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    hit = ancestors.join(rules, ["repo_id", "dir"]).filter(F.regexp_like(below, F.col("regex")))
    last = hit.groupBy("file_id", "attribute").agg(F.max_by("state", F.struct(F.length("dir"), "line")).alias("state"))
    return last.groupBy("file_id").agg(F.bool_or("state").alias("declared")).filter("declared IS NOT NULL")


# -- patterns ----------------------------------------------------------------------------------------
def _features() -> Column:
    """Patterns that a path bears: ``d:`` directory, ``p:`` directory under its parent, ``e:`` ending of the file name."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    pairs = F.when(F.size(dirs) > 1, F.zip_with(F.slice(dirs, 1, F.size(dirs) - 1), F.slice(dirs, 2, F.size(dirs) - 1), lambda a, b: F.concat(F.lit("p:"), a, F.lit("/"), b))).otherwise(F.array().cast("array<string>"))
    ending = F.regexp_extract(name, r"((?:[._\-]|[A-Z])[A-Za-z0-9]*\.[A-Za-z]+)$", 1)
    double = F.regexp_extract(name, r"(\.[A-Za-z]+\.[A-Za-z]+)$", 1)
    ends = F.filter(F.array(ending, double), lambda e: e != "")
    return F.array_distinct(F.concat(F.transform(dirs, lambda d: F.concat(F.lit("d:"), d)), pairs, F.transform(ends, lambda e: F.concat(F.lit("e:"), e))))


def mined_patterns(paths: DataFrame, kinds: str, share: float) -> DataFrame:
    """(pattern, foreign): patterns of ``kinds`` that marked files share, and directories under a parent that hold none.

    ``paths`` has file_id, repo_id, path, read and marked. Counts fold map-side, so a directory that a third of
    all files lie in is one row per task.
    """
    each = paths.filter("read").select("repo_id", "marked", F.explode(_features()).alias("pattern"))
    per = each.groupBy("pattern", "repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("marked").cast("int")).alias("m"))
    total = per.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if(F.col("m") > 0).alias("r"))
    part = F.col("m") / F.col("n")
    return total.select(
        "pattern",
        F.when(F.substring("pattern", 1, 1).isin(*kinds) & (F.col("m") >= MIN_MARKED) & (F.col("r") >= MIN_REPOSITORIES) & (part >= share), True)
        .when(F.col("pattern").startswith("p:") & (F.col("n") >= MIN_READ_PLAIN) & (part <= MAX_SHARE_PLAIN), False)
        .alias("foreign"),
    ).filter("foreign IS NOT NULL")


def _bearing(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """``paths`` with ``told``: whether a foreign pattern or one in common use says so.

    A directory name that is hand-written under its parent (a pattern that isn't foreign) tells nothing there.
    """
    borne = (
        paths.select("file_id", F.explode(_features()).alias("pattern"))
        .join(patterns, "pattern")
        .groupBy("file_id")
        .agg(
            F.collect_set(F.when(F.col("foreign") & F.col("pattern").startswith("d:"), F.expr("substring(pattern, 3)"))).alias("_dirs"),
            F.max(F.col("foreign") & ~F.col("pattern").startswith("d:")).alias("_specific"),
            F.collect_set(F.when(~F.col("foreign"), F.regexp_extract("pattern", r"([^/]+)$", 1))).alias("_plain"),
        )
    )
    none = F.array().cast("array<string>")
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rest = F.array_join(F.concat(F.filter(dirs, lambda d: ~F.array_contains(F.coalesce("_plain", none), d)), F.array(F.element_at(parts, -1))), "/")
    named = F.size(F.array_except(F.coalesce("_dirs", none), F.coalesce("_plain", none))) > 0
    told = named | F.coalesce("_specific", F.lit(False)) | _known(rest)
    return paths.join(borne, "file_id", "left").withColumn("told", told).drop("_dirs", "_specific", "_plain")


def _known(path: Column) -> Column:
    """Whether a path bears a pattern in common use."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    source = F.array_position(dirs, "src")
    anywhere = F.exists(dirs, lambda d: F.lower(d).isin(*KNOWN_DIRS) | d.rlike(_VERSIONED))
    outside = F.exists(F.when(source > 0, F.slice(dirs, F.lit(1), (source - 1).cast("int"))).otherwise(dirs), lambda d: F.lower(d).isin(*OUTSIDE_SOURCE_DIRS))
    return anywhere | outside | F.element_at(parts, -1).rlike(KNOWN_FILES)


def judge(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file of ``manifest`` with a language: file_id, repo_id, path, mark (of its content), declared,
    pattern (mined or in use), shape and foreign.

    The row with the latest ``scanned_at`` holds (ties: the greatest values). Null paths give no pattern, a null size or line
    count no shape. Rows with a null file_id are left out. Empty tables give an empty result.
    """
    held = latest(manifest, ["language", "repo_id", "relative_path", "size", "lines_of_code", "analyzable"]).filter(F.col("language").isNotNull())
    # contents are read once: marks and the rules of attribute files are kept, and so is what is known of each file before its patterns
    source = files.select("file_id", "repo_id", normal_path(F.col("relative_path")).alias("path"), "language", "content")
    known = cut(flat_map(source.filter(F.col("language").isNotNull() | F.col("path").endswith(".gitattributes")), ["file_id", "repo_id", "path", "language", "content"], _marks, _MARKS))
    read = known.filter("file_id IS NOT NULL").groupBy("file_id").agg(F.max("mark").alias("mark"), F.lit(True).alias("read"))
    rules = known.filter("regex IS NOT NULL").select("repo_id", "dir", "line", "regex", "attribute", "state").distinct()
    base = held.withColumn("path", F.coalesce(normal_path(F.col("relative_path")), F.lit(""))).join(read, "file_id", "left")
    base = base.join(declared(base.select("file_id", "repo_id", "path"), rules), "file_id", "left")
    base = base.withColumn("read", F.coalesce("read", F.lit(False)) | F.col("declared").isNotNull()).withColumn("marked", F.coalesce("declared", F.col("mark").isNotNull()))
    base = cut(base)
    paths = base.select("file_id", "repo_id", "path", "read", "marked")
    names = mined_patterns(paths, "d", MIN_SHARE)
    rest = mined_patterns(_bearing(paths.filter("read"), names).filter(~F.col("told")), "pe", MIN_SHARE_REST).filter("foreign")
    out = _bearing(base, names.unionByName(rest))
    shape = (F.col("size") >= LONG_LINES * F.col("lines_of_code")) & (F.col("lines_of_code") > 0) | (~F.col("analyzable") & (F.col("size") > MAX_ANALYSED))
    shape = F.coalesce(shape, F.lit(False))
    return out.select(
        "file_id", "repo_id", "path", "mark", "declared", F.col("told").alias("pattern"), shape.alias("shape"),
        F.coalesce("declared", F.col("mark").isNotNull() | F.col("told") | shape).alias("foreign"),
    )


def found(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return judge(manifest, files).filter("foreign").select("file_id").distinct()
