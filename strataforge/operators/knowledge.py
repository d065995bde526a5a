"""Conventions, export patterns and risks of repositories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import paths as P
from strataforge.operators import graph as G

TEST_FILE = r"(?i)(?:^|/)(?:__tests__/|test/|tests/)|\.(?:test|spec)\.[^.]+$"


def naming_style(path: Column | str) -> Column:
    stem = F.regexp_replace(F.regexp_replace(P.basename(path), r"(?:\.d)?\.[^.]+$", ""), r"\.(?:test|spec)$", "")
    return (
        F.when(F.lower(stem).isin("", "index", "main"), None)
        .when(stem.rlike(r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$"), "kebab-case")
        .when(stem.rlike(r"^[a-z][a-zA-Z0-9]*$") & stem.rlike("[A-Z]"), "camelCase")
        .when(stem.rlike(r"^[A-Z][a-zA-Z0-9]*$"), "PascalCase")
        .when(stem.rlike(r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"), "snake_case")
    )


def naming_convention(files: DataFrame, keys: Sequence[str] = ("repo_id",), least: int = 3, share: float = 0.7) -> DataFrame:
    """(keys..., style, n, total, percentage) where one style names at least ``share`` of at least ``least`` classified files."""
    counts = files.select(*keys, naming_style("path").alias("style")).filter("style IS NOT NULL").groupBy(*keys, "style").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.min_by("style", F.struct(-F.col("n"), "style")).alias("style"), F.max("n").alias("n"))
    return best.filter((F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).select(*keys, "style", "n", "total", (F.floor(F.col("n") / F.col("total") * 1000 + 0.5) / 10).alias("percentage"))


def source_root(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys..., in_src, total) where at least 60 % of at least 3 files lie under ``src/``."""
    out = files.groupBy(*keys).agg(F.count_if(P.normalise("path").startswith("src/")).alias("in_src"), F.count(F.lit(1)).alias("total"))
    return out.filter((F.col("total") >= 3) & (F.col("in_src") / F.col("total") >= 0.6))


def test_layout(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    p = P.normalise("path")
    out = files.filter(p.rlike(TEST_FILE)).groupBy(*keys).agg(F.count(F.lit(1)).alias("test_files"), F.count_if(F.col("path").rlike(r"(?i)\.(?:test|spec)\.[^.]+$")).alias("colocated"))
    return out.withColumn("style", F.when(F.col("colocated") >= F.col("test_files") / 2, "co-located").otherwise("dedicated-directory"))


def export_style(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``files`` has ``exports`` (array of structs with ``type``). Named wins a tie."""
    has = lambda t: F.count_if(F.exists("exports", lambda e: e["type"] == t))
    out = files.groupBy(*keys).agg(has("default").alias("default_files"), has("named").alias("named_files")).filter("default_files + named_files > 0")
    return out.withColumn("style", F.when(F.col("default_files") > F.col("named_files"), "default").otherwise("named"))


def is_barrel() -> Column:
    return (F.size("exports") > 0) & F.forall("exports", lambda e: e["type"].isin("barrel", "re-export"))


def barrel_pattern(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    return files.filter(is_barrel()).groupBy(*keys).agg(F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_list("path")).alias("files"), F.sum(F.size("exports")).alias("re_exports"))


def dynamic_imports(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    return files.select(*keys, "path", F.explode("imports").alias("i")).filter("i.isDynamic").select(*keys, "path", F.col("i.source").alias("source"))


def risk_id(kind: Column, entities: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("risk"), kind, F.array_join(F.array_sort(entities), ":")), 256)


def _risk(df: DataFrame, keys: Sequence[str], kind: str, severity: Column, measured: Column, affected: Column | None = None) -> DataFrame:
    entities = affected if affected is not None else F.array("path")
    return df.select(*keys, risk_id(F.lit(kind), entities).alias("id"), F.lit(kind).alias("type"), severity.alias("severity"), F.array_sort(entities).alias("affected"), measured.cast("double").alias("measured"))


def high_complexity(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    c = F.col("complexity")
    return _risk(files.filter(c >= 20), keys, "high-complexity", F.when(c >= 40, "critical").when(c >= 30, "high").otherwise("medium"), c)


def large_file(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    c = F.col("lines_of_code")
    return _risk(files.filter(c >= 500), keys, "large-file", F.when(c >= 1000, "high").otherwise("medium"), c)


def excessive_imports(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``files`` has ``n_imports``."""
    c = F.col("n_imports")
    return _risk(files.filter(c >= 20), keys, "excessive-imports", F.when(c >= 40, "high").otherwise("medium"), c)


def orphan_files(files: DataFrame, edges: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Files without a file neighbour, in graphs of more than one file."""
    inner = edges.filter(~F.col("src").startswith("external:") & ~F.col("dst").startswith("external:"))
    ends = inner.select(*keys, F.explode(F.array("src", "dst")).alias("path")).distinct()
    lone = files.join(ends, [*keys, "path"], "left_anti")
    many = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    lone = lone.join(many, list(keys), "left_semi")
    return _risk(lone, keys, "orphan-file", F.lit("low"), F.lit(None))


def unstable_modules(edges: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    inner = edges.filter(~F.col("src").startswith("external:") & ~F.col("dst").startswith("external:"))
    d = G.degrees(inner, keys).withColumnRenamed("id", "path")
    ratio = F.col("out_degree") / (F.col("in_degree") + F.col("out_degree"))
    return _risk(d.filter((F.col("out_degree") >= 8) & (ratio >= 0.8)), keys, "unstable-module", F.when(F.col("out_degree") >= 15, "high").otherwise("medium"), F.floor(ratio * 1000 + 0.5) / 1000)


def barrel_explosion(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    c = F.size("exports")
    return _risk(files.filter(is_barrel() & (c >= 15)), keys, "barrel-explosion", F.when(c >= 30, "high").otherwise("medium"), c)


def cycle_risks(cycles: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Two cycles over the same files share an id; the first by chain holds."""
    members = F.slice("chain", F.lit(1), F.col("length"))
    out = _risk(cycles, keys, "circular-dependency", F.when(F.col("length") >= 4, "high").otherwise("medium"), F.col("length"), members)
    held = F.min_by(F.struct("severity", "affected", "measured"), "affected").alias("h")
    return out.groupBy(*keys, "id", "type").agg(held).select(*keys, "id", "type", "h.*")


def all_risks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
