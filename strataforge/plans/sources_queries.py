"""Queries of the parser over the files of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import graph as G
from strataforge.sources import parse as R
from strataforge.runtime import table


KEYS = ["repo_id"]


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "file_input").filter("language IS NOT NULL").select("repo_id", F.col("relative_path").alias("path"), "language", "content").distinct()


def _parsed(s: SparkSession, d: str) -> DataFrame:
    """Equal files of different repositories are files of their own."""
    return R.parse(_files(s, d), KEYS)


def parsed_files(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("repo_id", "path", "language", "hash", "size", "linesOfCode", "complexity", F.size("imports").alias("n_imports"), F.size("functions").alias("n_functions"), F.size("classes").alias("n_classes"), "error")


def parsed_identity(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("repo_id", "path", "language", "hash", "size", F.sha2(F.concat_ws(":", "path", "hash"), 256).alias("own"), "id")


def parsed_go_functions(s: SparkSession, d: str) -> DataFrame:
    """Functions of Go files by name."""
    f = _parsed(s, d).filter("language = 'go' AND error IS NULL").select("repo_id", "path", F.explode("functions.name").alias("name"))
    return f.groupBy("repo_id", "path").agg(F.sort_array(F.collect_set("name")).alias("names"))


def parsed_coverage(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "file_input").select("repo_id", F.col("relative_path").alias("path"), F.coalesce("language", F.lit("config")).alias("language"), "content").distinct()
    rows = R.parse(files, KEYS)
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").startswith("unsupported")).alias("n_unsupported"), F.sum("size").alias("size"))


def parsed_graph(s: SparkSession, d: str) -> DataFrame:
    """Edges within each repository; of a path with several contents the greatest hash holds."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("hash")))
    held = _parsed(s, d).withColumn("_n", newest).filter("_n = 1").drop("_n")
    return G.build_graph(held, KEYS)[1]


def external_packages(s: SparkSession, d: str) -> DataFrame:
    """Packages that each repository's files import."""
    return parsed_graph(s, d).filter("is_external").groupBy("repo_id", "dst").agg(F.count(F.lit(1)).alias("n"))


def line_counts(s: SparkSession, d: str) -> DataFrame:
    """Non-blank lines, size, hash of document texts."""
    t = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("bigint").alias("size"), F.size(F.filter(F.split("text", "\n"), lambda l: l.rlike(r"\S"))).alias("lines"))


def duplicate_content(s: SparkSession, d: str) -> DataFrame:
    """Contents that several documents share: each is worked on once."""
    return line_counts(s, d).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def python_lines(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "file_input").filter("language = 'python' AND content IS NOT NULL").select("file_id", "content").distinct()
    return f.select("file_id", F.size(F.filter(F.split("content", "\n"), lambda l: l.rlike(r"\S") & ~l.rlike(r"^\s*#"))).alias("lines"))


QUERIES = {"parsed_files": parsed_files, "parsed_identity": parsed_identity, "parsed_go_functions": parsed_go_functions, "parsed_coverage": parsed_coverage, "parsed_graph": parsed_graph, "external_packages": external_packages, "content_hash_and_lines": line_counts, "duplicate_content": duplicate_content, "python_line_count": python_lines}
_CONTENT = "coalesce(content, '')"
SQL = {
    "parsed_identity": f"SELECT repo_id, path, language, hash, octet_length(encode(content)) AS size, sha256(path || ':' || hash) AS own, sha256(path || ':' || hash) AS id FROM (SELECT DISTINCT repo_id, relative_path AS path, language, {_CONTENT} AS content, sha256({_CONTENT}) AS hash FROM file_input WHERE language IS NOT NULL)",
    "parsed_coverage": f"SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE language IS NULL) AS n_unsupported, sum(octet_length(encode(content)))::BIGINT AS size FROM (SELECT DISTINCT repo_id, relative_path, language, {_CONTENT} AS content FROM file_input) GROUP BY repo_id",
    "content_hash_and_lines": "SELECT doc_id, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS size, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\s\\x0b]'))) AS lines FROM documents",
    "duplicate_content": "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "python_line_count": "SELECT file_id, len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '[^\\s\\x0b]') AND NOT regexp_matches(l, '^[\\s\\x0b]*#'))) AS lines FROM (SELECT DISTINCT file_id, content FROM file_input WHERE language = 'python' AND content IS NOT NULL)",
}
