"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm import credentials, foreign_sources, function_docs, hidden_language, leakage, packing, parsing, residue
from strataforge.runtime import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.places(table(spark, sf_dir, "file_input"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold credentials, with these masked."""
    return credentials.redacted(table(spark, sf_dir, "file_input")).filter("n_masked > 0").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_docs.found(table(spark, sf_dir, "file_input"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_sources.found(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "file_input"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.invalid_files(table(spark, sf_dir, "file_input"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fault_rates(table(spark, sf_dir, "file_input"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_input")
    return hidden_language.language_texts(files, hidden_language.fit(table(spark, sf_dir, "documents"), files))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_language.found(_texts(spark, sf_dir))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_language.shares(_texts(spark, sf_dir))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_specs"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(packing.token_counts(table(spark, sf_dir, "documents")))
    specs = table(spark, sf_dir, "pack_specs")
    return packing.checks(sizes, cut(packing.packed(sizes, specs)), specs)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and paraphrases."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(table(spark, sf_dir, "documents"))


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_PLAIN = "regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '</?[A-Za-z][^<>]*>', ' ', 'g')"
_GRAMS = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"


def oracle_sql() -> dict[str, str]:
    words = lambda name, key: f"SELECT {key}, regexp_extract_all(lower({_PLAIN.format('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name} WHERE text IS NOT NULL"
    return {
        "p7_checks": "SELECT spec_id, capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_overfull, 0 AS n_loose, 0 AS n_split, 0 AS n_changed FROM pack_specs",
        "p8_found": f"WITH d AS ({words('documents', 'doc_id')}), i AS ({words('eval_items', 'item_id')}), di AS (SELECT doc_id, {_GRAMS} AS g FROM d WHERE len(w) >= 12), "
        f"ii AS (SELECT item_id, {_GRAMS} AS g FROM i WHERE len(w) >= 12) SELECT DISTINCT doc_id, item_id FROM di JOIN ii USING (g)"
    }
