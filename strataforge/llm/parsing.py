"""Source files that don't parse: memoised parsing with derivatives over token streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.grammars import check
from strataforge.functions.lexing import LANGUAGES, lex
from strataforge.functions.rows import flat_map


def fault_of(language: str | None, content: str | None) -> tuple[str | None, int, str]:
    """(fault, line, text of the failing token). Fault is None, ``token`` or ``truncated``; lines count from 1."""
    lexed = lex(language, content or "")
    verdict = check(language, lexed)
    if verdict.fault is None:
        return None, 0, ""
    at = lexed.starts[verdict.index] if verdict.fault == "token" else len(lexed.text)
    token = lexed.text[at : lexed.ends[verdict.index]][:80] if verdict.fault == "token" else ""
    return verdict.fault, (content or "").count("\n", 0, at) + 1, token


def _each(rows: Iterator[tuple]) -> Iterator[tuple]:
    for file_id, repo_id, language, content in rows:
        yield (file_id, repo_id, language, *fault_of(language, content))


def source_faults(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` in a known language: file_id, repo_id, language, fault, line_no, token.

    ``fault`` is null for valid text, ``token`` where a token's derivative is empty (``line_no`` and ``token``
    name it) and ``truncated`` where the text ends inside a construct. Null or empty content and
    comments alone are valid; a leading byte-order mark is allowed. Rows with a null or unknown language
    aren't source files and give nothing. Names, types and other rules beyond syntax aren't judged.
    """
    source = files.filter(F.col("language").isin(*LANGUAGES))
    return flat_map(source, ["file_id", "repo_id", "language", "content"], _each, "file_id bigint, repo_id bigint, language string, fault string, line_no int, token string")


def invalid_files(files: DataFrame) -> DataFrame:
    """Distinct ids of files of which a row is invalid."""
    return source_faults(files).filter("fault IS NOT NULL").select("file_id").distinct()


def fault_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their share for each repository and language. A repeated file counts once."""
    one = source_faults(files).groupBy("repo_id", "language", "file_id").agg(F.max(F.col("fault").isNotNull().cast("int")).alias("bad"))
    return one.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bad").alias("n_invalid"), (F.sum("bad") / F.count(F.lit(1))).alias("invalid_rate")
    )
