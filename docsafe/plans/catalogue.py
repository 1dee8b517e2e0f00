"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of docsafe.plans that hold QUERIES (name -> (callable, SQL or None)).
FLAGSHIP = "a4_document_rollup"


def _modules():
    from docsafe.plans import layout, lines, logs, pages, payloads, review, rules, segments, verdicts

    return (pages, lines, layout, review, segments, logs, verdicts, rules, payloads)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, (_, sql) in m.QUERIES.items() if sql}
