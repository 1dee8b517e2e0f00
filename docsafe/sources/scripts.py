"""String literals of Python sources, to be searched for terms."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "array<struct<line:int,value:string>>"


def literals(source: str | None) -> list[dict]:
    """Line and value of every string constant in the order of lines; none of a source that does not parse. Surrogates, which
    no column holds, are replaced."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = [(n.lineno, n.col_offset, n.value) for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    return [{"line": line, "value": v.encode("utf-8", "replace").decode("utf-8")} for line, _, v in sorted(found)]


def string_literals(sources: DataFrame) -> DataFrame:
    """path, line, value of sources (path, value); a null source has none."""

    @F.pandas_udf(TYPE)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(literals, na_action=None)

    return sources.select("path", F.explode(read("value")).alias("s")).select("path", "s.line", "s.value")


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """path, value of the Python files below a path, one a row; files that are no UTF-8 have a null value."""
    files = spark.read.option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).format("binaryFile").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("value"))
