"""Queries on symbols that are read from the texts of files.

No SQL can parse source code: these are tested against small texts with known symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.symbols import extract_symbols, source_texts


def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of each source file that counts; files with syntax errors give none."""
    return extract_symbols(source_texts(spark, sf_dir)).filter("error is null").drop("error")


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols each source file has, and the error of those whose text is broken."""
    found = extract_symbols(source_texts(spark, sf_dir).filter("content <> ''"))
    return found.groupBy("file_id").agg(F.count("id").alias("n_symbols"), F.max("error").alias("error"))


QUERIES = {f.__name__: f for f in (extracted_symbols, symbol_counts)}
SQL: dict[str, str] = {}
