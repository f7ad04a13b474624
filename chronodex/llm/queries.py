"""Registry of the training-data queries (pN_...) and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, credentials, functions_docs, leaks, neighbors, pairs, personal, residue, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": pairs.p1_found,
        "p2_found": functions_docs.p2_found,
        "p2_pairs": functions_docs.p2_pairs,
        "p3_found": conversations.p3_found,
        "p4_found": neighbors.p4_found,
        "p5_found": personal.p5_found,
        "p5_redacted": personal.p5_redacted,
        "p6_found": credentials.p6_found,
        "p6_redacted": credentials.p6_redacted,
        "p7_ids": tokenize.p7_ids,
        "p8_found": leaks.p8_found,
        "p9_found": residue.p9_found,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; that of problem 4 is exact and quadratic, for small tables."""
    return {"p3_found": conversations.P3_SQL, "p4_found": neighbors.P4_SQL}
