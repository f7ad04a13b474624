"""The scalar functions for SQL: temporary functions whose bodies are SQL, so that Catalyst sees through them.

They give what the column expressions of this folder give; text chunkers that need Python are registered as
Arrow functions under the names in ``PYTHON``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import chunking, vectors
from .scoring import DECAY_RATE, LEVEL_WEIGHT

_SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
_WEIGHTS = " ".join(f"WHEN '{level}' THEN {weight}D" for level, weight in LEVEL_WEIGHT.items())
_VECTORS = "a array<double>, b array<double>"

#: name: (parameters, type, body)
SQL_FUNCTIONS = {
    "l2_distance": (_VECTORS, "double", f"CASE WHEN size(a) <> size(b) THEN double('infinity') ELSE sqrt({_SUM.format('(x - y) * (x - y)')}) END"),
    "dot_product": (_VECTORS, "double", f"CASE WHEN size(a) = size(b) THEN {_SUM.format('x * y')} END"),
    "vector_norm": ("a array<double>", "double", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "cosine_similarity": (_VECTORS, "double", "try_divide(dot_product(a, b), vector_norm(a) * vector_norm(b))"),
    "similarity": ("distance double", "double", "1D / (1D + distance)"),
    "age_days": ("ts timestamp, at timestamp", "bigint", "CASE WHEN unix_seconds(ts) > 0 THEN (unix_seconds(at) - unix_seconds(ts)) DIV 86400 ELSE 0 END"),
    "time_decay": ("age bigint", "double", f"exp(-{DECAY_RATE}D * greatest(age, 0))"),
    "confidence_level": (
        "content_type string, age bigint, is_current boolean", "string",
        """CASE WHEN content_type IN ('File', 'Symbol') THEN CASE WHEN coalesce(is_current, true) THEN 'Highest' ELSE 'Low' END WHEN content_type IN ('Commit', 'GitDiff', 'Plan') THEN 'High'
        WHEN content_type IN ('Message', 'Session') THEN CASE WHEN age <= 7 THEN 'Medium' WHEN age <= 30 THEN 'Low' ELSE 'Lowest' END END""",
    ),
    "base_weight": ("level string", "double", f"CASE level {_WEIGHTS} END"),
    "final_score": ("similarity_ double, age bigint, weight double", "double", "similarity_ * time_decay(age) * weight"),
    "first_line": ("message string", "string", r"regexp_extract(message, r'^([^\r\n]*)', 1)"),
    "encode_project_path": ("path string", "string", "replace(replace(path, '-', '_'), '/', '-')"),
    "decode_project_path": ("name string", "string", "replace(replace(name, '-', '/'), '_', '-')"),
    "markdown_title": ("content string", "string", r"nullif(regexp_extract(content, r'(?m)^# ([^\r\n]*)', 1), '')"),
    "forward_slashes": ("path string", "string", r"replace(path, r'\', '/')"),
}

PYTHON = {
    "chunk_message": chunking.chunk_message, "chunk_markdown": chunking.chunk_markdown, "chunk_symbol": chunking.chunk_symbol, "chunk_document": chunking.chunk_document,
    "clean_markdown": chunking.cleaned_markdown, "text_vector": vectors.text_vector,
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session and gives their names."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    for name, f in PYTHON.items():
        spark.udf.register(name, f)
    return [*SQL_FUNCTIONS, *PYTHON]
