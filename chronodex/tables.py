"""Reading the project tables, and the rule that says which version of a row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of the data folder; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, keys: list[str], version: Column | str, tie: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``version`` for each key.

    Aggregates with ``max_by``, which combines on the map side, so a key that is stored many times
    costs one row per partition in the shuffle (a window would move every version). Null versions
    lose to any value. Ties are broken by the columns of ``tie`` (default: a 64-bit hash of the whole
    row, so that only what is selected travels, and once); repeated rows give one row. Select the
    columns that are needed before: all of ``df`` is shuffled. Rows whose key is null are kept as one
    group. An empty input gives an empty result; extra columns pass through.
    """
    version = F.col(version) if isinstance(version, str) else version
    rest = [c for c in df.columns if c not in keys]
    hashable = [F.col(c) for c, t in df.dtypes if c not in keys and "map<" not in t and "variant" not in t]
    last = [F.col(c) for c in tie] if tie is not None else [F.xxhash64(*hashable).alias("_tie")] if hashable else []
    order = F.struct(version.isNotNull().alias("_has"), version.alias("_version"), *last)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


ROLE_NAMES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "system"}


def role_of(role: Column) -> Column:
    """``user``, ``assistant`` or ``system`` for any spelling of them, else null."""
    clean = F.lower(F.trim(role))
    out = F.lit(None).cast("string")
    for spelled, name in ROLE_NAMES.items():
        out = F.when(clean == spelled, F.lit(name)).otherwise(out)
    return out


def _current(spark: SparkSession, sf_dir: str, name: str, version: str, columns: tuple[str, ...]) -> DataFrame:
    wanted = list(dict.fromkeys(["id", version, *columns])) if columns else []
    return latest(table(spark, sf_dir, name, *wanted), ["id"], version)


def messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The messages that count: for each id the row with the latest ``ingested_at``.

    With ``columns`` only these are read and shuffled, beside the id and the version.
    """
    return _current(spark, sf_dir, "messages", "ingested_at", columns)


def plans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The plans that count: for each id the row with the latest ``modified_at``."""
    return _current(spark, sf_dir, "plans", "modified_at", columns)


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The files that count: for each id the row with the latest ``modified_at``."""
    return _current(spark, sf_dir, "files", "modified_at", columns)
