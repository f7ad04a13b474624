"""Order-dependent operators that stay balanced when one key holds a large share of the rows.

A plain window over ``partitionBy(key)`` puts a whole key into one task. These operators split a
key's rows into buckets of its time axis, work inside each bucket, and carry what crosses a bucket
border in one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_previous(df: DataFrame, key: str, order: list[str], carry: list[str], bucket: Column, prefix: str = "prev_") -> DataFrame:
    """Adds the ``carry`` columns of the row before, as ``prefix`` + name, plus ``prefix + 'exists'``.

    "Before" is within ``key``, by the columns of ``order``. ``bucket`` must not decrease along that
    order (for example ``date_trunc('hour', ts)``). Rows are partitioned by (key, bucket); only the
    last row of each bucket crosses to the next one, so no task ever holds a whole key.

    Rows with equal order columns come in the order of the remaining order columns; give an id last
    to make it total. The first row of a key gets nulls and ``exists = false``. Null keys form one
    group, and so do null buckets of a key. Empty input, empty output. The input must not already have
    the new column names.
    """
    exists = f"{prefix}exists"
    row = F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in carry])
    # one column without nulls names the group, so the join below keeps the window's partitioning
    df = df.withColumn("_bucket", bucket).withColumn("_group", F.to_json(F.struct(F.col(key).alias("k"), F.col("_bucket").alias("b"))))
    inside = Window.partitionBy("_group").orderBy(*order)
    df = df.withColumn("_prev", F.lag(row).over(inside)).withColumn("_more", F.lead(F.lit(True)).over(inside))
    # one row per group: its last row, shifted to the next bucket of the key
    ends = df.filter("_more is null").select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.col("_group").alias("_g"), row.alias("_end"))
    across = Window.partitionBy("_k").orderBy("_b")
    ends = ends.withColumn("_before", F.lag("_end").over(across)).filter("_before is not null").select("_g", "_before")
    out = df.join(ends, F.col("_prev").isNull() & (F.col("_group") == F.col("_g")), "left").withColumn("_prev", F.coalesce("_prev", "_before"))
    for c in carry:
        out = out.withColumn(prefix + c, F.col("_prev")[c])
    return out.withColumn(exists, F.col("_prev").isNotNull()).drop("_prev", "_bucket", "_before", "_group", "_g", "_more")


def changes(df: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """The rows at which ``value`` is another than in the row before of the same key, with ``prev_`` + value.

    The first row of a key is no change; null is a value like others. Order, ties and skew as in
    :func:`bucketed_previous`.
    """
    rows = bucketed_previous(df, key, order, [value], bucket)
    return rows.filter(F.col("prev_exists") & ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).drop("prev_exists")


def bucketed_rank(df: DataFrame, key: str, order: list[str], bucket: Column, name: str = "position") -> DataFrame:
    """Numbers the rows of each key from 1 by ``order``, without one task per key.

    Row numbers inside (key, bucket) plus the running count of the buckets before. Same conditions
    on ``bucket`` and ties as in :func:`bucketed_previous`.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    out = df.withColumn("_i", F.row_number().over(inside)).join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return out.withColumn(name, (F.col("_offset") + F.col("_i")).cast("int")).drop("_k", "_b", "_offset", "_i", "_bucket")
