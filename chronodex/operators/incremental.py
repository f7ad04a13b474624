"""Change sets between a stored and a current table, and what is derived from them."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_set(current: DataFrame, stored: DataFrame, key: str, version: str, time: str | None = None) -> DataFrame:
    """``key`` and ``change`` (new, changed, deleted, unchanged) by one full outer join.

    Keys must be unique on each side. Versions are compared null-safely. With ``time`` a row is changed
    too if its time is later than the stored one's. Empty sides are fine.
    """
    a = current.select(F.col(key), F.col(version).alias("_now"), (F.col(time) if time else F.lit(None)).alias("_at"), F.lit(True).alias("_there"))
    b = stored.select(F.col(key), F.col(version).alias("_then"), (F.col(time) if time else F.lit(None)).alias("_since"), F.lit(True).alias("_was"))
    same = F.col("_now").eqNullSafe(F.col("_then"))
    if time:
        same = same & ~F.coalesce(F.col("_at") > F.col("_since"), F.lit(False))
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_there").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def to_index(current: DataFrame, state: DataFrame, key: str, time: str, indexed_at: str) -> DataFrame:
    """``key`` and ``reason`` of what has to be indexed: ``new`` without a state, ``later`` if changed since.

    ``state`` has one row per key. Rows with a null time that have a state stay.
    """
    known = state.select(F.col(key), F.col(indexed_at).alias("_at"), F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "new").when(F.col(time) > F.col("_at"), "later")
    return current.join(known, key, "left").select(key, reason.alias("reason")).filter("reason is not null")


def set_index_state(stored: DataFrame, done: DataFrame) -> DataFrame:
    """States (``id``, ``indexed_at``) with those of a run merged in; the latest time of an id counts."""
    return stored.unionByName(done).groupBy("id").agg(F.max("indexed_at").alias("indexed_at"))


def clear_branch(df: DataFrame, branch: str, column: str = "branch_name") -> DataFrame:
    """The rows of all other branches; rows without a branch are left out."""
    return df.filter(F.col(column) != branch)


def write_branches(df: DataFrame, path: str, column: str = "branch_name") -> None:
    """Writes rows into one folder per branch; only the branches that ``df`` holds are overwritten."""
    df.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def drop_branch(spark: SparkSession, path: str, branch: str, column: str = "branch_name") -> bool:
    """Deletes the folder of a branch below ``path``; whether there was one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={quote(branch, safe='')}")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored rows with the changes merged in: for each key the row with the latest version counts."""
    from ..tables import latest

    return latest(stored.unionByName(changes, allowMissingColumns=True), keys, version)


def id_lists(df: DataFrame, key: str, member: str, most: int = 1000) -> DataFrame:
    """``key``, ``block``, ``ids``: for each key the sorted distinct members, in blocks of about ``most``.

    Members are made distinct before they are collected; a key with more than ``most`` of them has several
    blocks, by the hash of the member, so no list grows with the data. Null members are left out.
    """
    each = df.filter(F.col(member).isNotNull()).select(key, member).distinct()
    sizes = each.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_blocks"))
    placed = each.join(sizes.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).withColumn("block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    return placed.groupBy(key, "block").agg(F.array_sort(F.collect_list(member)).alias("ids"))


def roots(df: DataFrame, key: str, parent: str, scope: str) -> DataFrame:
    """``scope``, ``key``, ``root`` and ``depth``: the topmost ancestor of each row, and how far up it is.

    Pointer doubling: each round joins every row's highest known ancestor with that one's own, so the
    rounds grow with the logarithm of the depth, which is not limited. Rows whose ancestors are missing
    or form a circle have no root and are left out. ``df`` has one row per scope, key and parent.
    """
    from ..session import materialize

    name = lambda c: F.to_json(F.struct(F.col(scope).alias("s"), F.col(c).alias("k")))
    below = F.col(parent).isNotNull()
    # each node's pointer goes to an ancestor ``depth`` steps above it, a root's to itself
    nodes = materialize(df.select(scope, key, name(key).alias("node"), F.when(below, name(parent)).otherwise(name(key)).alias("up"), below.cast("int").alias("depth"), F.lit(False).alias("done")), "roots")
    n, reach = nodes.count(), 1
    while reach <= 2 * n and not nodes.filter("not done").isEmpty():
        there = nodes.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = nodes.join(there, F.col("up") == F.col("_node"))  # a pointer into nothing ends here
        nodes = materialize(moved.select(scope, key, "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_depth") == 0).alias("done")), "roots")
        reach *= 2
    return nodes.filter("done").select(scope, key, F.get_json_object("up", "$.k").alias("root"), "depth")
