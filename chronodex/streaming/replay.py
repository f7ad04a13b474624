"""Running a stored table through a streaming query until it is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ..session import remove, scratch_path


_CONF = {
    # state on the executors' disks, so its size is not that of their memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a task's copy of its state goes when the task ends; the state itself is in the shared folder
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # shuffle files of a micro-batch go when it ends
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def replay(spark: SparkSession, path: str, schema: T.StructType, build: Callable[[DataFrame], DataFrame], end: dict, name: str = "replay") -> DataFrame:
    """What ``build`` emits for the rows stored under ``path``, in append mode.

    A second source of the stream holds one row, ``end`` (missing columns are null), whose event time
    lies after all others: it moves the watermark past every open window, so all of them are emitted.
    The stored rows come in one micro-batch, before the watermark moves, so none is late. Output and
    stream state are written to the shared scratch folder; only the output is left when the stream has ended.
    """
    marker, out, state = (scratch_path(spark, f"{name}-{x}") for x in ("end", "out", "state"))
    fields = [f.name for f in schema]
    spark.createDataFrame([Row(**{f: end.get(f) for f in fields})], schema).coalesce(1).write.parquet(marker)
    read = spark.readStream.schema(schema)
    # as a glob, the path may name a folder or a single file
    stream = read.parquet(f"{path[:-1]}[{path[-1]}]").select(*fields).unionByName(read.parquet(marker).select(*fields))
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        query = build(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    remove(spark, state, marker)
    return spark.read.parquet(out)
