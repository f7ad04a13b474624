"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "chronodex", **conf: str) -> SparkSession:
    """A session with the settings that the package assumes (UTC, AQE, Arrow).

    Only for local runs and tests; on a cluster the caller's session is used as it is.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.parquet.filterPushdown": "true",
    }
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing on one machine (tests) a temporary folder is made and stored in the
    session's checkpoint setting, so that the same folder is used for the whole session. On a cluster
    the setting is required, since a machine's own folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/chronodex/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as parquet into the shared scratch folder and reads it back.

    Cuts the lineage; the written table survives the loss of an executor, because it lies in the
    folder that all of them share. The shuffle files of the step are removed once it is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared scratch folder; any other is left alone."""
    below = scratch_root(spark).rpartition("://")[2] + "/chronodex/"
    for path in paths:
        if below in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    remove(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so the workers must be able to
    import the package. A zip of it goes into the shared scratch folder and is added to the session.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, buffer = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    target = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "code") + f"/{root.name}.zip")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    context.addPyFile(str(target.toString()))
    _shipped.add(context.applicationId)
