"""SparkSession factory and the shared-folder helper that every iterative operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` overrides any setting."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset on a local master (tests on one machine) a temporary
    folder of this machine takes its place; elsewhere executors would not see one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where the tables of this application are; `drop_tables` removes it."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def table(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all that `table` has written in this application. DataFrames that read it cannot be used any more."""
    delete(spark, tables_dir(spark))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, in order; none where there is no such folder."""
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tessera_shipped = True
