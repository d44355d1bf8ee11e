"""Tables and lineage cutting, both taken from the session alone."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they need no installation and no path.

    Spark's file server hands the archive to every executor, those that join later included.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="rollcall-package-"), "rollcall-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("rollcall", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches: that of `spark.checkpoint.dir`, or the one set on the context.

    Where neither exists, a local session gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rollcall-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage.

    The written rows get a plan of their own: the plan that checkpoint() returns still holds on to the one it came from,
    which in a loop doubles with every round.
    """
    spark = df.sparkSession
    ship(spark)
    shared_folder(spark)
    written = df.checkpoint(eager=True)
    plain = spark._jsparkSession.internalCreateDataFrame(written._jdf.queryExecution().toRdd(), written._jdf.schema(), False)
    return DataFrame(plain, spark)
