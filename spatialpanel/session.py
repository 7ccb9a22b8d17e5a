"""Session helpers: where intermediate tables go and how they are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is empty (tests, local mode) a folder of our own is
    made; on a cluster the setting must name storage all executors reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="spatialpanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the application's own sub-folder of the shared folder."""
    return f"{shared_folder(spark)}/spatialpanel-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    Compressed and columnar, so it takes less disk than ``checkpoint()``. All
    tables of an application lie in one folder, to be deleted when it has ended;
    ``discard`` deletes those of a loop's earlier rounds.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def clear_written(spark: SparkSession) -> None:
    """Delete all intermediates of this application; results that still read them fail from then on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/spatialpanel-{spark.sparkContext.applicationId}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that nothing reads any more.

    Loops call it for the last round's tables once the next round's are written,
    so what lies on disk does not grow with the number of rounds. Anything else
    than a table of ``materialise`` is left alone.
    """
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
