"""Session settings and the shared working folder.

On a cluster the operator of the cluster owns the settings; ``get_session`` is
for tests, the bench and interactive use.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int = 8, partitions: int = 8, app: str = "graphloom") -> SparkSession:
    """A local session with adaptive execution on and UTC as its time zone."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests on one machine, a temporary folder takes its
    place; on a cluster an unset folder is an error, since executors would not
    see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    path = f"file://{path}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the application's part of the shared folder."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder.

    Results that are not written elsewhere yet still read from there.
    """
    remove_path(spark, work_dir(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and the reread
    table has sizes that the optimizer knows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system layer, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        remove_path(df.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
