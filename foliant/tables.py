"""Access to the parquet tables and to the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set in `sf_dir`; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_even(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`load` for heavy work on single rows: a table that is read in fewer partitions than there are cores is dealt out
    evenly, which moves next to nothing; larger tables stay as they lie."""
    table, cores = load(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or one set on the context. A local master without any
    gets its own, which goes with the process; a cluster without one is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """The address of a new folder in the shared one; all of a session's lie together."""
    return f"{shared_dir(spark).rstrip('/')}/foliant/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all that this session wrote to the shared folder. Tables that still read it must not be used after."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/foliant/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage is cut, an executor's loss costs nothing,
    and every later use reads the same rows."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
