"""Small helpers that the operators of this subpackage share."""

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, as in tests, gets a new temporary one where it is unset."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(key, found)
    return found


def save(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage is cut, and a lost executor loses nothing.

    With rows_per_file, for what may be small: df is first held on the executors'
    disks and counted, so that it is not written as a file for each shuffle partition.

    All tables of an application are in one folder, lectern-<its id>. discard()
    removes one; what a result is still read from stays until the folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if rows_per_file:
        held = df.persist(StorageLevel.DISK_ONLY)
        held.coalesce(-(-held.count() // rows_per_file) or 1).write.parquet(path)
        held.unpersist()
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*saved: DataFrame) -> None:
    """Remove tables that save() gave and that nothing reads any more."""
    for df in saved:
        if path := getattr(df, "_saved_at", None):
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
