"""Shared-storage materialisation, so that a lost executor never costs more than one stage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is absent, a local one, but only with a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidecast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark._jvm, spark._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, df_path: str) -> None:
    """Delete a table written by materialise() once nothing will read it again."""
    _delete(spark, df_path)
    _written[:] = [x for x in _written if x[1] != df_path]


def materialise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    keep: if given, receives the path so that the caller can release() it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidecast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    if keep is not None:
        keep.append(path)
    # Spark deletes a finished query's shuffle files once the driver has collected its plan: ask, rather than wait.
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            return
