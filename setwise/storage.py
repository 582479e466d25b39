"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh local one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="setwise-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone when the interpreter ends
        pass


_written: dict[int, list[tuple[SparkSession, str]]] = {}


def _remove_all() -> None:
    for spark, path in [x for each in _written.values() for x in each]:
        _remove_quietly(spark, path)


atexit.register(_remove_all)


class Scratch:
    """Tables written once under the shared folder: they cut lineage and outlive lost executors.

    ``save`` writes and rereads; ``drop`` removes a table that nothing needs any more, ``clear`` all of them.
    What a result still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
        self._count = 0
        _written.setdefault(id(spark), []).append((spark, self.root))

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self._count:03d}-{name}"
        self._count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _remove_quietly(self.spark, table._scratch_path)

    def clear(self) -> None:
        _remove_quietly(self.spark, self.root)
        _written[id(self.spark)].remove((self.spark, self.root))
