"""Cutting the lineage of loops by written tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Delete what loops of this process wrote."""
    try:
        while _written:
            spark, path = _written.pop()
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        return


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and the master is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="tripleloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def place(spark: SparkSession, what: str = "loop") -> str:
    """A new path in the shared folder, deleted with the process."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, by_shuffle: bool = False) -> DataFrame:
    """The rows written and read back.  ``by_shuffle``: joins with them are merged and never broadcast, for a loop over tables that grow with
    the input: by the size of their compressed files each round would send many times as much through the driver."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if by_shuffle else out


class Grown:
    """What a loop has found so far, as one folder a round: a round writes its own rows and none of those before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, place(spark)
        self.schema, self.rounds = None, []

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of this round, written and read back."""
        path = f"{self.path}/{len(self.rounds):06d}"
        df.write.parquet(path)
        self.schema = self.schema or df.schema
        self.rounds.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        """The rows of all rounds."""
        return self.spark.read.schema(self.schema).parquet(*self.rounds)
