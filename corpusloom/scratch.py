"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing each round as Parquet below
``spark.checkpoint.dir`` and reading it back, so a lost executor costs one
task, not the whole history.  What a loop no longer needs is dropped at once,
the rest when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a session that runs in one process gets a
    temporary folder (tests); on a cluster executors would write to their own
    disks, so it raises.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return place.rstrip("/")


class Scratch:
    """Named Parquet tables of one operator call, below one folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
        self._n = 0
        fs, p = self._place(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by ``save`` that nothing still pending reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def _delete(self, path: str) -> None:
        fs, p = self._place(path)
        fs.delete(p, True)

    def _place(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p
