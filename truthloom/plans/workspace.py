"""Tables a job writes between its rounds.

Each round's state is written to the shared folder named by ``spark.checkpoint.dir`` and
read back.  That cuts the lineage of the loop, a lost executor never forces earlier rounds
to be recomputed, and the file sizes tell Spark which side of a join is small enough to
broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in one process without it, the session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


class Workspace:
    """One folder per job run below the shared folder.

    Results read their tables when they are asked for, so a folder lasts as long as its
    application: the JVM deletes it on exit.  ``drop`` deletes it earlier.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.path = f"{(folder or shared_folder(spark)).rstrip('/')}/truthloom/{app}/{uuid.uuid4().hex}"
        self._count = 0
        self._marked = False
        self._tables: list[str] = []

    def _folder(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _next(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{name}"

    def _mark(self) -> None:
        if not self._marked:
            folder, system = self._folder()
            self._marked = system.deleteOnExit(folder.getParent())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table that was written."""
        path = self._next(name)
        df.write.parquet(path)
        self._mark()
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str, dealt: bool = False) -> DataFrame:
        """Write ``df`` once, dealt by ``keys``; joins and groups on them need no shuffle of this table.

        ``dealt``: it is in ``buckets`` partitions by ``keys`` already.

        Spark knows the buckets of catalog tables only, so the table has a name in the session's
        catalog until ``drop``; its files lie in the folder like all others.
        """
        path = self._next(name)
        table = f"truthloom_{uuid.uuid4().hex}"
        (df if dealt else df.repartition(buckets, *keys)).write.option("path", path).bucketBy(buckets, *keys).saveAsTable(table, format="parquet")
        self._tables.append(table)
        self._mark()
        return self.spark.table(table)

    def drop(self) -> None:
        """Delete the folder; only after the results have been written elsewhere."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        folder, system = self._folder()
        system.delete(folder, True)
