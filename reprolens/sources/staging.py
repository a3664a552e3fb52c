"""Tables that cut a long lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A local one is made only where the session names none and runs in one process, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reprolens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST = 1 << 23  # bytes of a batch of rows that goes to Python, about, at most


def small_batches(spark: SparkSession) -> None:
    """Lets no batch of long texts fill a task's memory; a session that asks for smaller ones keeps them."""
    given = spark.conf.get(ARROW, None) or ""
    if not given.rstrip("b").isdigit() or int(given.rstrip("b")) > MOST:
        spark.conf.set(ARROW, str(MOST))


class Stage:
    """Tables that cut a long lineage, in the shared folder.

    A lost executor only loses running tasks: whatever was staged is read again from the shared
    folder. ``drop`` frees what later steps don't read; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        small_batches(spark)
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def bucketed(self, df: DataFrame, name: str, n: int, key: str) -> DataFrame:
        """Rows dealt once into n files by key: joins by that key read them as they lie."""
        table = f"{name}_{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).option("path", f"{self.root}/{name}").format("parquet").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def free(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now: it does so once the driver's heap is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            while self.tables and not name:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans it
            return
