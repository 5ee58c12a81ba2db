"""Tables written to the cluster's shared folder to cut lineage, and how code reaches the Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

BATCH_ROWS = 2000
#: A side of a join is broadcast only when its counted rows take fewer bytes than this.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a fresh temporary one if all of Spark is one
    local process (tests); on a cluster executors would not see each other's files, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Spool:
    """Writes intermediate tables as Parquet under the shared folder, so that a lost executor costs one stage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
        ship(spark)
        # long texts come in smaller Arrow batches than Spark's 10,000 rows, which both the executor and its workers hold
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(conf).delete(path, True)


def keep_matching(df: DataFrame, keys: DataFrame, on: str, row_bytes: int = 16) -> DataFrame:
    """Semi-join. ``keys`` (a written table) is broadcast when its counted size is small, else both sides are shuffled."""
    small = keys.count() * row_bytes <= BROADCAST_BYTES
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, "left_semi")
