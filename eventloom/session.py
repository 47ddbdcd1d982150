"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library is designed around; a cluster may override any of them.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # the JVM does not compile methods above 8000 bytes of bytecode: let Spark split them
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "eventloom") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster
    without it is an error, because a machine-local folder does not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="eventloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_SCRATCH = "eventloom.scratch"  # local property: threads that inherit it share the folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, or below the thread's ``scratch``."""
    return f"{spark.sparkContext.getLocalProperty(_SCRATCH) or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for all that is stored inside; at the end it goes, with the shuffle files of the queries that ran.

    Spark removes the files of a shuffle when the driver's collector finds that no plan holds it, which on
    a quiet driver may be half an hour later.
    """
    sc, folder = spark.sparkContext, run_folder(spark, name)
    outer = sc.getLocalProperty(_SCRATCH)
    sc.setLocalProperty(_SCRATCH, folder)
    try:
        yield folder
    finally:
        sc.setLocalProperty(_SCRATCH, outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    The rows go to Parquet files rather than to a checkpoint, which would keep the estimate of the plan
    it replaces: that plan drops parsed documents, seems tiny and would be broadcast whole by later joins.
    """
    path = run_folder(df.sparkSession, "durable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
