"""Topic input and output: Kafka on a cluster, files where no broker exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TOPIC_RECORD


def read_topic(
    spark: SparkSession,
    topic: str,
    bootstrap_servers: str | None = None,
    path: str | None = None,
    max_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Stream of ``(key, value, topic, partition, offset, timestamp)`` of one topic, from its start.

    With ``path`` the records come from Parquet files of the same shape instead
    of a broker; ``max_per_trigger`` then counts files, not records.
    """
    if path is not None:
        reader = spark.readStream.format("parquet").schema(TOPIC_RECORD)
        if max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_per_trigger))
        return reader.load(path).filter(F.col("topic") == topic)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "true")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_per_trigger))
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def write_topic(records: DataFrame, bootstrap_servers: str | None = None, path: str | None = None) -> None:
    """Append ``(topic, key, value)`` records to their topics, or to Parquet files under ``path``."""
    out = records.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    if path is not None:
        out.write.mode("append").parquet(path)
    else:
        out.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).save()


def streams_union(*streams: DataFrame) -> DataFrame:
    """One stream out of several, columns matched by name."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
