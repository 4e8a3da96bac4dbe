"""Job queues as files per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTRY_SCHEMA = "entry_id string, enqueued_at timestamp, fields map<string,string>"


def read_queue(spark: SparkSession, path: str, stream: str, files_per_batch: int = 10) -> DataFrame:
    """New entries of one stream, a bounded number of files per micro-batch.

    Entries written since the last checkpoint are read once; the checkpoint plays the consumer group.
    """
    return (
        spark.readStream.schema(ENTRY_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path}/stream={stream}")
    )


def read_kafka_queue(spark: SparkSession, servers: str, topic: str, offsets_per_batch: int = 100_000) -> DataFrame:
    """S4 over Kafka, for clusters that have the connector: (entry_id, enqueued_at, fields), the fields from a JSON object."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_batch)
        .load()
    )
    return kafka_entries(source)


def kafka_entries(records: DataFrame) -> DataFrame:
    """Entries (entry_id, enqueued_at, fields) from Kafka's records: the id is partition-offset, a value that is no JSON object has NULL fields."""
    return records.selectExpr("concat(partition, '-', offset) AS entry_id", "timestamp AS enqueued_at", "from_json(CAST(value AS STRING), 'map<string,string>') AS fields")
