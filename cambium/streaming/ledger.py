"""Incremental replay of a merge ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cambium.operators.hierarchy import replay
from cambium.sources.sinks import write_table


class Replayer:
    """Applies the merges of each micro-batch to labels kept as numbered tables.

    A batch that is run again after a failure finds its table and leaves it,
    so labels are exact whatever is repeated.
    """

    def __init__(self, spark: SparkSession, labels: DataFrame, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.last = -1
        write_table(labels.select("cell", "node"), f"{self.path}/batch=-1", "ignore")

    def labels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={self.last}")

    def apply(self, merges: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        if batch > self.last:
            write_table(replay(self.labels(), merges), f"{self.path}/batch={batch}", "ignore")
            self.last = batch


def replay_stream(spark: SparkSession, shards: str, schema: str, labels: DataFrame, path: str) -> DataFrame:
    """Replay all shards that are there as a stream, and return the labels at the end."""
    r = Replayer(spark, labels, f"{path.rstrip('/')}/labels")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(shards)
    q = stream.writeStream.foreachBatch(r.apply).option("checkpointLocation", f"{path.rstrip('/')}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return r.labels()
