"""A folder of change files as a stream that keeps a snapshot up to date.

Order is that of file numbers and places in files, not of event time, so no watermark is needed. Each micro-batch is
applied to the snapshot of the batch before and written under its own number: a batch that runs again writes the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapweave.operators.changes import last_change
from mapweave.schema import ELEMENTS
from mapweave.sources.osc import changes_of


def stream_changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Changes of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return changes_of(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder))


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each element as a running aggregate, for output modes update and complete."""
    rest = [c for c in changes.columns if c not in ("kind", "id")]
    return changes.groupBy("kind", "id").agg(F.max_by(F.struct(*rest), F.struct("stream", "seq")).alias("c")).select("kind", "id", "c.*")


def snapshot(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The newest snapshot, or that of one batch; elements with the place of the change that made them, deletions included."""
    rows = spark.read.schema(f"{ELEMENTS}, action string, stream bigint, seq bigint, batch bigint").parquet(path)
    at = batch if batch is not None else rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == at).drop("batch")


def follow(spark: SparkSession, folder: str, state: str, checkpoint: str) -> StreamingQuery:
    """Applies all change files of a folder, and with ``state`` as it stands after each batch."""
    names = ["kind", "id", "lat_e7", "lon_e7", "tags", "refs", "locations", "members", "info", "action", "stream", "seq"]

    def apply(batch: DataFrame, number: int) -> None:
        new = batch.select(names)
        if number:
            new = new.unionByName(snapshot(batch.sparkSession, state, number - 1).select(names))
        last_change(new, ["stream", "seq"]).select(names).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream_changes(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
