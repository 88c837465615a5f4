"""Streams that maintain derived state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def change_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of change rows as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def maintain(engine: Engine, changes: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of change rows with op ('upsert' or 'delete'), ts and seq to the engine, each micro-batch as a whole.

    Of one document's changes in a batch the last by (ts, seq) holds.  A batch that is delivered again leaves the same documents.
    """

    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in ("collection", "key", "lang")]
        last = batch.groupBy("collection", "key", "lang").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("c")).select("collection", "key", "lang", "c.*").cache()
        try:
            puts, gone = last.where("op <> 'delete'"), last.where("op = 'delete'")
            if not puts.isEmpty():
                engine.add_batch(puts.drop("op", "ts"))
            if not gone.isEmpty():
                engine.delete_batch(gone.select("collection", "key", "lang"))
        finally:
            last.unpersist()

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
