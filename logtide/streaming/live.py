"""Live ingest and live counts with Structured Streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtide.operators import tables
from logtide.sources.ingest import json_entries


def ingest(spark: SparkSession, source: str, root: str, checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Appends JSON batches that arrive as text files in ``source`` to the stored streams of ``root``, each entry exactly once.

    A micro-batch is one hot batch, which replaces itself if it is run again; rejected rows go to ``rejected/batch=``
    beside it. It must be the root's only writer of hot batches; compaction may run between micro-batches.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        entries, rejected = json_entries(rows)
        tables.append(entries, root, number + 1)
        rejected.write.mode("overwrite").parquet(f"{root}/rejected/batch={number + 1}")
        rows.unpersist()

    out = spark.readStream.text(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def level_counts(entries: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Entries by stream, level and time window; state is dropped once the watermark has passed."""
    return entries.withWatermark("_t", late).groupBy(F.window("_t", width), "_s", "_l").agg(F.count("*").alias("n"))
