"""Event logs as streams: a file source and a sink that feeds two logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snipmill.operators.events import import_envelopes
from snipmill.sources.sinks import event_lines


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    kept = lines.where(F.trim("value") != "")
    return kept.select(F.from_json("value", schema).alias("e")).select("e.*")


def event_log_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a JSONL log; blank lines are none."""
    return _parsed(spark.read.text(path), schema)


def event_log_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: each new file is read once."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return _parsed(lines, schema)


def dual_write(ledger: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Feed the import ledger and the shared log from one stream of ledger rows.

    Each batch writes its own folder in both logs, so a batch that runs again
    replaces what it wrote instead of adding to it.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        event_lines(df).write.mode("overwrite").text(f"{folder}/ledger/batch={batch_id}")
        event_lines(import_envelopes(df)).write.mode("overwrite").text(f"{folder}/shared/batch={batch_id}")

    return (
        ledger.writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{folder}/progress").trigger(**trigger).start()
    )
