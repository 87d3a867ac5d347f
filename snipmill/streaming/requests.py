"""Idempotent requests as a stream.

Each micro-batch is decided with the batch operator, so a key with very many
requests is combined map-side and never gathered in one state cell. The store
is a folder of deltas, one per batch and stage; a batch that runs again after
a failure overwrites its own delta and reads only older ones. Keys never
expire: the store grows with the number of distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snipmill.operators import idempotency

STORE = (
    "idempotency_key string, request_fingerprint string, operation_type string, "
    "disposition string, result_json string, created_at string"
)
RESULT = "idempotency_key string, status string, result_json string"
REMOVED = "removed"


def read_store(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Latest row per key over all deltas, or over those of earlier batches."""
    rows = spark.read.schema(f"{STORE}, batch long, stage int").parquet(f"{folder}/store")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    fields = ["request_fingerprint", "operation_type", "disposition", "result_json", "created_at"]
    latest = rows.groupBy("idempotency_key").agg(
        F.max_by(F.struct(*fields), F.struct("batch", "stage")).alias("r"))
    return latest.select("idempotency_key", "r.*").where(F.col("disposition") != REMOVED)


def run_requests(requests: DataFrame, folder: str, run: Callable[[DataFrame], DataFrame],
                 operation_type: str, created_at: str, **trigger) -> StreamingQuery:
    """Start the stream of ``(arrival, idempotency_key, request_fingerprint, …)``.

    ``run`` gets the new requests of a batch and returns
    ``(idempotency_key, status, result_json)``, which is written once and read from there.
    Unknown is written before it runs. A batch that starts again after a failure keeps the
    results if they are whole; if they are not, its new requests may have run, so they are not
    sent again: their outcome is unknown. Decisions land in ``<folder>/decisions``.
    """
    spark = requests.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs

    def done(path: str) -> bool:
        mark = files.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    spark.createDataFrame([], STORE).write.mode("overwrite").parquet(f"{folder}/store/batch=-1/stage=0")

    def batch(df: DataFrame, batch_id: int) -> None:
        def stage(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/store/batch={batch_id}/stage={number}")

        sent = f"{folder}/store/batch={batch_id}/stage=0"
        plan, outcome = f"{folder}/planned/batch={batch_id}", f"{folder}/results/batch={batch_id}"
        again = done(sent)
        if not again:
            idempotency.decide(df, read_store(spark, folder, batch_id)).write.mode("overwrite").parquet(plan)
            stage(idempotency.in_flight(spark.read.parquet(plan), F.lit(operation_type), F.lit(created_at)), 0)
        decided, pending = spark.read.parquet(plan), spark.read.schema(STORE).parquet(sent)
        new = decided.where(F.col("decision") == "new")
        if not again:
            run(new).select("idempotency_key", "status", "result_json").write.mode("overwrite").parquet(outcome)
        known = done(outcome)
        results = spark.read.schema(RESULT).parquet(outcome) if known else spark.createDataFrame([], RESULT)
        unsure = F.lit(again and not known) & (F.col("decision") == "new")
        final = idempotency.settle_repeats(decided, results)
        final.withColumn("decision", F.when(unsure, "outcome_unknown").otherwise(F.col("decision"))).write.mode(
            "overwrite").parquet(f"{folder}/decisions/batch={batch_id}")
        settled = idempotency.settle(pending, results)
        freed = pending.join(
            results.where(F.col("status") == "refused").select("idempotency_key"),
            "idempotency_key", "left_semi").withColumn("disposition", F.lit(REMOVED))
        stage(settled.unionByName(freed), 1)

    return (
        requests.writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{folder}/progress").trigger(**trigger).start()
    )
