"""Continuous intake and feedback counts on Structured Streaming, from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinforge.plans.intake import intake_rows, payload_fields, validate

INTAKE_SCHEMA = "submission_id long, raw_request string, received_at timestamp"
FEEDBACK_SCHEMA = "id long, job_id long, action_type string, created_at timestamp"
# --- fixed values -----------------------------------------------------------------------------------
LATE_BY = "1 hour"


def submissions(spark: SparkSession, path: str, late: str = LATE_BY) -> DataFrame:
    """Submissions as files land; one resent within the watermark counts once."""
    raw = spark.readStream.schema(INTAKE_SCHEMA).parquet(path)
    return raw.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["submission_id"])


def intake_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Customer rows and refusals appended per batch. A batch replayed after a failure overwrites its own folder,
    so nothing is written twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        fields = payload_fields(batch.select("submission_id", "raw_request"))
        intake_rows(fields).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        validate(fields).where("not accepted").write.mode("overwrite").parquet(f"{out}/refused/batch={batch_id}")
        batch.unpersist()

    return submissions(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(spark: SparkSession, path: str, late: str = LATE_BY) -> DataFrame:
    """Decisions as files land; one resent within the watermark counts once. The ids seen are kept in the state store."""
    raw = spark.readStream.schema(FEEDBACK_SCHEMA).parquet(path)
    return raw.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def feedback_stream(spark: SparkSession, path: str, out: str, checkpoint: str, late: str = LATE_BY) -> StreamingQuery:
    """Decisions by kind, one small table a batch. What has been seen lives in the checkpoint and what has been
    counted below ``out``, so a stream that is started again goes on where it ended, and a batch that is
    replayed writes its own folder anew."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("action_type").agg(F.count("*").alias("decisions")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return decisions(spark, path, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_totals(spark: SparkSession, out: str) -> DataFrame:
    """Decisions so far by kind; a batch has a row a kind."""
    counted = spark.read.schema("action_type string, decisions long").parquet(f"{out}/batch=*")
    return counted.groupBy("action_type").agg(F.sum("decisions").alias("decisions"))
