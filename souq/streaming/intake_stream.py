"""Streaming intake: candidate files -> validation -> append (V-01/S-04, V-02/S-05).

Each micro-batch runs the batch validators of ``souq.operators.intake``.
Outputs are written to ``<table>/batch_id=<n>`` with overwrite, so a
micro-batch that is re-executed after a failure replaces its own output
instead of appending twice; readers see the table as the union of batch
folders.  The user intake reads the user table afresh in every micro-batch,
so an email accepted in one batch is "in use" for every later batch, as
with sequential requests.  Stream checkpoints live under the session's
``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from souq.operators import intake
from souq.session import ensure_checkpoint_dir

PRODUCT_CANDIDATE_SCHEMA = ("arrival_no long, business_id long, name string, description string, "
                            "category string, price string, discount string, image_name string, "
                            "image_type string, image_size long")
USER_CANDIDATE_SCHEMA = ("arrival_no long, first_name string, last_name string, email string, "
                         "phone string, password string, confirm_password string, registration_type string")


def read_table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The content of an appended table (empty with ``schema`` if absent).

    With ``before`` only the output of earlier micro-batches is read, so a
    batch that runs again neither meets nor overwrites its own input; the
    first one has none.  Existence is probed through Spark, so any shared file
    system works.  A table that is there but cannot be read is an error.
    """
    if before == 0:
        return spark.createDataFrame([], schema)
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return table if before is None or "batch_id" not in table.columns else table.where(F.col("batch_id") < before)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def start_product_intake(spark: SparkSession, inbox: str, products_path: str, rejects_path: str, *,
                         existing_schema: str = "product_id long", checkpoint: str | None = None,
                         available_now: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
    """Validate product submissions as they arrive; append valid rows, keep rejects with reasons."""
    reader = spark.readStream.schema(PRODUCT_CANDIDATE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(inbox)

    def handle(batch: DataFrame, batch_id: int) -> None:
        validated = intake.validate_products(batch)
        existing = read_table(batch.sparkSession, products_path, existing_schema, before=batch_id)
        _write_batch(intake.accepted_products(validated, existing), products_path, batch_id)
        rejects = validated.where(F.size("errors") > 0).select(
            "arrival_no", F.array_join("errors", ",").alias("error_codes"))
        _write_batch(rejects.unionByName(intake.unstorable_products(validated)), rejects_path, batch_id)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation",
                                                       _checkpoint(spark, "product_intake", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def start_user_intake(spark: SparkSession, inbox: str, users_path: str, rejects_path: str, *,
                      existing_schema: str = "user_id long, username string, email string", checkpoint: str | None = None,
                      available_now: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
    """Validate registrations as they arrive; emails accepted earlier count as in use."""
    reader = spark.readStream.schema(USER_CANDIDATE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(inbox)

    def handle(batch: DataFrame, batch_id: int) -> None:
        users = read_table(batch.sparkSession, users_path, existing_schema, before=batch_id)
        validated = intake.validate_users(batch, users.select("user_id", "email"))
        accepted = intake.accepted_users(validated, users.select("user_id", "username"))
        _write_batch(accepted, users_path, batch_id)
        _write_batch(validated.where(F.col("error").isNotNull()).select("arrival_no", "error"),
                     rejects_path, batch_id)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation",
                                                       _checkpoint(spark, "user_intake", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
