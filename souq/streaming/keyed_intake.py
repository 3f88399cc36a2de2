"""User intake with the taken emails in keyed state (J-07, V-02, S-05).

``intake_stream`` asks the user table in every micro-batch whether an email is
taken.  Here the state store holds one entry for each email: the table's files
go through the stream once, the candidates as they come, and the first of them
to bring a new email, by arrival, is accepted.  What a micro-batch costs depends
on the micro-batch; state is kept with the query's checkpoint, so it outlasts
restarts.

Emails meet as ``lower`` without trailing spaces and accents.  The rows of one
email pass through its task one Arrow batch at a time: only the earliest so far
is held.  Accepted rows still get their usernames by the names that are in use,
of which one column is read.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from souq.operators import intake
from souq.session import ensure_checkpoint_dir
from souq.streaming.intake_stream import USER_CANDIDATE_SCHEMA, read_table

_ROW = ("arrival_no bigint, first_name string, last_name string, email string, phone string, role string, "
        "error string")
_FIELDS = [c.split()[0] for c in _ROW.split(", ")]


def _plain(emails: pd.Series) -> pd.Series:
    def one(e: str) -> str:
        e = unicodedata.normalize("NFKD", e.rstrip(" "))
        return "".join(c for c in e if not unicodedata.combining(c)).casefold()
    return emails.map(one, na_action="ignore")


def email_identity(email: str) -> Column:
    """The email as a plain string under which equal ones meet; accepted emails are ASCII, a table's need not be."""
    plain = F.pandas_udf(_plain, "string")
    return F.when(F.col(email).rlike(r"^[\x00-\x7F]*\z"), F.lower(F.rtrim(email))).otherwise(plain(email))


def _first_come(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one email, all but the accepted one with their error; an email that is new is taken from now on."""
    taken, best = state.exists, None
    for f in frames:
        taken = taken or bool(f["is_user"].any())
        f = f.loc[~f["is_user"].astype(bool), _FIELDS]
        if not len(f):
            continue
        f = f if best is None else pd.concat([best, f], ignore_index=True)
        first = f["arrival_no"].idxmin()
        best = f.loc[[first]]
        yield f.drop(index=first).assign(error="email_in_use")
    if not state.exists:
        state.update((True,))
    if best is not None:
        yield best.assign(error="email_in_use" if taken else None)


def decisions(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Streaming: every candidate with its ``error`` (null: accepted); ``users(email)`` are taken."""
    checked = intake.checked_users(candidates).select(*_FIELDS)
    passing = checked.where(F.col("error").isNull()).select(*_FIELDS, F.lit(False).alias("is_user"))
    known = users.where(F.col("email").isNotNull()).select(
        *(F.col("email") if c == "email" else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _ROW.split(", "))),
        F.lit(True).alias("is_user"))
    keyed = passing.unionByName(known).withColumn("key", email_identity("email"))
    judged = keyed.groupBy("key").applyInPandasWithState(_first_come, _ROW, "taken boolean", "append",
                                                         GroupStateTimeout.NoTimeout)
    return judged.unionByName(checked.where(F.col("error").isNotNull()))


def start_keyed_user_intake(spark: SparkSession, inbox: str, table: str, out: str, *, checkpoint: str | None = None,
                            available_now: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
    """Judge registrations as they arrive; ``out`` gets ``decisions`` and ``accepted``, a folder for each micro-batch.

    ``table`` is the folder of the user table (email, username) as it is when the query first starts.
    """
    reader = spark.readStream.schema(USER_CANDIDATE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    users = spark.readStream.schema("email string").parquet(table)
    judged = decisions(reader.parquet(inbox), users)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        mine = os.path.join(out, "decisions", f"batch_id={batch_id}")
        batch.write.mode("overwrite").parquet(mine)        # the state is asked once
        rows = session.read.schema(_ROW).parquet(mine).where("error IS NULL").drop("error")
        names = session.read.schema("username string").parquet(table).unionByName(
            read_table(session, os.path.join(out, "accepted"), "username string", before=batch_id).select("username"))
        rows = intake.allocate_usernames(rows, names).withColumn("is_verified", F.lit(False))
        rows.write.mode("overwrite").parquet(os.path.join(out, "accepted", f"batch_id={batch_id}"))

    where = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", "keyed_user_intake")
    w = judged.writeStream.foreachBatch(handle).option("checkpointLocation", where)
    return (w.trigger(availableNow=True) if available_now else w).start()
