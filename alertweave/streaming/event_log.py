"""The append-only event log: numbered batches of events, checked against where their runs stand.

``append_batch`` is the one way to append, for a stream's micro-batches and for a caller's own. It checks
each event by itself and against its run's chain: where the run stood after the batches before is
kept as a small table per batch, every ``FULL_EVERY`` th of them whole, the others with the runs that
moved. So a batch reads no event again, and at most ``FULL_EVERY`` state tables. A batch writes under its
own number and reads only what lower numbers wrote: run again, it replaces its rows by the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertweave import fixed_values as fixed
from alertweave import schemas
from alertweave.functions.expressions import first_reason
from alertweave.operators.audit import chained, transition_allowed
from alertweave.session import cut_lineage

FULL_EVERY = 16
_STATE = "run_id string, sequence bigint, to_state string"


def event_fault() -> Column:
    states = sorted({state for pair in fixed.TRANSITIONS for state in pair} | set(fixed.FAILURE_STATES))
    first = F.col("sequence") == 0
    return first_reason(
        (F.col("run_id").isNull() | F.col("sequence").isNull(), "run or sequence is missing"),
        (F.col("sequence") < 0, "sequence is negative"),
        (F.coalesce(~F.col("to_state").isin(states), F.lit(True)), "unknown state"),
        (
            first & (F.col("from_state").isNotNull() | (F.col("to_state") != "CREATED")),
            "history must begin at CREATED",
        ),
        (~first & F.col("from_state").isNull(), "from_state is missing"),
        (~first & ~transition_allowed(F.col("from_state"), F.col("to_state")), "invalid transition"),
        (~F.col("event_type").rlike(r"^[a-z][a-z0-9_]*$"), "invalid event type"),
        (F.col("retry_count") < 0, "negative retry count"),
        (F.col("occurred_at").isNull(), "timestamp is missing"),
    )


def read_event_stream(spark: SparkSession, location: str) -> DataFrame:
    return spark.readStream.schema(schemas.WORKFLOW_EVENT).json(location)


def last_states(spark: SparkSession, states: str, batch_id: int) -> DataFrame:
    """Where each run stood before a batch: ``run_id, sequence, to_state``."""
    full = (batch_id - 1) // FULL_EVERY * FULL_EVERY
    kept = [f"{states}/batch={number}" for number in range(max(0, full), batch_id)]
    if not kept:
        return spark.createDataFrame([], _STATE)
    return latest(spark.read.schema(_STATE).parquet(*kept))


def latest(states: DataFrame) -> DataFrame:
    ends = states.groupBy("run_id").agg(F.max(F.struct("sequence", "to_state")).alias("end"))
    return ends.select("run_id", "end.*")


def append_batch(events: DataFrame, folder: str, batch_id: int) -> None:
    """Appends batch ``batch_id`` (0, 1, ... without gaps): accepted events to ``log``, the others
    with their fault to ``rejected``, where the runs stand now to ``states``."""
    spark = events.sparkSession
    before = last_states(spark, f"{folder}/states", batch_id)
    judged = events.withColumn("fault", event_fault())
    sound = chained(judged.where("fault is null").drop("fault"), before)
    checked = cut_lineage(sound.select(*judged.columns).union(judged.where("fault is not null")))
    accepted = checked.where("fault is null").drop("fault")
    accepted.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
    checked.where("fault is not null").write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch_id}")
    moved = latest(accepted.select("run_id", "sequence", "to_state"))
    if batch_id % FULL_EVERY == 0:
        moved = latest(before.union(moved))
    moved.write.mode("overwrite").parquet(f"{folder}/states/batch={batch_id}")


def append_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of events appended micro-batch by micro-batch."""
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, folder, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
