"""Subscription state kept up from a stream of billing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.operators.subscriptions import STATE_COLUMNS, fold_events, usable_events
from stopclock.session import checkpoint_id
from stopclock.sources.publish import Publication, newest, read_published, vacuum

STATE = "subscription_state"
BUCKETS = 256
_SCHEMA = "user_id string, " + ", ".join(f"{name} {kind}" for name, kind in STATE_COLUMNS.items()) + ", bucket int"


def _bucket(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The state as last published; empty before the first batch."""
    return read_published(spark, root, STATE, _SCHEMA).drop("bucket")


def keep_state(
    events: DataFrame, root: str, checkpoint: str, policy: str = "server", buckets: int = BUCKETS, kept_versions: int = 10, kept_hours: float = 48.0,
):
    """Folds each batch into the state of the users it names.

    Users lie in hash buckets, each a partition with a version of its own: a batch reads and writes only the buckets its
    events fall in, and publishes them in one step together with its number. A batch repeated after a failure finds
    its number and changes nothing; a stream started anew, with a checkpoint of its own, goes on from the
    state that is there. Events are folded in order within a batch; batches apply in the order they arrive.
    The number of ``buckets`` must stay that of the first batch. Replaced versions stay for ``kept_versions`` batches and ``kept_hours``, for readers.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = checkpoint_id(spark, checkpoint)
        before = newest(spark, root)
        if before.marks.get(stream, -1) >= batch_id:
            return
        if before.marks.get("buckets", buckets) != buckets:
            raise ValueError(f"this state has {before.marks['buckets']} buckets, not {buckets}")
        batch.persist()
        try:
            touched = [r[0] for r in usable_events(batch).select(_bucket(F.col("user_id"), buckets)).distinct().collect()]
            with Publication(spark, root) as out:
                if touched:
                    current = out.read(STATE, _SCHEMA, names={f"bucket={b}" for b in touched}).drop("bucket")
                    state = fold_events(batch, current, policy)
                    out.stage(state.withColumn("bucket", _bucket(F.col("user_id"), buckets)), STATE, "bucket", ["user_id"], touched)
                out.commit({stream: batch_id, "buckets": buckets})
        finally:
            batch.unpersist()
        vacuum(spark, root, kept_versions, kept_hours)

    return events.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
