"""T4 / O4 with timers: claims that nobody finishes come back by themselves.

A keyed processor holds the claim of each alert that is in flight. A
claim sets a timer at its own time plus the limit; a verdict, a recovery or a
newer claim deletes it. When the timer fires, a ``recovered`` event is emitted,
which the log's fold (G5) reads as Pending, so the alert is claimed again. State
and timers are in the checkpoint: a restart fires what fell due meanwhile. Finished alerts keep
a mark for some limits' time only (so that a late claim event can't revive them),
so state is bounded by the alerts in flight and of late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import STATUS_PENDING, STATUS_PROCESSING
from ..session import new_table_path
from .pipelines import LOG_SCHEMA, _write_batch

#: A mark lives for so many limits.
MARK_LIMITS = 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClaimWatch(StatefulProcessor):
    """Of one alert: its open claim with the timer, and a mark of what closed the last one."""

    def __init__(self, limit_ms: int, processing: str):
        self.limit_ms, self.processing = limit_ms, processing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "at bigint, seq bigint, timer bigint")
        self.mark = handle.getValueState("mark", "at bigint, seq bigint", ttlDurationMs=MARK_LIMITS * self.limit_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        claim, mark = self.claim.get(), self.mark.get()
        known = max([tuple(x)[:2] for x in (claim, mark) if x], default=(-1 << 62, 0))
        status = None
        for part in rows:
            for s, at, seq in zip(part["analysis_status"], part["at"], part["seq"]):
                if (int(at), int(seq)) > known:
                    status, known = s, (int(at), int(seq))
        if status is not None:
            if claim:
                self.handle.deleteTimer(claim[2])
            if status == self.processing:
                timer = max(known[0] // 1000 + self.limit_ms, timerValues.getCurrentProcessingTimeInMs() + 1)
                self.handle.registerTimer(timer)
                self.claim.update((*known, timer))
            else:
                self.claim.clear()
                self.mark.update(known)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        claim = self.claim.get()
        if claim and claim[2] == expiredTimerInfo.getExpiryTimeInMs():
            now, seq = timerValues.getCurrentProcessingTimeInMs() * 1000, claim[1] + 1
            self.claim.clear()
            self.mark.update((now, seq))
            yield pd.DataFrame({"alert_id": [key[0]], "claimed_at": [claim[0]], "recovered_at": [now], "seq": [seq]})

    def close(self) -> None:
        pass


def recovered_claims(events: DataFrame, limit_seconds: int) -> DataFrame:
    """(alert_id, claimed_at, recovered_at, seq), times in microseconds: of a stream of log events the
    claims that are older than the limit and had no verdict since."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what timers need
    slim = events.where(F.col("analysis_status").isNotNull()).select(
        "alert_id", "analysis_status", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("at"), "seq")
    return slim.groupBy("alert_id").transformWithStateInPandas(
        ClaimWatch(limit_seconds * 1000, STATUS_PROCESSING), "alert_id string, claimed_at bigint, recovered_at bigint, seq bigint", "Append", "ProcessingTime")


def recovered_events(found: DataFrame) -> DataFrame:
    return found.select("alert_id", F.lit("recovered").alias("kind"), F.timestamp_micros("recovered_at").cast("timestamp_ntz").alias("event_ts"),
                        "seq", F.lit(STATUS_PENDING).alias("analysis_status"))


def start_recovery(spark: SparkSession, log_path: str, limit_seconds: int, checkpoint: str | None = None, trigger: dict | None = None):
    """O4 continuously: reads the event log as a stream and appends ``recovered`` events to it, by batch."""
    checkpoint = checkpoint or new_table_path(spark, "recovery-checkpoint")
    events = spark.readStream.schema(LOG_SCHEMA).parquet(log_path)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # In one file of a partition of its own kind; this query's batches are not the cycle's.
        found = batch.persist()
        try:
            if not found.isEmpty():
                _write_batch(recovered_events(found), log_path, batch_id, ("kind",), ("kind=recovered",))
        finally:
            found.unpersist()

    w = recovered_claims(events, limit_seconds).writeStream.outputMode("append").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()
