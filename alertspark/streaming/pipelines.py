"""Structured Streaming forms of the alert operators.

The reference polls a table every 5 seconds; here alerts arrive through a
streaming source and each micro-batch runs the same DataFrame operators as the
batch path. Sinks are idempotent per micro-batch (a replayed batch overwrites
its own ``batch_id`` partition), so a restarted query or a lost executor never
duplicates output. Checkpoints live under ``spark.checkpoint.dir`` (shared
storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import state, triage
from ..operators.enrich import log_measures
from ..operators.ingest import checked_alerts, split_checked

from ..schemas import ALERTS
from ..session import delete_path, new_table_path, path_exists
from .keyed import KeyedTable

PAYLOAD_SCHEMA = "payload string"

# The full event log as stored: alert columns (set by ``inserted`` events, null
# elsewhere) + event keys + the micro-batch that wrote it.
LOG_SCHEMA = T.StructType(
    [T.StructField("alert_id", T.StringType()), T.StructField("kind", T.StringType()),
     T.StructField("event_ts", T.TimestampNTZType()), T.StructField("seq", T.LongType())]
    + [T.StructField(f.name, f.dataType, True) for f in ALERTS.fields if f.name != "alert_id"]
    + [T.StructField("batch_id", T.LongType())])


DEAD_LETTER_SCHEMA = T.StructType(
    LOG_SCHEMA.fields[:-1] + [T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()), LOG_SCHEMA.fields[-1]])
#: Partitions of a batch that a cycle writes.
CYCLE_KINDS = ("kind=claimed", "kind=ti_updated", "kind=verdict")

# --------------------------------------------------------------------------- S10, T1

def read_payload_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """A stream of submission payloads. ``json`` files carry one object
    per line with a ``payload`` text field; ``text`` reads raw JSON lines."""
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fmt == "text":
        return r.text(path).withColumnRenamed("value", "payload")
    return r.schema(PAYLOAD_SCHEMA).json(path)


def _write_batch(df: DataFrame, path: str, batch_id: int, by: tuple = (), clear: tuple[str, ...] = ("",)) -> None:
    """Overwrite only this batch's partitions: a replayed batch replaces its own
    output and never duplicates it. ``clear`` names the partitions below the batch's that
    this write stands for: they go first, so that a replay with fewer or no rows leaves
    nothing stale. A failure in between is a failed batch, which is replayed."""
    for part in clear:
        delete_path(df.sparkSession, f"{path}/batch_id={batch_id}/{part}".rstrip("/"))
    (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id", *by).parquet(path))


def id_index(spark: SparkSession, path: str, **tables) -> KeyedTable:
    """Ids that are stored, with the batch that brought each, in buckets of the id."""
    first = lambda rows: rows.groupBy("alert_id").agg(F.min("first_batch").alias("first_batch"))
    return KeyedTable(spark, path, "alert_id", "alert_id string, first_batch bigint", first, **tables)


def _guarded(rows: DataFrame, index: KeyedTable, batch_id: int) -> DataFrame:
    """``rows`` with ``_new``: the first of its id (by time, ties by the row's text), and no earlier batch has it."""
    order = Window.partitionBy("alert_id").orderBy("alert_time", F.to_json(F.struct(*rows.columns)))
    stored = index.read(batch_id, rows.select("alert_id")).select(F.col("alert_id").alias("_id"), F.lit(True).alias("_stored"))
    numbered = rows.withColumn("_n", F.row_number().over(order)).join(stored, F.col("alert_id").eqNullSafe(F.col("_id")), "left")
    return numbered.select(*rows.columns, ((F.col("_n") == 1) & F.col("_stored").isNull()).alias("_new"))


def start_ingest(stream: DataFrame, valid_path: str, rejected_path: str, checkpoint: str | None = None,
                 trigger: dict | None = None, now=None, index_path: str | None = None, **tables):
    """T1 + S11: validate every micro-batch (S2/S3), keep the first alert of each id
    (J3: by time within the batch, and not if an earlier batch has it), and write
    accepted alerts and rejected payloads to their sinks; a duplicate is a reject
    with its reason. Idempotent by ``batch_id``.

    Stored ids are in an index (``index_path``, by default next to the accepted alerts): a batch reads its own
    ids' buckets, not every id. Where alerts are stored without an index, the first batch
    builds it from them."""
    spark = stream.sparkSession
    checkpoint = checkpoint or new_table_path(spark, "ingest-checkpoint")
    index = id_index(spark, index_path or f"{valid_path.rstrip('/')}-ids", **tables)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if not path_exists(spark, f"{index.path}/delta") and path_exists(spark, valid_path):
            earlier = spark.read.schema("alert_id string, batch_id long").parquet(valid_path).where(F.col("batch_id") < batch_id)
            index.append(index.merge(earlier.select("alert_id", F.col("batch_id").alias("first_batch"))), batch_id - 1)
        index.compact(batch_id)
        # Parsed and checked once; the numbering, the probe and the sinks read that table.
        path = new_table_path(spark, "ingest-checked")
        try:
            checked_alerts(batch, now=now).write.parquet(path)
            valid, rejected = split_checked(spark.read.parquet(path))
            numbered = _guarded(valid, index, batch_id).withColumn("payload", F.to_json(F.struct(*valid.columns)))
            accepted = numbered.where("_new").select(valid.columns)
            index.append(accepted.select("alert_id", F.lit(batch_id).cast("long").alias("first_batch")), batch_id)
            _write_batch(accepted, valid_path, batch_id)
            again = numbered.where("NOT _new").select("alert_id", "src_ip", F.array(F.lit("alert_id already exists")).alias("reasons"), "payload")
            _write_batch(rejected.unionByName(again), rejected_path, batch_id)
        finally:
            delete_path(spark, path)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# --------------------------------------------------------------------------- T2

def with_event_time(df: DataFrame, col: str = "alert_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def dedup_stream(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Primary-key guard on a stream — the first alert per ``alert_id`` is kept,
    however late it comes. The watermark is set on the result, for later steps; the
    guard itself stands before it, so no alert is dropped as late and no id is
    forgotten: its state holds every id (as T1 reads every stored id), dealt by key."""
    return with_event_time(alerts).dropDuplicates(["alert_id"]).withWatermark("alert_time", delay)


def dedup_with_rejects(alerts: DataFrame, accepted_path: str, rejected_path: str, index_path: str, checkpoint: str | None = None,
                       trigger: dict | None = None, **tables):
    """T2 with nothing lost from sight: the first alert of each id goes to one sink, each later one, with its
    reason, to the other. Ids are kept in an index on shared storage (as T1), not in a state store."""
    spark = alerts.sparkSession
    index = id_index(spark, index_path, **tables)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        index.compact(batch_id)
        numbered = _guarded(batch, index, batch_id)
        accepted = numbered.where("_new").select(batch.columns)
        index.append(accepted.select("alert_id", F.lit(batch_id).cast("long").alias("first_batch")), batch_id)
        _write_batch(accepted, accepted_path, batch_id)
        again = numbered.where("NOT _new").select(*batch.columns, F.array(F.lit("alert_id already exists")).alias("reasons"))
        _write_batch(again, rejected_path, batch_id)

    w = alerts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint or new_table_path(spark, "dedup-checkpoint"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


# --------------------------------------------------------------------------- T3

def start_cycle(stream_of_alerts: DataFrame, log_path: str, now_col: str = "processing_time",
                checkpoint: str | None = None, trigger: dict | None = None, n: int | None = None,
                notifications_path: str | None = None, dead_letter_path: str | None = None, attempts: int = 2, scorer=triage.rule_verdict):
    """The processing cycle per micro-batch. Each batch of new alerts is
    appended to the event log as ``inserted``; the current state is folded
    from the log (G5); the cycle claims, scores and applies verdicts; the
    resulting ``claimed``, ``ti_updated`` and ``verdict`` events are appended (and
    the mails written, if a path is given), keyed by ``batch_id`` so a replay
    overwrites its own output. The gate (G3) is obeyed: nothing is claimed while
    alerts are in flight or none is pending. A failed cycle raises
    and the query restarts from its checkpoint — nothing is half-applied.

    With ``dead_letter_path`` the loop survives a failed cycle: the batch is tried ``attempts``
    times, then its alerts are set aside there with the error, taken out of the log, and the
    loop goes on; ``parole`` puts them back. Recovered claims (``start_recovery``) are read as well."""
    from ..functions.ip import with_direction
    from ..plans.cycle import run_cycle, written

    spark = stream_of_alerts.sparkSession
    checkpoint = checkpoint or new_table_path(spark, "cycle-checkpoint")

    def cycle(batch_id: int, scratch: list[str]) -> None:
        now = F.current_timestamp().cast("timestamp_ntz")
        # A replay must not see this batch's own claims and verdicts.
        log = spark.read.schema(LOG_SCHEMA).parquet(log_path).where(
            (F.col("batch_id") < batch_id) | (F.col("kind") == "recovered") | ((F.col("batch_id") == batch_id) & (F.col("kind") == "inserted")))
        current = with_direction(state.fold(log.drop("batch_id")))
        if state.queue_gate(current).first()["decision"] != "trigger":
            return
        out = run_cycle(spark, current, n=n, scorer=scorer, scratch=scratch)
        res = written(out["results"], "cycle-results", scratch)
        ti = out["features"].select("alert_id", "threat_intelligence")
        events = state.union_events(
            state.status_events(res, "claimed", state.STATUS_PROCESSING, now, batch_id * 10 + 1),
            state.ti_events(ti, now, batch_id * 10 + 2), state.verdict_events(res, now, batch_id * 10 + 3))
        _write_batch(events, log_path, batch_id, ("kind",), CYCLE_KINDS)
        if notifications_path:
            _write_batch(triage.notifications(res), notifications_path, batch_id)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        inserted = state.inserted_events(batch.drop("direction") if "direction" in batch.columns else batch)
        _write_batch(inserted.withColumn("seq", F.lit(batch_id * 10).cast("long")), log_path, batch_id, ("kind",), ("kind=inserted", *CYCLE_KINDS))
        for attempt in range(1, attempts + 1):
            scratch: list[str] = []
            try:
                cycle(batch_id, scratch)
                return
            except Exception as error:
                if dead_letter_path is None:
                    raise
                if attempt == attempts:
                    set_aside(spark, log_path, dead_letter_path, batch_id, repr(error)[:2000], attempt)
            finally:
                for path in scratch:
                    delete_path(spark, path)

    w = stream_of_alerts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def set_aside(spark: SparkSession, log_path: str, dead_letter_path: str, batch_id: int, error: str, attempts: int) -> None:
    """The alerts of a batch, with the error, to the dead letters, and out of the log."""
    rows = spark.read.schema(LOG_SCHEMA).parquet(log_path).where((F.col("batch_id") == batch_id) & (F.col("kind") == "inserted"))
    _write_batch(rows.withColumns({"error": F.lit(error), "attempts": F.lit(attempts)}), dead_letter_path, batch_id)
    for part in ("kind=inserted", *CYCLE_KINDS):
        delete_path(spark, f"{log_path}/batch_id={batch_id}/{part}")


def parole(spark: SparkSession, log_path: str, dead_letter_path: str, batch_id: int) -> None:
    """Put the alerts of a batch that was set aside back in the log, as they came: a later cycle claims them."""
    rows = spark.read.schema(DEAD_LETTER_SCHEMA).parquet(dead_letter_path).where(F.col("batch_id") == batch_id)
    _write_batch(rows.drop("error", "attempts"), log_path, batch_id, ("kind",), ("kind=inserted",))
    delete_path(spark, f"{dead_letter_path}/batch_id={batch_id}")


# --------------------------------------------------------------------------- T4

def lifecycle_state(log_stream: DataFrame) -> DataFrame:
    """T4: current state per alert from a stream of log events — the G5 fold
    as a streaming aggregation (state store keyed by ``alert_id``); run in
    ``update`` or ``complete`` output mode."""
    return state.fold(log_stream)


def stuck_alerts(log: DataFrame, now, max_age: str = "10 minutes") -> DataFrame:
    """O4 with an age limit (optional; the reference has none): alerts whose
    latest status is a claim older than ``max_age`` — candidates for recovery."""
    last = log.where(F.col("analysis_status").isNotNull()).groupBy("alert_id").agg(
        F.max(F.struct("event_ts", "seq", "analysis_status")).alias("s"))
    return last.select("alert_id", F.col("s.event_ts").alias("claimed_at"), F.col("s.analysis_status").alias("analysis_status")).where(
        (F.col("analysis_status") == state.STATUS_PROCESSING) & (F.col("claimed_at") < state.ts_lit(now) - F.expr(f"INTERVAL {max_age}")))


# --------------------------------------------------------------------------- T5

def threshold_windows(alerts: DataFrame, window: str = "60 seconds", slide: str = "30 seconds",
                      delay: str = "10 minutes") -> DataFrame:
    """T5: playbook-style thresholds on sliding event-time windows per source.
    Returns two aggregations: (distinct probed ports per window, failed logins
    and bytes per window). Works on a stream (watermarked, append mode) or on a
    batch DataFrame. Distinct ports use ``size(collect_set)`` (exact;
    ``count_distinct`` is not allowed on streams)."""
    m = log_measures(with_event_time(alerts))
    m = m.withWatermark("alert_time", delay)
    ports = F.concat(F.coalesce(F.col("destination_ports"), F.array().cast("array<int>")), F.col("log_ports"))
    g = (m.select("alert_time", "src_ip", F.explode_outer(ports).alias("port"),
                  F.when(F.col("failed_log_count") > 0, F.coalesce(F.col("event_count"), F.lit(0)))
                  .otherwise(0).alias("failed"), "total_bytes", "alert_id")
         .groupBy(F.window("alert_time", window, slide).alias("w"), "src_ip")
         # the set is bounded by the port space (<= 65,536 values)
         .agg(F.size(F.collect_set("port")).alias("probed_ports")))
    # Failed logins and bytes are per alert, so they are summed without the
    # port explode (one row per alert).
    h = (m.select("alert_time", "src_ip",
                  F.when(F.col("failed_log_count") > 0, F.coalesce(F.col("event_count"), F.lit(0)))
                  .otherwise(0).alias("failed"), "total_bytes")
         .groupBy(F.window("alert_time", window, slide).alias("w"), "src_ip")
         .agg(F.count("*").cast("bigint").alias("alerts"),
              F.sum("failed").cast("bigint").alias("failed_logins"),
              F.sum("total_bytes").cast("bigint").alias("bytes")))
    return g, h


def threshold_flags(ports: DataFrame, volume: DataFrame, failed_limit: int = 20, ports_limit: int = 10,
                    bytes_limit: float = 1e9) -> tuple[DataFrame, DataFrame]:
    p = ports.withColumn("port_scan", F.col("probed_ports") > ports_limit)
    v = volume.withColumn("brute_force", F.col("failed_logins") > failed_limit) \
        .withColumn("exfiltration", F.col("bytes") > bytes_limit)
    return p, v


# --------------------------------------------------------------------------- T6

def status_board_stream(alerts: DataFrame) -> DataFrame:
    """G7 continuously (complete output mode)."""
    return alerts.groupBy("analysis_status", "triage_status").agg(F.count("*").cast("bigint").alias("n"))
