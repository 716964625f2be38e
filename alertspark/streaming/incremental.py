"""T3, G5 and T6 without reading the history again: the cycle over kept state.

After each batch are kept (``CycleState``): every alert's merged events, in buckets of its id; the open
alerts (Pending, Processing) as a table; what history a cycle asks for, as sums that
are changed by the difference of a batch's alerts before and after: knowledge by sentence, TI
values by address, the boards' counts (G7, G8). A batch reads the buckets of its own ids
and addresses, the open alerts (which a claim goes through anyway), and the knowledge, whose size
is that of the vocabulary of sentences, not that of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STATUS_PENDING, STATUS_PROCESSED, STATUS_PROCESSING
from ..functions.ip import with_direction
from ..operators import state, triage
from ..plans.cycle import kb_records, kb_rollup, run_cycle, written
from ..session import child_names, delete_path, new_table_path
from .keyed import KeyedTable, summed
from .pipelines import CYCLE_KINDS, LOG_SCHEMA, _write_batch

KB_SUMS = {"n": "bigint", "tp": "bigint", "fp": "bigint", "nr": "bigint", "conf": "decimal(30,2)", "conf_n": "bigint"}
BOARD_KEYS = ["analysis_status", "triage_status", "llm_classification", "severity", "direction"]
BOARD_SUMS = {"n": "bigint", "conf": "decimal(30,2)", "conf_n": "bigint"}
# FIXED VALUES: the providers' fields and how each is read.
TI_FIELDS = {"abuseConfidenceScore": ("abuseipdb", "int"), "totalReports": ("abuseipdb", "int"), "isTor": ("abuseipdb", "boolean"),
             "isWhitelisted": ("abuseipdb", "boolean"), "countryCode": ("abuseipdb", "string"),
             **{c: ("virustotal", "int") for c in ("malicious", "suspicious", "undetected", "harmless", "timeout")}}


def _ddl(keys: list[str], sums: dict[str, str]) -> str:
    return ", ".join([f"{k} string" for k in keys] + [f"{m} {t}" for m, t in sums.items()])


# --------------------------------------------------------------------------- what alerts add to the sums

def ti_values(alerts: DataFrame) -> DataFrame:
    """(ip, field, value, n): how many alerts of an address hold a TI value. A hot address has as
    many rows as it has different values."""
    ti = F.col("threat_intelligence")
    read = [F.struct(F.lit(f).alias("field"), F.get_json_object(ti, f"$.{p}.{f}").try_cast(t).cast("string").alias("value"))
            for f, (p, t) in TI_FIELDS.items()]
    has = alerts.where(ti.isNotNull() & F.col("src_ip").isNotNull())
    rows = has.select(F.col("src_ip").alias("ip"), F.inline(F.array(*read))).where(F.col("value").isNotNull())
    return rows.groupBy("ip", "field", "value").agg(F.count("*").alias("n"))


def ti_snapshots(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1's two providers of the values per address: the highest of each field."""
    g = values.where(F.col("n") > 0).groupBy("ip").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value")).cast(t)).alias(f) for f, (_, t) in TI_FIELDS.items()])
    return tuple(g.select("ip", *[f for f, (p, _) in TI_FIELDS.items() if p == provider]) for provider in ("abuseipdb", "virustotal"))


def board_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(*BOARD_KEYS).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("llm_confidence"), F.lit(0)).cast("decimal(30,2)").alias("conf"),
        F.count("llm_confidence").alias("conf_n"))


def status_board(board: DataFrame) -> DataFrame:
    """G7 of the kept counts."""
    return board.groupBy("analysis_status", "triage_status").agg(F.sum("n").alias("n")).where("n <> 0")


def detected_threats(board: DataFrame) -> DataFrame:
    """G8 of the kept counts."""
    g = board.where(F.col("analysis_status") == STATUS_PROCESSED).groupBy("llm_classification", "severity", "direction").agg(
        F.sum("n").alias("n"), F.sum("conf").alias("_c"), F.sum("conf_n").alias("_n")).where("n <> 0")
    return g.select("llm_classification", "severity", "direction", "n",
                    F.when(F.col("_n") > 0, F.round(F.col("_c").cast("double") / F.col("_n"), 6)).alias("avg_confidence"))


def difference(after: DataFrame, before: DataFrame, sums: dict[str, str]) -> DataFrame:
    """What is added and, as negative numbers, what is taken back."""
    keys = [c for c in after.columns if c not in sums]
    return summed(keys, sums)(after.unionByName(before.withColumns({m: (-F.col(m)).cast(t) for m, t in sums.items()})))


# --------------------------------------------------------------------------- the cycle

class CycleState:
    """The tables under ``path``. ``tables`` (target_rows, compact_every) goes to every keyed one."""

    def __init__(self, spark: SparkSession, path: str, **tables):
        self.spark, self.path = spark, path.rstrip("/")
        self.parts = state.partials(spark.createDataFrame([], LOG_SCHEMA)).schema
        self.alerts = KeyedTable(spark, f"{self.path}/alerts", "alert_id", self.parts, state.merge_partials, **tables)
        self.ti = KeyedTable(spark, f"{self.path}/ti", "ip", _ddl(["ip", "field", "value"], {"n": "bigint"}),
                             summed(["ip", "field", "value"], {"n": "bigint"}), **tables)
        self.kb = KeyedTable(spark, f"{self.path}/kb", "query_text", _ddl(["query_text"], KB_SUMS), summed(["query_text"], KB_SUMS), **tables)
        self.board = KeyedTable(spark, f"{self.path}/board", "analysis_status", _ddl(BOARD_KEYS, BOARD_SUMS), summed(BOARD_KEYS, BOARD_SUMS), **tables)
        self.tables = (self.alerts, self.ti, self.kb, self.board)

    def open_alerts(self, before: int) -> DataFrame:
        """Merged events of all alerts that are Pending or Processing after the batches before ``before``."""
        there = [b for b in map(int, child_names(self.spark, f"{self.path}/open")) if b < before]
        if not there:
            return self.spark.createDataFrame([], self.parts)
        return self.spark.read.schema(self.parts).parquet(f"{self.path}/open/{max(there)}")

    def keep_open(self, parts: DataFrame, batch_id: int) -> None:
        is_open = F.col("_b").isNotNull() & F.col("_s.analysis_status").isin(STATUS_PENDING, STATUS_PROCESSING)
        parts.where(is_open).write.mode("overwrite").parquet(f"{self.path}/open/{batch_id}")
        # The one before stays for a replay of this batch.
        for b in sorted(b for b in map(int, child_names(self.spark, f"{self.path}/open")) if b < batch_id)[:-1]:
            delete_path(self.spark, f"{self.path}/open/{b}")


def _stuck(current: DataFrame, now, limit_seconds: int) -> DataFrame:
    s = F.col("_s")
    return current.where((s["analysis_status"] == STATUS_PROCESSING) & (s["event_ts"] < now - F.make_dt_interval(secs=F.lit(limit_seconds))))


def step(kept: CycleState, inserted: DataFrame, batch_id: int, now, n: int | None = None, scorer=triage.rule_verdict,
         scratch: list[str] | None = None, recover_after: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One batch: its ``inserted`` events in, state kept. Gives the events that the cycle adds to the log
    (claimed, ti_updated, verdict; recovered, for claims of more than ``recover_after`` seconds), the boards'
    changes (+ and -) and the results (None if the gate lets nothing through)."""
    scratch = [] if scratch is None else scratch
    for t in kept.tables:
        t.compact(batch_id)
    new = state.partials(inserted)
    was = kept.alerts.read(batch_id, new.select("alert_id")).unionByName(kept.open_alerts(batch_id))
    before_parts = written(state.merge_partials(was), "cycle-before", scratch)
    events = []
    if recover_after is not None:
        events.append(state.status_events(_stuck(before_parts, now, recover_after), "recovered", STATUS_PENDING, now, batch_id * 10))
        new = new.unionByName(state.partials(state.union_events(inserted.limit(0), events[0])))
    parts = written(state.merge_partials(before_parts.unionByName(new)), "cycle-current", scratch)
    before, current = (with_direction(state.finish(p)) for p in (before_parts, parts))
    res = None
    if state.queue_gate(current).first()["decision"] == "trigger":
        asked = current.where(F.col("analysis_status") == STATUS_PENDING).select(F.col("src_ip").alias("ip")).where("ip IS NOT NULL")
        ti_now = difference(ti_values(current), ti_values(before), {"n": "bigint"})
        abuse, vt = ti_snapshots(kept.ti.merge(kept.ti.read(batch_id, asked).unionByName(ti_now)))
        kb_now = difference(kb_rollup(current), kb_rollup(before), KB_SUMS)
        kb = kb_records(kept.kb.merge(kept.kb.read(batch_id).unionByName(kb_now)))
        out = run_cycle(kept.spark, current, n=n, scorer=scorer, scratch=scratch, history={"kb": kb, "abuse": abuse, "vt": vt})
        keep = out["results"].join(out["features"].select("alert_id", F.col("threat_intelligence").alias("_ti")), "alert_id")
        res = written(keep, "cycle-results", scratch)
        ti = res.select("alert_id", F.col("_ti").alias("threat_intelligence"))
        events += [state.status_events(res, "claimed", STATUS_PROCESSING, now, batch_id * 10 + 1),
                   state.ti_events(ti, now, batch_id * 10 + 2), state.verdict_events(res, now, batch_id * 10 + 3)]
    added = written(state.union_events(inserted.limit(0), *events), "cycle-events", scratch)
    changed = new.unionByName(state.partials(added))
    after_parts = written(state.merge_partials(parts.unionByName(state.partials(added))), "cycle-after", scratch)
    after = with_direction(state.finish(after_parts))
    board = written(difference(board_counts(after), board_counts(before), BOARD_SUMS), "cycle-board", scratch)
    kept.ti.append(difference(ti_values(after), ti_values(before), {"n": "bigint"}), batch_id)
    kept.kb.append(difference(kb_rollup(after), kb_rollup(before), KB_SUMS), batch_id)
    kept.board.append(board, batch_id)
    kept.alerts.append(state.merge_partials(changed), batch_id)
    kept.keep_open(after_parts, batch_id)
    return added, board, res


def start_incremental_cycle(stream_of_alerts: DataFrame, log_path: str, state_path: str, checkpoint: str | None = None,
                            trigger: dict | None = None, n: int | None = None, notifications_path: str | None = None,
                            changes_path: str | None = None, scorer=triage.rule_verdict, recover_after: int | None = None, **tables):
    """T3 as ``pipelines.start_cycle``, over kept state: same log, same verdicts, but a batch doesn't fold
    the log again. ``changes_path`` gets the boards' changes by batch (T6). A batch that fails raises; run
    again from the checkpoint, it overwrites what it wrote. The log is written for the record and not read."""
    spark = stream_of_alerts.sparkSession
    kept = CycleState(spark, state_path, **tables)
    checkpoint = checkpoint or new_table_path(spark, "cycle-checkpoint")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        scratch: list[str] = []
        try:
            inserted = state.inserted_events(batch).withColumn("seq", F.lit(batch_id * 10).cast("long"))
            inserted = written(inserted, "cycle-inserted", scratch)
            now = spark.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0]
            added, board, res = step(kept, inserted, batch_id, state.ts_lit(now), n, scorer, scratch, recover_after)
            _write_batch(inserted, log_path, batch_id, ("kind",), ("kind=inserted",))
            _write_batch(added, log_path, batch_id, ("kind",), ("kind=recovered", *CYCLE_KINDS))
            if changes_path:
                _write_batch(board, changes_path, batch_id)
            if notifications_path and res is not None:
                _write_batch(triage.notifications(res.drop("_ti")), notifications_path, batch_id)
        finally:
            for path in scratch:
                delete_path(spark, path)

    w = stream_of_alerts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()
