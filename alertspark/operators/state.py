"""Work-queue state: status filter, counts, gate, FIFO claim, recovery, updates,
and the append-only event log folded to the current row (P1–P3, G1–G5, O1, O4,
J4, J5).

Parquet tables are immutable, so every transition is expressed as a pure
``DataFrame → DataFrame`` function, and persistent state is an append-only
event log folded with one hash aggregation keyed by ``alert_id``. The fold uses
``max_by``/``min_by`` (partial aggregation before the shuffle), so an alert id
that repeats many times — a hot key — is reduced map-side and never gathers
its raw rows in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (STATUS_PENDING, STATUS_PROCESSED, STATUS_PROCESSING)
from ..schemas import ALERT_COLUMNS

VERDICT_COLS = ["llm_classification", "llm_confidence", "llm_reason", "llm_recommendation",
                "analyzed_at", "triage_status"]
BASE_COLS = [c for c in ALERT_COLUMNS
             if c not in VERDICT_COLS + ["analysis_status", "threat_intelligence"]]


def ts_lit(now) -> Column:
    """An explicit clock value as TIMESTAMP_NTZ (transitions never read the wall clock)."""
    if isinstance(now, Column):
        return now.cast("timestamp_ntz")
    if isinstance(now, dt.datetime):
        now = now.isoformat(sep=" ")
    return F.lit(str(now)).cast("timestamp_ntz")


def py_ts_text(c: Column) -> Column:
    """Python ``str(datetime)`` rendering: seconds, plus 6 fraction digits only when non-zero."""
    frac = F.unix_micros(c.cast("timestamp")) % 1000000
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(frac == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


# --------------------------------------------------------------------------- P1, G1–G3

def status_filter(alerts: DataFrame, status: str) -> DataFrame:
    """Rows in one ``analysis_status`` (pushed into the parquet scan)."""
    return alerts.filter(F.col("analysis_status") == status)


def queue_counts(alerts: DataFrame) -> DataFrame:
    """G1 + G2 in one pass: in-flight (Processing) and pending counts."""
    s = F.col("analysis_status")
    return alerts.agg(F.count_if(s == STATUS_PROCESSING).cast("bigint").alias("in_flight"),
                      F.count_if(s == STATUS_PENDING).cast("bigint").alias("pending"))


def queue_gate(alerts: DataFrame) -> DataFrame:
    """``skip`` while anything is in flight, else ``trigger`` if work is pending, else ``idle``."""
    c = queue_counts(alerts)
    return c.withColumn("decision", F.when(F.col("in_flight") > 0, "skip")
                        .when(F.col("pending") > 0, "trigger").otherwise("idle"))


# --------------------------------------------------------------------------- O1, O4

def claim(alerts: DataFrame, n: int = 1) -> DataFrame:
    """O1: the ``n`` oldest Pending alerts (ties by ``alert_id``), flipped to Processing.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject: each task keeps its
    own top-n and only n rows per task reach the final merge, so the claim
    never sorts the table.
    """
    oldest = (status_filter(alerts, STATUS_PENDING)
              .orderBy(F.col("alert_time").asc(), F.col("alert_id").asc())
              .limit(n))
    return oldest.withColumn("analysis_status", F.lit(STATUS_PROCESSING))


def claim_pending(alerts: DataFrame) -> DataFrame:
    """Every Pending alert, flipped to Processing: what repeated claims take in the end."""
    return status_filter(alerts, STATUS_PENDING).withColumn("analysis_status", F.lit(STATUS_PROCESSING))


def recover(alerts: DataFrame) -> DataFrame:
    """Every Processing alert back to Pending (startup recovery, no age limit)."""
    s = F.col("analysis_status")
    return alerts.withColumn("analysis_status",
                             F.when(s == STATUS_PROCESSING, F.lit(STATUS_PENDING)).otherwise(s))


# --------------------------------------------------------------------------- P2, P3

def _ip_or_null(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c)).alias(c)


def claimed_projection(df: DataFrame) -> DataFrame:
    """The 21 fields returned by a claim (times and IPs as text)."""
    return df.select(
        "alert_id", "alert_name", "rule_name", "severity",
        py_ts_text(F.col("alert_time")).alias("alert_time"), "log_source",
        _ip_or_null("src_ip"), _ip_or_null("dest_ip"), "protocol", "destination_ports",
        "event_count", "time_window", "sample_logs", "asset", "threat_intelligence",
        "llm_classification", "llm_confidence", "llm_reason", "llm_recommendation",
        py_ts_text(F.col("analyzed_at")).alias("analyzed_at"), "analysis_status")


def ti_updated_projection(df: DataFrame) -> DataFrame:
    """The 14 fields returned after a TI update (``alert_name`` is not among them)."""
    return df.select(
        "alert_id", "rule_name", "severity", py_ts_text(F.col("alert_time")).alias("alert_time"),
        "log_source", _ip_or_null("src_ip"), _ip_or_null("dest_ip"), "protocol",
        "destination_ports", "event_count", "time_window", "sample_logs", "asset",
        "threat_intelligence")


# --------------------------------------------------------------------------- J4, J5

def apply_ti(alerts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set ``threat_intelligence`` by id. Returns (alerts, not_found updates).

    ``updates`` holds (alert_id, threat_intelligence); one update per id is
    kept (the last by ``seq`` when given). Status is untouched.
    """
    u = last_per_id(updates, ["threat_intelligence"]).select("alert_id", F.col("threat_intelligence").alias("_new_ti"))
    out = (alerts.join(u, "alert_id", "left")
           .withColumn("threat_intelligence",
                       F.when(F.col("_new_ti").isNotNull(), F.col("_new_ti"))
                       .otherwise(F.col("threat_intelligence")))
           .drop("_new_ti"))
    not_found = u.join(alerts.select("alert_id"), "alert_id", "left_anti") \
        .withColumn("message", F.concat(F.lit("Alert with ID "), F.col("alert_id"), F.lit(" not found.")))
    return out, not_found


def apply_verdicts(alerts: DataFrame, verdicts: DataFrame, now) -> DataFrame:
    """Overwrite the verdict fields by id, set ``analyzed_at = now`` and status
    Processed. No guard on the previous status; unknown ids change nothing; of
    several verdicts for an id the last by ``seq`` counts."""
    verdicts = last_per_id(verdicts, ["llm_classification", "llm_confidence", "llm_reason", "llm_recommendation", "triage_status"])
    v = verdicts.select(
        "alert_id",
        F.col("llm_classification").alias("_c"),
        F.round(F.col("llm_confidence").cast("double"), 2).cast("decimal(5,2)").alias("_f"),
        F.col("llm_reason").alias("_r"), F.col("llm_recommendation").alias("_m"),
        F.col("triage_status").alias("_t"), F.lit(True).alias("_hit"))
    j = alerts.join(v, "alert_id", "left")
    hit = F.col("_hit").isNotNull()
    sets = {
        "llm_classification": F.col("_c"), "llm_confidence": F.col("_f"),
        "llm_reason": F.col("_r"), "llm_recommendation": F.col("_m"),
        "analyzed_at": ts_lit(now), "analysis_status": F.lit(STATUS_PROCESSED),
        "triage_status": F.col("_t"),
    }
    for c, val in sets.items():
        j = j.withColumn(c, F.when(hit, val).otherwise(F.col(c)))
    return j.drop("_c", "_f", "_r", "_m", "_t", "_hit")


# --------------------------------------------------------------------------- G5 event log

def _event(df: DataFrame, kind: str, event_ts, seq: int | Column, **cols: Column) -> DataFrame:
    sel = [F.col("alert_id"), F.lit(kind).alias("kind"), ts_lit(event_ts).alias("event_ts"),
           (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq")]
    return df.select(*sel, *[c.alias(name) for name, c in cols.items()])


def inserted_events(alerts: DataFrame) -> DataFrame:
    """Log rows carrying the full inserted alert (event time = ``created_at``)."""
    return alerts.select("alert_id", F.lit("inserted").alias("kind"),
                         F.col("created_at").alias("event_ts"), F.lit(0).cast("bigint").alias("seq"),
                         *[c for c in ALERT_COLUMNS if c != "alert_id"])


def status_events(df: DataFrame, kind: str, status: str, now, seq: int) -> DataFrame:
    return _event(df, kind, now, seq, analysis_status=F.lit(status))


def ti_events(updates: DataFrame, now, seq: int) -> DataFrame:
    return _event(updates, "ti_updated", now, seq, threat_intelligence=F.col("threat_intelligence"))


def verdict_events(verdicts: DataFrame, now, seq: int) -> DataFrame:
    return _event(verdicts, "verdict", now, seq,
                  llm_classification=F.col("llm_classification"),
                  llm_confidence=F.round(F.col("llm_confidence").cast("double"), 2).cast("decimal(5,2)"),
                  llm_reason=F.col("llm_reason"), llm_recommendation=F.col("llm_recommendation"),
                  analyzed_at=ts_lit(now), analysis_status=F.lit(STATUS_PROCESSED),
                  triage_status=F.col("triage_status"))


def union_events(*logs: DataFrame) -> DataFrame:
    return logs[0].unionByName(logs[1], allowMissingColumns=True) if len(logs) == 2 else \
        union_events(logs[0].unionByName(logs[1], allowMissingColumns=True), *logs[2:]) if len(logs) > 2 \
        else logs[0]


def fold(log: DataFrame) -> DataFrame:
    """Event log → current state, last writer wins per column group.

    Base columns come from the first ``inserted`` event (primary key: later
    inserts of the same id are ignored); status from the latest event that
    sets one; TI from the latest insert/TI update; the verdict group from the
    latest insert/verdict. One aggregation (sort-based: its buffers hold text).
    """
    return finish(merge_partials(partials(log)))


def partials(log: DataFrame) -> DataFrame:
    """Of each event what it says of its alert, each part with its place in time: the first
    insert (``_b``), status (``_s``), TI (``_t``), verdict (``_v``)."""
    kind, at = F.col("kind"), ["event_ts", "seq"]
    return log.select(
        "alert_id",
        F.when(kind == "inserted", F.struct(*at, *BASE_COLS)).alias("_b"),
        F.when(F.col("analysis_status").isNotNull(), F.struct(*at, "analysis_status")).alias("_s"),
        F.when(kind.isin("inserted", "ti_updated"), F.struct(*at, "threat_intelligence")).alias("_t"),
        F.when(kind.isin("inserted", "verdict"), F.struct(*at, *VERDICT_COLS)).alias("_v"))


def merge_partials(parts: DataFrame) -> DataFrame:
    """One row per alert. Parts can be merged in any order and more than once (ties in time go by
    the values), so states that are kept may be merged with later events."""
    return parts.groupBy("alert_id").agg(F.min("_b").alias("_b"), *[F.max(c).alias(c) for c in ("_s", "_t", "_v")])


def finish(parts: DataFrame) -> DataFrame:
    """Alert rows of merged parts; ids without an insert are no alerts yet."""
    where = {**{c: "_b" for c in BASE_COLS}, **{c: "_v" for c in VERDICT_COLS}, "analysis_status": "_s", "threat_intelligence": "_t"}
    return parts.where(F.col("_b").isNotNull()).select(
        *[F.col(c) if c == "alert_id" else F.col(f"{where[c]}.{c}").alias(c) for c in ALERT_COLUMNS])


def first_per_id(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Keep the first row per ``alert_id`` by ``order_cols``, ties by the row's
    own text (aggregation, not a window, so duplicates are reduced before the shuffle)."""
    cols = [c for c in df.columns if c != "alert_id"]
    g = df.groupBy("alert_id").agg(
        F.min_by(F.struct(*cols), F.struct(*order_cols, F.to_json(F.struct(*cols)))).alias("_r"))
    return g.select("alert_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def last_per_id(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per ``alert_id``: the last by ``seq`` where there is one, ties by value."""
    order = (["seq"] if "seq" in df.columns else []) + cols
    g = df.groupBy("alert_id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select("alert_id", *[F.col(f"_r.{c}").alias(c) for c in cols])
