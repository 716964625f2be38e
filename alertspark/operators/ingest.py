"""Validated alert ingest (S2, S3, J3) and payload unwrapping.

Raw submissions are JSON text. They are parsed with an explicit all-text
schema, every rule becomes a predicate column, and the rows are split into
``valid`` (typed alert rows, status Pending) and ``rejected`` (with reasons).
The split is a pure projection + filter: no shuffle, except the primary-key
guard, which is an aggregation (first per id, reduced map-side) and an
anti-join against the existing ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STATUS_PENDING, VARCHAR_LIMITS
from ..functions.ip import CIDR_RE, with_direction
from ..schemas import ALERT_COLUMNS, SUBMISSION
from .state import first_per_id, py_ts_text, ts_lit

REQUIRED_TEXT = ["alert_id", "alert_name", "rule_name", "severity", "alert_time", "log_source", "time_window"]
_H = "[0-9A-Fa-f]{1,4}"
_V4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Eight groups; or fewer on both sides of one "::"; the last two as IPv4; a prefix up to 128.
IPV6_RE = ("^(?:" + f"(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}{_V4}|"
           + "|".join(f"(?:{_H}:){{{n}}}" + f"(?::{_H}){{1,{7 - n}}}" for n in range(1, 7))
           + f"|::(?:{_H}(?::{_H}){{0,6}})?"
           + f"|(?:{_H}:){{1,7}}:|"
           + "|".join((f"(?:{_H}:){{{n}}}:" if n else "::") + f"(?:{_H}:){{0,{5 - n if n else 5}}}{_V4}" for n in range(6))
           + ")(?:/(?:[0-9]|[1-9][0-9]|1[01][0-9]|12[0-8]))?$")
INT_RE = r"^\s*-?[0-9]+\s*$"


def submissions_from_alerts(alerts: DataFrame) -> DataFrame:
    """Render alert rows as submission payloads (``alert_id`` + ``payload`` JSON)."""
    body = F.struct(
        "alert_id", "alert_name", "rule_name", "severity", py_ts_text(F.col("alert_time")).alias("alert_time"),
        "log_source", "src_ip", "dest_ip", "protocol", "destination_ports", "event_count", "time_window",
        F.from_json("sample_logs", "array<map<string,string>>").alias("sample_logs"),
        F.from_json("asset", "map<string,string>").alias("asset"))
    return alerts.select(F.col("alert_id").alias("_row_id"), F.to_json(body).alias("payload"))


def valid_ip(c: Column) -> Column:
    """INET validity: IPv4 with optional prefix, or an IPv6-shaped literal."""
    return c.rlike(CIDR_RE) | c.rlike(IPV6_RE)


def _reasons(p: Column) -> Column:
    checks = [(p[c].isNull(), f"{c} is required") for c in REQUIRED_TEXT]
    checks += [
        (p["event_count"].isNull(), "event_count is required"),
        (p["event_count"].isNotNull() & (~p["event_count"].rlike(INT_RE) | F.trim(p["event_count"]).try_cast("int").isNull()),
         "event_count must be an integer"),
        (p["sample_logs"].isNull(), "sample_logs is required"),
        (p["sample_logs"].isNotNull() & F.from_json(p["sample_logs"], "array<map<string,string>>").isNull(),
         "sample_logs must be a list of objects"),
        (p["asset"].isNull(), "asset is required"),
        (p["asset"].isNotNull() & F.from_json(p["asset"], "map<string,string>").isNull(), "asset must be an object"),
        (p["destination_ports"].isNotNull() & (p["destination_ports"] != "null")
         & F.from_json(p["destination_ports"], "array<int>").isNull(), "destination_ports must be integers"),
        (p["alert_time"].isNotNull() & p["alert_time"].try_cast("timestamp_ntz").isNull(), "alert_time is not a timestamp"),
        (p["src_ip"].isNotNull() & ~valid_ip(p["src_ip"]), "src_ip is not a valid address"),
        (p["dest_ip"].isNotNull() & ~valid_ip(p["dest_ip"]), "dest_ip is not a valid address"),
    ]
    checks += [(F.length(p[c]) > n, f"{c} longer than {n}") for c, n in VARCHAR_LIMITS.items()
               if c in SUBMISSION.fieldNames()]
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)) for cond, msg in checks]))


def checked_alerts(raw: DataFrame, now=None, payload_col: str = "payload") -> DataFrame:
    """S2 + S3 in one pass: every submission as a typed alert row with its ``reasons`` (none if it is valid)
    and its ``payload``.

    The payload is parsed once per row and its fields come out of a generator
    (``inline``): the validity filter then reads materialised columns and is
    not pushed below the parse, which would re-parse the payload once per
    check."""
    fields = SUBMISSION.fieldNames()
    parsed = raw.select(F.col(payload_col),
                        F.inline(F.array(F.from_json(F.col(payload_col), SUBMISSION))))
    parsed = parsed.select(F.col(payload_col), F.struct(*fields).alias("p"))
    p = F.col("p")
    created = ts_lit(now) if now is not None else p["alert_time"].try_cast("timestamp_ntz")
    ports = F.coalesce(F.from_json(p["destination_ports"], "array<int>"), F.array().cast("array<int>"))
    return parsed.select(
        p["alert_id"].alias("alert_id"), p["alert_name"].alias("alert_name"), p["rule_name"].alias("rule_name"),
        p["severity"].alias("severity"), p["alert_time"].try_cast("timestamp_ntz").alias("alert_time"),
        p["log_source"].alias("log_source"), p["src_ip"].alias("src_ip"), p["dest_ip"].alias("dest_ip"),
        p["protocol"].alias("protocol"), ports.alias("destination_ports"),
        F.trim(p["event_count"]).try_cast("int").alias("event_count"), p["time_window"].alias("time_window"),
        p["sample_logs"].alias("sample_logs"), p["asset"].alias("asset"),
        F.lit(None).cast("string").alias("threat_intelligence"), created.alias("created_at"),
        F.lit(None).cast("string").alias("llm_classification"), F.lit(None).cast("decimal(5,2)").alias("llm_confidence"),
        F.lit(None).cast("string").alias("llm_reason"), F.lit(None).cast("string").alias("llm_recommendation"),
        F.lit(None).cast("timestamp_ntz").alias("analyzed_at"), F.lit(STATUS_PENDING).alias("analysis_status"),
        F.lit(None).cast("string").alias("triage_status"), _reasons(p).alias("reasons"), F.col(payload_col).alias("payload"))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid typed alerts, rejected rows with ``reasons``) of checked rows."""
    ok = F.size("reasons") == 0
    valid = with_direction(checked.where(ok).drop("reasons", "payload"), "dest_ip", "direction")
    return valid, checked.where(~ok).select("alert_id", "src_ip", "reasons", "payload")


def ingest_alerts(raw: DataFrame, now=None, payload_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """S2 + S3: (valid typed alerts, rejected rows with ``reasons``). Who uses both writes
    ``checked_alerts`` once and splits that."""
    return split_checked(checked_alerts(raw, now, payload_col))


def primary_key_guard(batch: DataFrame, existing_ids: DataFrame, order: tuple = ("alert_time",)) -> tuple[DataFrame, DataFrame]:
    """First row per ``alert_id`` within the batch (by ``order``, ties by the row's own text), minus
    ids already stored. Returns (accepted, duplicates): each row of the batch is in one of them."""
    whole = F.to_json(F.struct(*batch.columns))
    known = existing_ids.select(F.col("alert_id").alias("_id")).distinct().withColumn("_stored", F.lit(True))
    numbered = batch.withColumn("_n", F.row_number().over(Window.partitionBy("alert_id").orderBy(*order, whole))) \
        .join(known, F.col("alert_id") == F.col("_id"), "left")
    new = (F.col("_n") == 1) & F.col("_stored").isNull()
    return numbered.where(new).select(batch.columns), numbered.where(~new).select(batch.columns)


# --------------------------------------------------------------------------- P8–P10

MERGE_KEYS = ["alert_id", "alert_name", "rule_name", "severity", "alert_time", "log_source", "src_ip",
              "dest_ip", "protocol", "destination_ports", "event_count", "time_window", "sample_logs",
              "asset", "threat_intelligence"]


def unwrap_payload(df: DataFrame, wrapped: str = "alert") -> DataFrame:
    """Fields of a wrapped ``alert`` struct, overridden by direct fields
    whenever the direct value is not null."""
    wcols = set(df.schema[wrapped].dataType.fieldNames()) if wrapped in df.columns else set()
    out = []
    for k in MERGE_KEYS:
        direct = F.col(k) if k in df.columns else None
        inner = F.col(f"{wrapped}.{k}") if k in wcols else None
        parts = [c for c in (direct, inner) if c is not None]
        if parts:
            out.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(k))
    return df.select(*out)


def retrieval_context(df: DataFrame, nested: str = "rag") -> DataFrame:
    """``has_context``/``context_block`` from the nested object first; with a
    nested object ``has_context`` defaults to false, so the direct field is used
    only when the nested object is absent; the block falls back per key."""
    has_nested = F.col(nested).isNotNull() if nested in df.columns else F.lit(False)
    n_has = F.col(f"{nested}.has_context") if nested in df.columns else F.lit(None)
    n_blk = F.col(f"{nested}.context_block") if nested in df.columns else F.lit(None)
    d_has = F.col("has_context") if "has_context" in df.columns else F.lit(None)
    d_blk = F.col("context_block") if "context_block" in df.columns else F.lit(None)
    has = F.when(has_nested, F.coalesce(n_has, F.lit(False))).otherwise(F.coalesce(d_has, F.lit(False)))
    blk = F.coalesce(n_blk, d_blk, F.lit(""))
    return df.withColumn("has_context", has.cast("boolean")).withColumn("context_block", blk.cast("string"))


def split_missing_id(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10: null or empty ``alert_id`` → rejected."""
    bad = F.col("alert_id").isNull() | (F.col("alert_id") == "")
    return df.filter(~bad), df.filter(bad)


__all__ = ["ingest_alerts", "checked_alerts", "split_checked", "submissions_from_alerts", "primary_key_guard", "unwrap_payload",
           "retrieval_context", "split_missing_id", "ALERT_COLUMNS"]
