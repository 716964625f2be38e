"""Explicit schemas. Nothing in this library infers a schema."""

from pyspark.sql import types as T

ALERTS = T.StructType([
    T.StructField("alert_id", T.StringType(), False),
    T.StructField("alert_name", T.StringType(), False),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("alert_time", T.TimestampNTZType(), False),
    T.StructField("log_source", T.StringType(), False),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dest_ip", T.StringType(), True),
    T.StructField("protocol", T.StringType(), True),
    T.StructField("destination_ports", T.ArrayType(T.IntegerType()), True),
    T.StructField("event_count", T.IntegerType(), True),
    T.StructField("time_window", T.StringType(), True),
    T.StructField("sample_logs", T.StringType(), True),
    T.StructField("asset", T.StringType(), True),
    T.StructField("threat_intelligence", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("llm_classification", T.StringType(), True),
    T.StructField("llm_confidence", T.DecimalType(5, 2), True),
    T.StructField("llm_reason", T.StringType(), True),
    T.StructField("llm_recommendation", T.StringType(), True),
    T.StructField("analyzed_at", T.TimestampNTZType(), True),
    T.StructField("analysis_status", T.StringType(), True),
    T.StructField("triage_status", T.StringType(), True),
])

ALERT_COLUMNS = [f.name for f in ALERTS.fields]

# Inbound submission (JSON request body). Types are loose on purpose: the
# validator, not the reader, decides what is acceptable, so every field is
# read as text / raw JSON and checked with try_cast.
SUBMISSION = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("alert_name", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("alert_time", T.StringType()),
    T.StructField("log_source", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("destination_ports", T.StringType()),
    T.StructField("event_count", T.StringType()),
    T.StructField("time_window", T.StringType()),
    T.StructField("sample_logs", T.StringType()),
    T.StructField("asset", T.StringType()),
])

ASSET = T.StructType([
    T.StructField("hostname", T.StringType()),
    T.StructField("criticality", T.StringType()),
    T.StructField("zone", T.StringType()),
])

SAMPLE_LOG = T.MapType(T.StringType(), T.StringType())
SAMPLE_LOGS = T.ArrayType(SAMPLE_LOG)

KB = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

TI_ABUSE = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("abuseConfidenceScore", T.IntegerType()),
    T.StructField("totalReports", T.IntegerType()),
    T.StructField("isTor", T.BooleanType()),
    T.StructField("isWhitelisted", T.BooleanType()),
    T.StructField("countryCode", T.StringType()),
])

TI_VT = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("malicious", T.IntegerType()),
    T.StructField("suspicious", T.IntegerType()),
    T.StructField("undetected", T.IntegerType()),
    T.StructField("harmless", T.IntegerType()),
    T.StructField("timeout", T.IntegerType()),
])

VERDICTS = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("llm_classification", T.StringType()),
    T.StructField("llm_confidence", T.DoubleType()),
    T.StructField("llm_reason", T.StringType()),
    T.StructField("llm_recommendation", T.StringType()),
    T.StructField("triage_status", T.StringType()),
])

# Append-only alert event log (see state.py). One row per transition.
EVENT_LOG = T.StructType([
    T.StructField("alert_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("analysis_status", T.StringType()),
    T.StructField("threat_intelligence", T.StringType()),
    T.StructField("llm_classification", T.StringType()),
    T.StructField("llm_confidence", T.DecimalType(5, 2)),
    T.StructField("llm_reason", T.StringType()),
    T.StructField("llm_recommendation", T.StringType()),
    T.StructField("analyzed_at", T.TimestampNTZType()),
    T.StructField("triage_status", T.StringType()),
])
