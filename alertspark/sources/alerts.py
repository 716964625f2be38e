"""Alert sources.

* ``read_alerts`` (S1): bulk load of an alert table with the fixed schema.
* ``alerts_from_events`` — the test tables hold no alerts, so each ``events``
  row is mapped to one alert by a deterministic rule (documented in
  FIXTURES.md §6). Only functions whose results agree in Spark and DuckDB are
  used, so the same mapping can be written as SQL for the oracle.

The mapping is a pure per-row projection: it is a narrow transformation that
keeps the scan's partitioning, so it adds no shuffle at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ip import with_direction
from .tables import read_table

# FIXED VALUES of our adapter (FIXTURES.md §6) — not reference values.
RULE_BY_EVENT_TYPE = [("error", "Port Scan"), ("click", "SQLi"), ("view", "Segmentation"),
                      ("purchase", "Exfiltration"), ("signup", "Auth Limit")]
SEVERITIES = ["Low", "Medium", "High", "Critical"]
LOG_SOURCES = ["Firewall", "WebServer", "IDS/IPS", "WAF", "EDR"]
PROTOCOLS = ["TCP", "HTTP", "HTTPS", "DNS", "UDP", None]
TIME_WINDOWS = ["30s", "60s", "5m", "15m"]
PORT_LISTS = [[22, 23, 80, 443], [22], [443], [445, 3389], [8080, 5432, 53], []]
CLASS_BY_K = ["True Positive", "False Positive", "Needs Review"]
# Extra sample-log elements for the rule operators (SQLi/XSS payloads and a
# probe of twelve ports).
SCAN_PORTS = [21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 3306, 3389]
SQLI_LOG = ',{"method":"GET","url":"/item?id=%s UNION SELECT username,password FROM users--","status":"403"}'
XSS_LOG = ',{"method":"POST","url":"/search","payload":"<script>alert(%s)</script>","status":"200"}'
SCAN_LOGS = "".join(',{"port":%d,"action":"DENY"}' % p for p in SCAN_PORTS)


def read_alerts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bulk load with the fixed 23-column schema (never inferred)."""
    return spark.read.format(fmt).schema(schemas.ALERTS).load(path)


def _case(key: Column, values: list, cast: str | None = None) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])
        if isinstance(v, list) and not v:
            lit = F.array().cast("array<int>")
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    return expr if cast is None else expr.cast(cast)


def alerts_from_events(events: DataFrame) -> DataFrame:
    """Map every ``events`` row to one alert row with the alert schema + ``direction``."""
    k = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    eid, uid = F.col("event_id"), F.col("user_id")
    kk = F.col("k")
    rule = None
    for et, rn in RULE_BY_EVENT_TYPE:
        rule = F.when(F.col("event_type") == et, rn) if rule is None else rule.when(F.col("event_type") == et, rn)
    rule = rule.otherwise(F.col("event_type"))
    severity = _case(kk % 4, SEVERITIES)
    src = (F.when(uid % 10 == 1, F.concat(F.lit("10.0.0."), (uid % 250).cast("string")))
           .when(uid % 10 == 2, "172.16.10.50")
           .when(uid % 10 == 3, "172.16.1.100")
           .when(uid % 10 == 4, "192.168.1.50")
           .when(uid % 10 == 5, F.concat(F.lit("185.220.101."), kk.cast("string")))
           .when(uid % 10 == 6, F.concat(F.lit("198.51.100."), kk.cast("string")))
           .when(uid % 10 == 7, "127.0.0.1")
           .when(uid % 10 == 8, "not-an-ip")
           .when(uid % 10 == 9, F.concat(F.lit("103.21.244."), kk.cast("string"))))
    dest = (F.when(eid % 8 == 0, "10.0.0.10")
            .when(eid % 8 == 1, "10.0.0.5")
            .when(eid % 8 == 2, "10.0.0.2")
            .when(eid % 8 == 3, "185.199.108.153")
            .when(eid % 8 == 4, F.concat(F.lit("198.51.100."), kk.cast("string")))
            .when(eid % 8 == 5, F.concat(F.lit("93.184.216."), kk.cast("string")))
            .when(eid % 8 == 6, "172.16.10.50"))
    processed = eid % 3 == 0
    status = (F.when(processed, "Processed").when(eid % 101 == 0, "Processing")
              .otherwise("Pending"))
    ti = F.when(kk % 5 != 0, F.concat(
        F.lit('{"abuseipdb":{"abuseConfidenceScore":'), kk.cast("string"),
        F.lit(',"totalReports":'), (kk % 7).cast("string"),
        F.lit('},"virustotal":{"malicious":'), (kk % 20).cast("string"), F.lit("}}")))
    extra = (F.when((F.col("event_type") == "click") & (kk % 4 == 0),
                    F.format_string(SQLI_LOG, kk))
             .when((F.col("event_type") == "click") & (kk % 4 == 1),
                   F.format_string(XSS_LOG, kk))
             .when((F.col("event_type") == "error") & (kk % 3 == 0), F.lit(SCAN_LOGS))
             .otherwise(F.lit("")))
    logs = F.concat(F.lit('[{"user":"u'), kk.cast("string"), F.lit('","status":"failed"},{"bytes_transferred":'),
                    (kk.cast("bigint") * 20000000).cast("string"), F.lit("}"), extra, F.lit("]"))
    out = e.select(
        F.concat(F.lit("ALT-"), (eid + 100000).cast("string")).alias("alert_id"),
        rule.alias("alert_name"),
        rule.alias("rule_name"),
        severity.alias("severity"),
        F.col("ts").alias("alert_time"),
        _case(uid % 5, LOG_SOURCES).alias("log_source"),
        src.alias("src_ip"),
        dest.alias("dest_ip"),
        _case(eid % 6, PROTOCOLS).cast("string").alias("protocol"),
        _case(kk % 6, PORT_LISTS).alias("destination_ports"),
        F.when(eid % 50 != 49, F.floor("value").cast("int")).alias("event_count"),
        _case(eid % 4, TIME_WINDOWS).alias("time_window"),
        logs.alias("sample_logs"),
        F.concat(F.lit('{"hostname":"host'), uid.cast("string"), F.lit('","criticality":"'),
                 severity, F.lit('"}')).alias("asset"),
        ti.alias("threat_intelligence"),
        F.col("ts").alias("created_at"),
        F.when(processed, _case(kk % 3, CLASS_BY_K)).alias("llm_classification"),
        F.when(processed, (F.lit(50) + kk * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(5,2)"))
        .alias("llm_confidence"),
        F.lit(None).cast("string").alias("llm_reason"),
        F.lit(None).cast("string").alias("llm_recommendation"),
        F.when(processed, F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("analyzed_at"),
        status.alias("analysis_status"),
        F.when(processed, F.when(kk % 10 == 0, "Failed").otherwise("Succeeded")).alias("triage_status"),
    )
    return with_direction(out, "dest_ip", "direction")


def load_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts view over the driver tables (what every registered query reads)."""
    return alerts_from_events(read_table(spark, sf_dir, "events"))
