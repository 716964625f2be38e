"""Monitoring aggregates.

All are single hash aggregations with partial aggregation before the shuffle,
so a hot group (one rule or source holding a large share of alerts) is reduced
map-side. Results are alias-stable and typed (BIGINT counts, DOUBLE means
rounded to 6 decimals) for comparison with the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_FP, CLASS_NR, CLASS_TP, STATUS_PROCESSED


def status_board(alerts: DataFrame) -> DataFrame:
    """Counts by (analysis_status, triage_status)."""
    return alerts.groupBy("analysis_status", "triage_status").agg(F.count("*").cast("bigint").alias("n"))


def detected_threats(alerts: DataFrame) -> DataFrame:
    """Processed alerts by classification, severity and direction."""
    p = alerts.filter(F.col("analysis_status") == STATUS_PROCESSED)
    return p.groupBy("llm_classification", "severity", "direction").agg(
        F.count("*").cast("bigint").alias("n"),
        F.round(F.avg(F.col("llm_confidence").cast("double")), 6).alias("avg_confidence"))


def threat_patterns(alerts: DataFrame) -> DataFrame:
    """Counts by rule, source and hour, with distinct destinations."""
    return alerts.groupBy("rule_name", "src_ip", F.date_trunc("hour", "alert_time").alias("hour")).agg(
        F.count("*").cast("bigint").alias("n"),
        F.count_distinct("dest_ip").cast("bigint").alias("distinct_destinations"))


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def triage_latency(alerts: DataFrame) -> DataFrame:
    """``analyzed_at − alert_time`` (seconds) by rule."""
    p = alerts.filter(F.col("analyzed_at").isNotNull())
    s = _seconds(F.col("alert_time"), F.col("analyzed_at"))
    return p.groupBy("rule_name").agg(
        F.count("*").cast("bigint").alias("n"), F.round(F.avg(s), 6).alias("avg_seconds"),
        F.round(F.min(s), 6).alias("min_seconds"), F.round(F.max(s), 6).alias("max_seconds"))


def verdict_quality(df: DataFrame, predicted: str = "llm_classification",
                    expected: str = "expected_label", by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision and recall (positive = True
    Positive); Needs Review predictions are counted apart."""
    p, e = F.col(predicted), F.col(expected)
    tp = F.count_if((p == CLASS_TP) & (e == CLASS_TP)).cast("bigint")
    fp = F.count_if((p == CLASS_TP) & (e == CLASS_FP)).cast("bigint")
    tn = F.count_if((p == CLASS_FP) & (e == CLASS_FP)).cast("bigint")
    fn = F.count_if((p == CLASS_FP) & (e == CLASS_TP)).cast("bigint")
    nr = F.count_if(p == CLASS_NR).cast("bigint")
    agg = df.groupBy(*(by or [])).agg(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
                                      nr.alias("needs_review"))
    ratio = lambda a, b: F.when(b > 0, F.round(a.cast("double") / b, 6))
    return agg.select("*",
                      ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
                      .alias("accuracy"),
                      ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def recent_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    """O3: newest ``n`` alerts (TakeOrderedAndProject, no full sort)."""
    return alerts.orderBy(F.col("alert_time").desc(), F.col("alert_id").desc()).limit(n) \
        .select("alert_id", "alert_time", "rule_name", "severity", "analysis_status")
