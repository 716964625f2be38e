"""P8–P10 payload handling, J2 reference attach, F8 prompt rendering, F12/F13/P11."""
from pyspark.sql import functions as F

from alertspark.functions.context import model_input, render_prompt
from alertspark.functions.normalize import confidence_band, threshold_op, threshold_value
from alertspark.operators.enrich import attach_reference
from alertspark.operators.ingest import retrieval_context, split_missing_id, unwrap_payload
from alertspark.operators.triage import verdict_checks


def test_unwrap_direct_overrides_when_not_null(spark):
    df = spark.createDataFrame(
        [(("A1", "wrapped rule", "Low"), None, "direct rule", None)],
        "alert struct<alert_id:string, rule_name:string, severity:string>, alert_id string, "
        "rule_name string, severity string")
    r = unwrap_payload(df).first()
    assert r.alert_id == "A1" and r.rule_name == "direct rule" and r.severity == "Low"


def test_retrieval_context_defaults(spark):
    df = spark.createDataFrame(
        [((None, "nested"), True, "direct"), (None, True, "direct"), ((None, None), None, "direct")],
        "rag struct<has_context:boolean, context_block:string>, has_context boolean, context_block string")
    rows = retrieval_context(df).select("has_context", "context_block").collect()
    assert rows[0].has_context is False and rows[0].context_block == "nested"
    assert rows[1].has_context is True and rows[1].context_block == "direct"
    assert rows[2].has_context is False and rows[2].context_block == "direct"


def test_missing_id_split(spark):
    df = spark.createDataFrame([("A",), ("",), (None,)], "alert_id string")
    ok, bad = split_missing_id(df)
    assert ok.count() == 1 and bad.count() == 2


def test_reference_attach_and_prompt(spark):
    df = spark.createDataFrame(
        [("A1", "Scan", "Port Scan", "High", "2024-01-01 00:00:00", "IDS", "1.2.3.4", "10.0.0.5", "TCP", [22, 80],
          5, "30s", '["{\\"port\\": 22}"]', '{"hostname": "h1", "zone": "dmz"}',
          '{"abuseipdb": "x"}', True, "block")],
        "alert_id string, alert_name string, rule_name string, severity string, alert_time string, "
        "log_source string, src_ip string, dest_ip string, protocol string, destination_ports array<int>, "
        "event_count int, time_window string, sample_logs string, asset string, threat_intelligence string, "
        "has_context boolean, context_block string")
    p = model_input(attach_reference(df))
    assert "alert_id" not in p.columns and len(p.columns) == 17  # 16 fields + row key
    text = p.select(render_prompt(p).alias("t")).first().t
    assert "- Rule Name: Port Scan" in text and "- Destination Ports: [22,80]" in text
    assert "--- TARGET ASSET INFORMATION ---\n- Hostname: h1\n- Zone: dmz" in text
    assert 'Log #1: {"port": 22}' in text
    assert "- Has Context: True\n- Context Block:\nblock" in text
    assert "[NETWORK_INFO]" in text and "[PLAYBOOKS]" in text
    assert text.index("ALERT CORE DETAILS") < text.index("TARGET ASSET") < text.index("THREAT INTELLIGENCE") \
        < text.index("SAMPLE LOGS") < text.index("HISTORICAL RAG") < text.index("ORGANIZATIONAL REFERENCE")


def test_thresholds_bands_and_checks(spark):
    df = spark.createDataFrame([(">20",), (">1GB",), ("10",)], "t string")
    r = df.select(threshold_value(F.col("t")).alias("v"), threshold_op(F.col("t")).alias("o")).collect()
    assert [x.v for x in r] == [20.0, 1e9, 10.0] and [x.o for x in r] == [">", ">", "="]
    c = spark.createDataFrame([(85.0,), (84.99,), (65.0,), (50.0,), (49.9,)], "c double")
    assert [x.b for x in c.select(confidence_band(F.col("c")).alias("b")).collect()] == \
        ["strong", "supported", "supported", "ambiguous", "weak"]
    v = spark.createDataFrame([("A", "Maybe", 120.0, "word " * 81, "ok", "Done")],
                              "alert_id string, llm_classification string, llm_confidence double, "
                              "llm_reason string, llm_recommendation string, triage_status string")
    assert verdict_checks(v).first().violations == ["classification", "confidence_range", "reason_words",
                                                    "triage_status"]
