"""Seed goldens: the 15 seed alerts (FIXTURES.md §1), values derived by hand
from the operator semantics."""
import pytest
from pyspark.sql import functions as F

from alertspark.functions.ip import classify_cols, with_direction
from alertspark.functions.normalize import build_query, event_volume
from alertspark.operators import enrich
from alertspark.sources.reference import load_reference

SEEDS = [
    ("ALT-100001", "SQLi", "185.220.101.55", "10.0.0.10", "HTTP", [80], 85, "2m"),
    ("ALT-100002", "Port Scan", "192.168.1.50", "10.0.0.5", "TCP", [22, 80, 443, 3306, 5432], 650, "30s"),
    ("ALT-100003", "Exfiltration", "172.16.10.50", "185.199.108.153", "HTTPS", [443], 1800, "15m"),
    ("ALT-100004", "Auth Limit", "45.33.32.9", "10.0.0.10", "TCP", [22], 45, "60s"),
    ("ALT-100005", "Segmentation", "172.16.10.50", "10.0.0.2", "TCP", [445, 135], 110, "5m"),
    ("ALT-100006", "Port Scan", "103.21.244.5", "10.0.0.10", "TCP", [22, 23, 80, 443, 8080, 8443], 320, "30s"),
    ("ALT-100007", "Exfiltration", "10.0.0.5", "198.51.100.42", "HTTPS", [443], 2400, "10m"),
    ("ALT-100008", "WAF Attack", "51.158.1.99", "10.0.0.10", "HTTP", [80], 12, "1m"),
    ("ALT-100009", "Segmentation", "172.16.1.100", "10.0.0.2", "TCP", [445, 3389], 4, "5m"),
    ("ALT-100010", "C2 Beacon", "172.16.10.50", "93.184.216.34", "DNS", [53], 540, "15m"),
    ("ALT-100011", "Auth Limit", "104.28.16.88", "10.0.0.2", "TCP", [3389], 60, "60s"),
    ("ALT-100012", "Traffic Spike", "10.0.0.10", "10.0.0.5", "TCP", [5432], 350, "5m"),
    ("ALT-100013", "SQLi", "198.51.100.200", "10.0.0.10", "HTTPS", [443], 120, "2m"),
    ("ALT-100014", "Malware Match", "172.16.10.50", "172.16.10.50", "LOCAL", [], 1500, "1m"),
    ("ALT-100015", "Port Scan", "51.158.1.12", "10.0.0.10", "TCP", [21, 22, 25, 80, 110, 443, 3389, 8080], 410, "30s"),
]
SCHEMA = ("alert_id string, rule_name string, src_ip string, dest_ip string, protocol string, "
          "destination_ports array<int>, event_count int, time_window string")


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame(SEEDS, SCHEMA)


def _by_id(df, col):
    return {r.alert_id: r[col] for r in df.select("alert_id", col).collect()}


def test_direction(seeds):
    d = _by_id(with_direction(seeds), "direction")
    outbound = {"ALT-100003", "ALT-100007", "ALT-100010"}
    assert {k for k, v in d.items() if v == "Outbound"} == outbound


def test_address_classes(seeds):
    c = classify_cols(seeds).collect()
    ext_src = {r.alert_id for r in c if r.source_type == "External source"}
    ext_dst = {r.alert_id for r in c if r.destination_type == "External destination"}
    assert ext_src == {"ALT-100001", "ALT-100004", "ALT-100006", "ALT-100008", "ALT-100011", "ALT-100015"}
    assert ext_dst == {"ALT-100003", "ALT-100010"}


def test_volume(seeds):
    v = _by_id(seeds.withColumn("v", event_volume(F.col("event_count"))), "v")
    assert {k for k, x in v.items() if x == "low event volume"} == {"ALT-100008", "ALT-100009"}
    assert {k for k, x in v.items() if x == "medium event volume"} == {"ALT-100001", "ALT-100004", "ALT-100011"}


def test_query_text(seeds):
    a = classify_cols(seeds)
    q = _by_id(a.withColumn("q", build_query(F.col("rule_name"), "src_ip", "dest_ip", F.col("protocol"),
                                                F.col("destination_ports"), F.col("event_count"),
                                                source_type=F.col("source_type"),
                                                destination_type=F.col("destination_type"))), "q")
    assert q["ALT-100006"] == ("Security behavior: Port Scan. Source type: External source. Destination type: "
                               "Internal destination. Protocol: TCP. Target services: SSH, Telnet, HTTP, HTTPS, "
                               "unknown service, unknown service. Event volume: high event volume.")
    assert q["ALT-100014"] == ("Security behavior: Malware Match. Source type: Internal source. Destination type: "
                               "Internal destination. Protocol: LOCAL. Target services: unknown. Event volume: "
                               "high event volume.")


def test_query_defaults_and_cut(spark):
    df = spark.createDataFrame([("", None, "", None, [-1, 22], None)],
                               "rule_name string, src_ip string, dest_ip string, protocol string, "
                               "destination_ports array<int>, event_count int")
    r = df.select(build_query(F.col("rule_name"), "src_ip", "dest_ip", F.col("protocol"), F.col("destination_ports"),
                              F.col("event_count")).alias("q")).first().q
    assert r == ("Security behavior: Unknown Rule. Source type: unknown_source. Destination type: "
                 "unknown_destination. Protocol: Unknown protocol. Target services: SSH. Event volume: "
                 "unknown event volume.")
    long = spark.createDataFrame([("x" * 600,)], "rule_name string").select(
        build_query(F.col("rule_name"), "rule_name", "rule_name", F.lit(None).cast("string"),
                    F.lit(None).cast("array<int>"), F.lit(None).cast("int")).alias("q")).first().q
    assert len(long) == 500


def test_approved_and_segmentation(spark, seeds):
    ref = load_reference(spark)
    ap = _by_id(enrich.approved_match(seeds, ref["approved"]), "approved_label")
    assert ap["ALT-100002"] == "VulnerabilityScanner"
    assert ap["ALT-100003"] == "FinanceServer01"
    assert sum(v is not None for v in ap.values()) == 2
    seg = _by_id(enrich.segmentation_check(seeds, ref["segmentation"]), "seg_status")
    assert seg["ALT-100005"] == "violation"
    assert seg["ALT-100009"] == "exception"
    assert seg["ALT-100012"] == "allowed"  # DMZ host 10.0.0.10 -> 10.0.0.5 on 5432
