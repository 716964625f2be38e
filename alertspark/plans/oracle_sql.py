"""DuckDB SQL for the correctness oracle.

Each statement re-derives its inputs from the pre-registered test views
(``events``, ``embeddings``, ``benchmark`` …) so the oracle shares no code path
with the Spark implementation.
"""

from __future__ import annotations

import re

from ..constants import (IPV4_PRIVATE_EXCEPTIONS, IPV4_PRIVATE_NETWORKS, PORT_SERVICES,
                         RFC1918_NETWORKS)
from ..functions.ip import net_bounds
from ..sources.alerts import SCAN_LOGS

_OCT = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}$"


def _num(col: str) -> str:
    return (f"(CASE WHEN regexp_full_match({col}, '{_V4}') THEN "
            f"CAST(split_part({col}, '.', 1) AS BIGINT) * 16777216 + "
            f"CAST(split_part({col}, '.', 2) AS BIGINT) * 65536 + "
            f"CAST(split_part({col}, '.', 3) AS BIGINT) * 256 + "
            f"CAST(split_part({col}, '.', 4) AS BIGINT) END)")


def _in(num: str, nets) -> str:
    return "(" + " OR ".join(f"{num} BETWEEN {lo} AND {hi}"
                             for lo, hi in (net_bounds(a, p) for a, p in nets)) + ")"


def classify_sql(col: str, role: str) -> str:
    n = _num(col)
    return (f"(CASE WHEN {n} IS NULL THEN 'unknown_{role}' "
            f"WHEN {_in(n, IPV4_PRIVATE_NETWORKS)} AND NOT {_in(n, IPV4_PRIVATE_EXCEPTIONS)} "
            f"THEN 'Internal {role}' ELSE 'External {role}' END)")


def direction_sql(col: str) -> str:
    n = _num(col)
    return f"(CASE WHEN {_in(n, RFC1918_NETWORKS)} THEN 'Inbound' ELSE 'Outbound' END)"


def port_case(p: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in PORT_SERVICES.items())
    return f"(CASE {p} {whens} ELSE 'unknown service' END)"


def services_sql(col: str) -> str:
    return (f"list_transform(list_filter(coalesce({col}, []::INTEGER[]), lambda p: p IS NOT NULL AND p >= 0), "
            f"lambda p: {port_case('p')})")


def volume_sql(col: str) -> str:
    return (f"(CASE WHEN {col} IS NULL THEN 'unknown event volume' WHEN {col} < 20 THEN 'low event volume' "
            f"WHEN {col} < 100 THEN 'medium event volume' ELSE 'high event volume' END)")


def query_text_sql(a: str = "") -> str:
    p = f"{a}." if a else ""
    svc = f"array_to_string({services_sql(p + 'destination_ports')}, ', ')"
    return ("substring(regexp_replace('Security behavior: ' || "
            f"(CASE WHEN coalesce({p}rule_name, '') = '' THEN 'Unknown Rule' ELSE {p}rule_name END) || "
            f"'. Source type: ' || {classify_sql(p + 'src_ip', 'source')} || "
            f"'. Destination type: ' || {classify_sql(p + 'dest_ip', 'destination')} || "
            f"'. Protocol: ' || (CASE WHEN coalesce({p}protocol, '') = '' THEN 'Unknown protocol' ELSE {p}protocol END) || "
            f"'. Target services: ' || (CASE WHEN {svc} = '' THEN 'unknown' ELSE {svc} END) || "
            f"'. Event volume: ' || {volume_sql(p + 'event_count')} || '.', '^\\s+|\\s+$', '', 'g'), 1, 500)")


ALERTS_CTE = f"""alerts AS (
  SELECT
    'ALT-' || CAST(event_id + 100000 AS VARCHAR) AS alert_id,
    rule AS alert_name, rule AS rule_name, severity,
    ts AS alert_time,
    CASE user_id % 5 WHEN 0 THEN 'Firewall' WHEN 1 THEN 'WebServer' WHEN 2 THEN 'IDS/IPS' WHEN 3 THEN 'WAF' WHEN 4 THEN 'EDR' END AS log_source,
    CASE user_id % 10 WHEN 1 THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR) WHEN 2 THEN '172.16.10.50'
      WHEN 3 THEN '172.16.1.100' WHEN 4 THEN '192.168.1.50' WHEN 5 THEN '185.220.101.' || CAST(k AS VARCHAR)
      WHEN 6 THEN '198.51.100.' || CAST(k AS VARCHAR) WHEN 7 THEN '127.0.0.1' WHEN 8 THEN 'not-an-ip'
      WHEN 9 THEN '103.21.244.' || CAST(k AS VARCHAR) END AS src_ip,
    CASE event_id % 8 WHEN 0 THEN '10.0.0.10' WHEN 1 THEN '10.0.0.5' WHEN 2 THEN '10.0.0.2' WHEN 3 THEN '185.199.108.153'
      WHEN 4 THEN '198.51.100.' || CAST(k AS VARCHAR) WHEN 5 THEN '93.184.216.' || CAST(k AS VARCHAR)
      WHEN 6 THEN '172.16.10.50' END AS dest_ip,
    CASE event_id % 6 WHEN 0 THEN 'TCP' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'HTTPS' WHEN 3 THEN 'DNS' WHEN 4 THEN 'UDP' END AS protocol,
    CASE k % 6 WHEN 0 THEN [22, 23, 80, 443] WHEN 1 THEN [22] WHEN 2 THEN [443] WHEN 3 THEN [445, 3389]
      WHEN 4 THEN [8080, 5432, 53] WHEN 5 THEN []::INTEGER[] END::INTEGER[] AS destination_ports,
    CASE WHEN event_id % 50 <> 49 THEN CAST(floor(value) AS INTEGER) END AS event_count,
    CASE event_id % 4 WHEN 0 THEN '30s' WHEN 1 THEN '60s' WHEN 2 THEN '5m' WHEN 3 THEN '15m' END AS time_window,
    '[{{"user":"u' || CAST(k AS VARCHAR) || '","status":"failed"}},{{"bytes_transferred":' || CAST(CAST(k AS BIGINT) * 20000000 AS VARCHAR) || '}}'
      || CASE WHEN event_type = 'click' AND k % 4 = 0 THEN ',{{"method":"GET","url":"/item?id=' || CAST(k AS VARCHAR) || ' UNION SELECT username,password FROM users--","status":"403"}}'
              WHEN event_type = 'click' AND k % 4 = 1 THEN ',{{"method":"POST","url":"/search","payload":"<script>alert(' || CAST(k AS VARCHAR) || ')</script>","status":"200"}}'
              WHEN event_type = 'error' AND k % 3 = 0 THEN '{SCAN_LOGS}'
              ELSE '' END || ']' AS sample_logs,
    '{{"hostname":"host' || CAST(user_id AS VARCHAR) || '","criticality":"' || severity || '"}}' AS asset,
    CASE WHEN k % 5 <> 0 THEN '{{"abuseipdb":{{"abuseConfidenceScore":' || CAST(k AS VARCHAR) || ',"totalReports":' || CAST(k % 7 AS VARCHAR)
      || '}},"virustotal":{{"malicious":' || CAST(k % 20 AS VARCHAR) || '}}}}' END AS threat_intelligence,
    ts AS created_at,
    CASE WHEN event_id % 3 = 0 THEN CASE k % 3 WHEN 0 THEN 'True Positive' WHEN 1 THEN 'False Positive' WHEN 2 THEN 'Needs Review' END END AS llm_classification,
    CASE WHEN event_id % 3 = 0 THEN CAST(50 + k * 0.5 AS DECIMAL(5,2)) END AS llm_confidence,
    CAST(NULL AS VARCHAR) AS llm_reason,
    CAST(NULL AS VARCHAR) AS llm_recommendation,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 90 SECOND END AS analyzed_at,
    CASE WHEN event_id % 3 = 0 THEN 'Processed' WHEN event_id % 101 = 0 THEN 'Processing' ELSE 'Pending' END AS analysis_status,
    CASE WHEN event_id % 3 = 0 THEN CASE WHEN k % 10 = 0 THEN 'Failed' ELSE 'Succeeded' END END AS triage_status,
    {direction_sql("(CASE event_id % 8 WHEN 0 THEN '10.0.0.10' WHEN 1 THEN '10.0.0.5' WHEN 2 THEN '10.0.0.2' WHEN 3 THEN '185.199.108.153' WHEN 4 THEN '198.51.100.' || CAST(k AS VARCHAR) WHEN 5 THEN '93.184.216.' || CAST(k AS VARCHAR) WHEN 6 THEN '172.16.10.50' END)")} AS direction
  FROM (
    SELECT *,
      CASE k % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' END AS severity,
      CASE event_type WHEN 'error' THEN 'Port Scan' WHEN 'click' THEN 'SQLi' WHEN 'view' THEN 'Segmentation'
        WHEN 'purchase' THEN 'Exfiltration' WHEN 'signup' THEN 'Auth Limit' ELSE event_type END AS rule
    FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e0
  ) e1
)"""


def with_alerts(body: str, extra_ctes: str = "") -> str:
    ctes = ALERTS_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------------------
# Helpers for the statements below.

import json as _json  # noqa: E402

from ..constants import (FAILSAFE_RECOMMENDATION, IPV4_PRIVATE_NETWORKS as _PRIV,  # noqa: E402
                         NO_CONTEXT_MESSAGE, NO_USABLE_CONTEXT_MESSAGE, NOTIFY_FAILURE_REASON,
                         NOTIFY_ACTION_MAIL, NOTIFY_FAILURE_MAIL, NOTIFY_FAILURE_RECOMMENDATION,
                         UNTRUSTED_FOOTER, UNTRUSTED_HEADER)
from ..operators.ingest import IPV6_RE  # noqa: E402
from ..functions.ip import CIDR_RE  # noqa: E402
from ..sources.reference import DEFAULT_REFERENCE, SERVICE_PORTS  # noqa: E402

CLAIM_N = 25
NOW = "2024-02-01 00:00:00"


def sql_str(s: str) -> str:
    """Python text → DuckDB string expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def py_ts_sql(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN epoch_us({x}) % 1000000 = 0 "
            f"THEN strftime({x}, '%Y-%m-%d %H:%M:%S') ELSE strftime({x}, '%Y-%m-%d %H:%M:%S.%f') END)")


def ti_flat_sql(x: str) -> str:
    def i(*paths):
        return "COALESCE(" + ", ".join(f"TRY_CAST(json_extract_string({x}, '{p}') AS INTEGER)" for p in paths) + ", 0)"

    def b(path):
        return f"COALESCE(TRY_CAST(json_extract_string({x}, '{path}') AS BOOLEAN), false)"
    return (f"{i('$.abuseipdb.abuseConfidenceScore', '$.abuseipdb.score')} AS abuse_score, "
            f"{i('$.abuseipdb.totalReports')} AS abuse_reports, {b('$.abuseipdb.isTor')} AS is_tor, "
            f"{b('$.abuseipdb.isWhitelisted')} AS is_whitelisted, {i('$.virustotal.malicious')} AS vt_malicious, "
            f"{i('$.virustotal.suspicious')} AS vt_suspicious, "
            f"{i('$.alienvault.pulse_count', '$.otx.pulse_count')} AS pulse_count")


def window_seconds_sql(x: str) -> str:
    pat = "^\\s*([0-9]+)\\s*([smhd])\\s*$"
    return (f"(CASE WHEN regexp_matches({x}, '{pat}') THEN CAST(regexp_extract({x}, '{pat}', 1) AS BIGINT) * "
            f"CASE regexp_extract({x}, '{pat}', 2) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 "
            f"WHEN 'd' THEN 86400 END END)")


def _ref():
    docs = {}
    with open(DEFAULT_REFERENCE) as fh:
        for line in fh:
            if line.strip():
                r = _json.loads(line)
                docs[r["reference_type"]] = r["data"]
    return docs


def _q(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(_q(x) for x in v) + "]::VARCHAR[]" if all(isinstance(x, str) for x in v) \
            else "[" + ", ".join(_q(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def assets_cte() -> str:
    rows = [f"({_q(ip)}, {_q(a.get('name'))}, {_q(a.get('type'))}, {_q(a.get('criticality'))}, {_q(a.get('zone'))})"
            for ip, a in _ref()["network_info"]["assets"].items()]
    return "assets(ip, name, type, criticality, zone) AS (VALUES " + ", ".join(rows) + ")"


def approved_cte() -> str:
    rows = []
    for label, m in _ref()["network_info"]["approved_destinations"].items():
        for ip, e in m.items():
            rows.append(f"({_q(label)}, {_q(ip)}, {_q(e['approved'])}, "
                        f"{_q([str(p) for p in e['allowed_protocols']])}, {_q([str(p) for p in e['allowed_ports']])})")
    return ("approved(label, ip, approved, allowed_protocols, allowed_ports) AS (VALUES " + ", ".join(rows) + ")")


def _seg_rows():
    import re
    out = []
    for idx, r in enumerate(_ref()["network_info"]["segmentation"]):
        m = re.search(r"\(([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\)", r["src"])
        if m:
            lo, hi = net_bounds(m.group(1), 32)
        elif ".x" in r["src"]:
            n = r["src"].count(".x")
            lo, hi = net_bounds(r["src"].replace("x", "0"), 32 - 8 * n)
        else:
            lo, hi = net_bounds(r["src"], 32)
        ports = []
        for p in r["protocols"]:
            pm = re.search(r"\(([0-9]+)\)", p)
            if pm:
                ports.append(int(pm.group(1)))
            elif p.strip().upper() in SERVICE_PORTS:
                ports.append(SERVICE_PORTS[p.strip().upper()])
        em = re.search(r"\(([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\)", r.get("exception") or "")
        out.append((idx, r["dst"], lo, hi, ports, r["allowed"], em.group(1) if em else None))
    return out


def seg_cte() -> str:
    rows = [f"({i}, {_q(d)}, {lo}, {hi}, {_q(p)}::INTEGER[], {_q(a)}, {_q(e)})" for i, d, lo, hi, p, a, e in _seg_rows()]
    return "seg(rule_idx, dst, src_lo, src_hi, ports, allowed, exception_ip) AS (VALUES " + ", ".join(rows) + ")"


def playbooks_cte() -> str:
    rows = [f"({_q(n)}, {_q(p['severity'])}, {len(p['actions'])})" for n, p in _ref()["playbooks"].items()]
    return "playbooks(playbook, playbook_severity, n_actions) AS (VALUES " + ", ".join(rows) + ")"


def src_num_sql(col: str) -> str:
    return _num(col)


_CLAIMED = (f"claimed AS (SELECT * FROM alerts WHERE analysis_status = 'Pending' "
            f"ORDER BY alert_time, alert_id LIMIT {CLAIM_N})")
_PENDING = "claimed AS (SELECT * FROM alerts WHERE analysis_status = 'Pending')"
_SNAP = """abuse AS (
  SELECT src_ip AS ip,
    max(TRY_CAST(json_extract_string(threat_intelligence, '$.abuseipdb.abuseConfidenceScore') AS INTEGER)) AS score,
    max(TRY_CAST(json_extract_string(threat_intelligence, '$.abuseipdb.totalReports') AS INTEGER)) AS reports,
    bool_or(TRY_CAST(json_extract_string(threat_intelligence, '$.abuseipdb.isTor') AS BOOLEAN)) AS is_tor,
    bool_or(TRY_CAST(json_extract_string(threat_intelligence, '$.abuseipdb.isWhitelisted') AS BOOLEAN)) AS is_wl
  FROM alerts WHERE threat_intelligence IS NOT NULL AND src_ip IS NOT NULL GROUP BY src_ip),
vt AS (
  SELECT src_ip AS ip,
    max(TRY_CAST(json_extract_string(threat_intelligence, '$.virustotal.malicious') AS INTEGER)) AS malicious,
    max(TRY_CAST(json_extract_string(threat_intelligence, '$.virustotal.suspicious') AS INTEGER)) AS suspicious
  FROM alerts WHERE threat_intelligence IS NOT NULL AND src_ip IS NOT NULL
    AND json_extract(threat_intelligence, '$.virustotal') IS NOT NULL GROUP BY src_ip)"""
_MERGED_FLAT = ("COALESCE(ab.score, 0) AS abuse_score, COALESCE(ab.reports, 0) AS abuse_reports, "
                "COALESCE(ab.is_tor, false) AS is_tor, COALESCE(ab.is_wl, false) AS is_whitelisted, "
                "COALESCE(v.malicious, 0) AS vt_malicious, COALESCE(v.suspicious, 0) AS vt_suspicious, "
                "0 AS pulse_count")


def _knn_sql(k: int, body_cols: str = "query_id, id, round(distance, 6) AS distance, rank") -> str:
    return f"""WITH pairs AS (
  SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS id,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) ^ 2)) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
SELECT {body_cols} FROM ranked WHERE rank <= {k}"""


_FS_REASON = sql_str("Automated triage failed due to a system error: no verdict returned. "
                     "Manual analyst review is required.")

ORACLE: dict[str, str] = {}

ORACLE["s1_alert_bulk_load"] = with_alerts("SELECT * FROM alerts")

_INGEST_REASONS = (f"list_filter([CASE WHEN event_count IS NULL THEN 'event_count is required' END, "
                   f"CASE WHEN src_ip IS NOT NULL AND NOT (regexp_matches(src_ip, '{CIDR_RE}') OR "
                   f"regexp_matches(src_ip, '{IPV6_RE}')) THEN 'src_ip is not a valid address' END, "
                   f"CASE WHEN dest_ip IS NOT NULL AND NOT (regexp_matches(dest_ip, '{CIDR_RE}') OR "
                   f"regexp_matches(dest_ip, '{IPV6_RE}')) THEN 'dest_ip is not a valid address' END], "
                   f"lambda x: x IS NOT NULL)")
ORACLE["s2_validated_ingest"] = with_alerts(
    f"SELECT alert_id, CASE WHEN len(r) = 0 THEN alert_time END AS alert_time, src_ip, "
    f"CASE WHEN len(r) = 0 THEN destination_ports END AS destination_ports, "
    f"CASE WHEN len(r) = 0 THEN event_count END AS event_count, "
    f"CASE WHEN len(r) = 0 THEN 'Pending' END AS analysis_status, CASE WHEN len(r) > 0 THEN r END AS reasons "
    f"FROM (SELECT *, {_INGEST_REASONS} AS r FROM alerts) x")
ORACLE["s3_constraint_check"] = with_alerts(
    f"SELECT reason, count(*) AS n FROM (SELECT unnest({_INGEST_REASONS}) AS reason FROM alerts) x GROUP BY reason")
ORACLE["s4_reference_load"] = with_alerts(
    "SELECT s.name, s.criticality, count(*) AS n FROM alerts a JOIN assets s ON a.dest_ip = s.ip "
    "GROUP BY s.name, s.criticality", assets_cte())

_KB = ("kb AS (SELECT 'pattern_' || CAST(q.conv_id AS VARCHAR) || '_' || CAST(q.turn AS VARCHAR) AS id, "
       "q.text AS key, a.text AS value FROM conversations q LEFT JOIN conversations a "
       "ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')")
ORACLE["s5_kb_bulk_load"] = f"WITH {_KB} SELECT id, key, value FROM kb"
ORACLE["s7_kb_full_scan"] = f"WITH {_KB} SELECT id, key, value FROM kb"
ORACLE["g4_kb_count"] = f"WITH {_KB} SELECT count(*) AS kb_count FROM kb"
ORACLE["s6_kb_validate"] = (
    f"WITH {_KB} SELECT {strip_sql('id')} AS id, CAST(length({strip_sql('key')}) AS BIGINT) AS key_len, "
    f"CAST(length({strip_sql('value')}) AS BIGINT) AS value_len, "
    f"NOT (id IS NULL OR {strip_sql('id')} = '' OR key IS NULL OR {strip_sql('key')} = '' OR value IS NULL) AS valid "
    f"FROM kb")

ORACLE["p1_status_filter"] = with_alerts(
    "SELECT alert_id, alert_time, rule_name FROM alerts WHERE analysis_status = 'Pending'")
ORACLE["o1_fifo_claim"] = with_alerts(
    f"SELECT alert_id, alert_name, rule_name, severity, {py_ts_sql('alert_time')} AS alert_time, log_source, "
    f"NULLIF(src_ip, '') AS src_ip, NULLIF(dest_ip, '') AS dest_ip, protocol, destination_ports, event_count, "
    f"time_window, sample_logs, asset, threat_intelligence, llm_classification, llm_confidence, llm_reason, "
    f"llm_recommendation, {py_ts_sql('analyzed_at')} AS analyzed_at, 'Processing' AS analysis_status "
    f"FROM claimed", _CLAIMED)
ORACLE["p3_ti_projection"] = with_alerts(
    f"SELECT alert_id, rule_name, severity, {py_ts_sql('alert_time')} AS alert_time, log_source, "
    f"NULLIF(src_ip, '') AS src_ip, NULLIF(dest_ip, '') AS dest_ip, protocol, destination_ports, event_count, "
    f"time_window, sample_logs, asset, threat_intelligence FROM claimed", _PENDING)
ORACLE["p5_retrieval_input"] = with_alerts(
    "SELECT alert_id, rule_name, src_ip, dest_ip, protocol, destination_ports, event_count, time_window FROM alerts")
ORACLE["p7_ti_flatten"] = with_alerts(f"SELECT alert_id, {ti_flat_sql('threat_intelligence')} FROM alerts")


def _words_sql(x):
    t = strip_sql(x)
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '\\s+')) END)"


ORACLE["p11_verdict_checks"] = with_alerts(
    "SELECT alert_id, list_filter(["
    "CASE WHEN NOT COALESCE(llm_classification IN ('True Positive', 'False Positive', 'Needs Review'), false) "
    "THEN 'classification' END, "
    "CASE WHEN NOT COALESCE(CAST(llm_confidence AS DOUBLE) BETWEEN 0 AND 100, false) THEN 'confidence_range' END, "
    f"CASE WHEN COALESCE({_words_sql('llm_reason')} > 80, false) THEN 'reason_words' END, "
    f"CASE WHEN COALESCE({_words_sql('llm_recommendation')} > 30, false) THEN 'recommendation_words' END, "
    "CASE WHEN NOT COALESCE(triage_status IN ('Succeeded', 'Failed'), false) THEN 'triage_status' END], "
    "lambda x: x IS NOT NULL) AS violations FROM alerts WHERE llm_classification IS NOT NULL")

_STORED = ("stored AS (SELECT alert_id, llm_classification, CAST(llm_confidence AS DOUBLE) AS llm_confidence, "
           "CASE WHEN triage_status = 'Failed' THEN 'failsafe_executed' ELSE 'success' END AS request_status, "
           "CASE WHEN triage_status = 'Failed' THEN 'System error: scoring unavailable' "
           "ELSE 'Stored verdict for ' || rule_name END AS analysis_reason, "
           "CASE WHEN triage_status = 'Failed' THEN 'Escalate to Tier-2 for manual triage.' "
           "ELSE 'Review the alert.' END AS llm_recommendation FROM alerts WHERE analysis_status = 'Processed'), "
           "routed AS (SELECT *, CASE WHEN request_status = 'success' AND llm_classification IN "
           "('True Positive', 'Needs Review') THEN 'action_mail' WHEN request_status = 'success' THEN 'none' "
           "ELSE 'failure_mail' END AS route FROM stored)")
ORACLE["p12_notification_route"] = with_alerts("SELECT alert_id, route FROM routed", _STORED)
_sys = "starts_with(analysis_reason, 'System error')"
_reason = f"COALESCE(CASE WHEN {_sys} AND route = 'failure_mail' THEN {sql_str(NOTIFY_FAILURE_REASON)} ELSE analysis_reason END, '')"
_advice = f"COALESCE(CASE WHEN {_sys} AND route = 'failure_mail' THEN {sql_str(NOTIFY_FAILURE_RECOMMENDATION)} ELSE llm_recommendation END, '')"


def _mail(text: str) -> str:
    """A mail text with its placeholders as a SQL concatenation."""
    values = {"alert_id": "alert_id", "classification": "llm_classification", "confidence": "CAST(llm_confidence AS VARCHAR)",
              "reason": _reason, "recommendation": _advice}
    return " || ".join(values[p[1:-1]] if p[:1] == "{" else sql_str(p) for p in re.split(r"(\{\w+\})", text) if p)


ORACLE["f9_notification"] = with_alerts(
    "SELECT alert_id, route, llm_classification || ' Alert - ' || alert_id AS subject, "
    f"CASE WHEN route = 'failure_mail' THEN {_mail(NOTIFY_FAILURE_MAIL)} ELSE {_mail(NOTIFY_ACTION_MAIL)} END AS body "
    "FROM routed WHERE route <> 'none'", _STORED)

ORACLE["f1_classify_ip"] = with_alerts(
    f"SELECT alert_id, {classify_sql('src_ip', 'source')} AS source_type, "
    f"{classify_sql('dest_ip', 'destination')} AS destination_type FROM alerts")
ORACLE["f2_direction"] = with_alerts(f"SELECT alert_id, dest_ip, {direction_sql('dest_ip')} AS direction FROM alerts")
ORACLE["f3_port_services"] = with_alerts(f"SELECT alert_id, {services_sql('destination_ports')} AS services FROM alerts")
ORACLE["f4_event_volume"] = with_alerts(f"SELECT alert_id, {volume_sql('event_count')} AS event_volume FROM alerts")
ORACLE["f5_build_query"] = with_alerts(f"SELECT alert_id, {query_text_sql()} AS query_text FROM alerts")
ORACLE["f10_failsafe_reason"] = with_alerts(
    f"SELECT alert_id, {_FS_REASON} AS llm_reason, 'System error: no verdict returned' AS analysis_reason "
    f"FROM claimed", _PENDING)
ORACLE["f11_window_seconds"] = with_alerts(
    f"SELECT alert_id, {window_seconds_sql('time_window')} AS window_seconds FROM alerts")
ORACLE["f13_confidence_band"] = with_alerts(
    "SELECT alert_id, CASE WHEN llm_confidence >= 85 THEN 'strong' WHEN llm_confidence >= 65 THEN 'supported' "
    "WHEN llm_confidence >= 50 THEN 'ambiguous' ELSE 'weak' END AS band FROM alerts WHERE llm_confidence IS NOT NULL")

ORACLE["j7_similarity"] = _knn_sql(3)
ORACLE["o2_topk_clamped"] = _knn_sql(10)
ORACLE["g6_best_match"] = _knn_sql(1, "query_id, id, round(distance, 6) AS distance")
ORACLE["f15_squared_l2"] = _knn_sql(1, "query_id, id, round(distance, 6) AS distance")
_EVID = (sql_str("Historical record:\nID: ") + " || id || " + sql_str("\nPattern: doc ") + " || id || "
         + sql_str("\nSimilarity distance: ") + " || printf('%.6f', round(distance, 6)) || "
         + sql_str("\nHistorical knowledge:\n") + f" || substring({strip_sql('d.text')}, 1, 3000)")
ORACLE["f7_context_block"] = _knn_sql(1, "query_id, id, distance").replace(
    "\nSELECT query_id, id, distance FROM ranked WHERE rank <= 1",
    f""",
h AS (SELECT query_id, id, distance FROM ranked WHERE rank <= 1),
ev AS (SELECT h.query_id, CASE WHEN d.text IS NOT NULL AND {strip_sql('d.text')} <> '' THEN {_EVID} END AS rec
  FROM h LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = h.id)
SELECT CAST(e.vec_id AS VARCHAR) AS query_id, COALESCE(ev.rec IS NOT NULL, false) AS has_context,
  CASE WHEN ev.query_id IS NULL THEN {sql_str(NO_CONTEXT_MESSAGE)}
       WHEN ev.rec IS NULL THEN {sql_str(NO_USABLE_CONTEXT_MESSAGE)}
       ELSE {sql_str(UNTRUSTED_HEADER)} || ev.rec || {sql_str(UNTRUSTED_FOOTER)} END AS context_block
FROM embeddings e LEFT JOIN ev ON ev.query_id = CAST(e.vec_id AS VARCHAR) WHERE e.embedding IS NOT NULL""")

ORACLE["j1_ti_merge"] = with_alerts(
    f"SELECT a.alert_id, {_MERGED_FLAT} FROM alerts a LEFT JOIN abuse ab ON a.src_ip = ab.ip "
    f"LEFT JOIN vt v ON a.src_ip = v.ip", _SNAP)
ORACLE["j3_primary_key_guard"] = with_alerts(
    "SELECT alert_id, alert_time, rule_name, src_ip FROM ("
    "SELECT 'ALT-' || CAST(CAST(floor((CAST(regexp_extract(alert_id, '([0-9]+)$', 1) AS BIGINT) - 100000) / 2) AS BIGINT) "
    "* 2 + 100000 AS VARCHAR) AS alert_id, alert_time, rule_name, src_ip, "
    "row_number() OVER (PARTITION BY 'ALT-' || CAST(CAST(floor((CAST(regexp_extract(alert_id, '([0-9]+)$', 1) AS BIGINT) "
    "- 100000) / 2) AS BIGINT) * 2 + 100000 AS VARCHAR) ORDER BY alert_time, rule_name NULLS FIRST, src_ip NULLS FIRST) AS rn "
    "FROM alerts) x WHERE rn = 1 AND alert_id NOT IN (SELECT alert_id FROM alerts WHERE analysis_status = 'Processed')")
ORACLE["j4_ti_update"] = with_alerts(
    "SELECT a.alert_id, a.analysis_status, CASE WHEN a.analysis_status = 'Processing' THEN COALESCE(ab.score, 0) ELSE "
    "COALESCE(TRY_CAST(json_extract_string(a.threat_intelligence, '$.abuseipdb.abuseConfidenceScore') AS INTEGER), "
    "TRY_CAST(json_extract_string(a.threat_intelligence, '$.abuseipdb.score') AS INTEGER), 0) END AS abuse_score, "
    "CASE WHEN a.analysis_status = 'Processing' THEN COALESCE(v.malicious, 0) ELSE "
    "COALESCE(TRY_CAST(json_extract_string(a.threat_intelligence, '$.virustotal.malicious') AS INTEGER), 0) END AS vt_malicious "
    "FROM alerts a LEFT JOIN abuse ab ON a.src_ip = ab.ip LEFT JOIN vt v ON a.src_ip = v.ip", _SNAP)
ORACLE["j5_verdict_apply"] = with_alerts(
    "SELECT a.alert_id, CASE WHEN c.alert_id IS NOT NULL THEN 'Processed' ELSE a.analysis_status END AS analysis_status, "
    "CASE WHEN c.alert_id IS NOT NULL THEN 'Needs Review' ELSE a.llm_classification END AS llm_classification, "
    "CASE WHEN c.alert_id IS NOT NULL THEN CAST(0 AS DECIMAL(5,2)) ELSE a.llm_confidence END AS llm_confidence, "
    "CASE WHEN c.alert_id IS NOT NULL THEN 'Failed' ELSE a.triage_status END AS triage_status, "
    f"CASE WHEN c.alert_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE a.analyzed_at END AS analyzed_at "
    "FROM alerts a LEFT JOIN claimed c ON a.alert_id = c.alert_id", _PENDING)
ORACLE["g5_state_fold"] = with_alerts(
    "SELECT a.alert_id, CASE WHEN c.alert_id IS NOT NULL THEN 'Processed' ELSE a.analysis_status END AS analysis_status, "
    "CASE WHEN c.alert_id IS NOT NULL THEN 'Needs Review' ELSE a.llm_classification END AS llm_classification, "
    "CASE WHEN c.alert_id IS NOT NULL THEN CAST(0 AS DECIMAL(5,2)) ELSE a.llm_confidence END AS llm_confidence, "
    "CASE WHEN c.alert_id IS NOT NULL THEN 'Failed' ELSE a.triage_status END AS triage_status, "
    "CASE WHEN c.alert_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:02' ELSE a.analyzed_at END AS analyzed_at, "
    "CASE WHEN c.alert_id IS NOT NULL THEN COALESCE(ab.score, 0) ELSE "
    "COALESCE(TRY_CAST(json_extract_string(a.threat_intelligence, '$.abuseipdb.abuseConfidenceScore') AS INTEGER), "
    "TRY_CAST(json_extract_string(a.threat_intelligence, '$.abuseipdb.score') AS INTEGER), 0) END AS abuse_score "
    "FROM alerts a LEFT JOIN claimed c ON a.alert_id = c.alert_id LEFT JOIN abuse ab ON a.src_ip = ab.ip",
    _PENDING + "," + _SNAP)
ORACLE["j8_asset_lookup"] = with_alerts(
    "SELECT a.alert_id, d.name AS dest_asset_name, d.type AS dest_asset_type, d.criticality AS dest_asset_criticality, "
    "d.zone AS dest_asset_zone, s.name AS src_asset_name FROM alerts a LEFT JOIN assets d ON a.dest_ip = d.ip "
    "LEFT JOIN assets s ON a.src_ip = s.ip", assets_cte())


def _approved_cond(e):
    ports_txt = "list_transform(COALESCE(a.destination_ports, []::INTEGER[]), lambda p: CAST(p AS VARCHAR))"
    return (f"(COALESCE({e}.approved, false) AND COALESCE(list_contains({e}.allowed_protocols, a.protocol), false) "
            f"AND (list_contains({e}.allowed_ports, 'ANY') OR "
            f"len(list_filter({ports_txt}, lambda p: NOT list_contains({e}.allowed_ports, p))) = 0))")


ORACLE["j9_approved_match"] = with_alerts(
    f"SELECT alert_id, CASE WHEN {_approved_cond('d')} THEN d.label ELSE s.label END AS approved_label FROM alerts a "
    f"LEFT JOIN approved d ON a.dest_ip = d.ip LEFT JOIN approved s ON a.src_ip = s.ip "
    f"WHERE COALESCE({_approved_cond('d')}, false) OR COALESCE({_approved_cond('s')}, false)", approved_cte())
_nets = ", ".join(f"('{a}/{p}', {net_bounds(a, p)[0]}, {net_bounds(a, p)[1]})" for a, p in _PRIV)
ORACLE["j10_cidr_containment"] = with_alerts(
    f"SELECT a.alert_id, n.network FROM alerts a JOIN nets n ON {_num('a.src_ip')} BETWEEN n.lo AND n.hi",
    f"nets(network, lo, hi) AS (VALUES {_nets})")
# Both families as ranges of numbers: IPv4 whole, IPv6 by its first 48 bits.
_hex6 = "'2002:' || printf('%x', {v} // 65536) || ':' || printf('%x', {v} % 65536) || '::/'"
_dots = "concat_ws('.', {v} // 16777216, {v} // 65536 % 256, {v} // 256 % 256, {v} % 256)"
_cut_nets = " UNION ".join(
    [f"SELECT {_dots.format(v='c')} || '/{p}' AS network, 4 AS family, c AS lo, c + {2 ** (32 - p) - 1} AS hi "
     f"FROM (SELECT n // {2 ** (32 - p)} * {2 ** (32 - p)} AS c FROM items WHERE n IS NOT NULL)" for p in (8, 16, 20)]
    + [f"SELECT {_hex6.format(v='c')} || '{16 + p}', 6, {0x2002 << 32} + c, {0x2002 << 32} + c + {2 ** (32 - p) - 1} "
       f"FROM (SELECT n // {2 ** (32 - p)} * {2 ** (32 - p)} AS c FROM items WHERE n IS NOT NULL)" for p in (8, 16)])
ORACLE["j10_networks_in_networks"] = with_alerts(
    "SELECT r.alert_id, r.item, n.network FROM ranges r JOIN cut_nets n "
    "ON r.family = n.family AND r.lo >= n.lo AND r.hi <= n.hi",
    f"items AS (SELECT alert_id, src_ip, {_num('src_ip')} AS n, CAST(regexp_extract(alert_id, '([0-9]+)$', 1) AS BIGINT) AS e FROM alerts), "
    f"ranges AS (SELECT alert_id, src_ip AS item, 4 AS family, n AS lo, n AS hi FROM items WHERE n IS NOT NULL AND e % 3 = 0 "
    "UNION ALL SELECT alert_id, src_ip || '/' || (8 + e % 25), 4, n // (1 << (24 - e % 25)) * (1 << (24 - e % 25)), "
    "(n // (1 << (24 - e % 25)) + 1) * (1 << (24 - e % 25)) - 1 FROM items WHERE n IS NOT NULL AND e % 3 = 1 "
    f"UNION ALL SELECT alert_id, {_hex6.format(v='n')} || (16 + e % 33), 6, {0x2002 << 32} + n // (1::BIGINT << (32 - e % 33)) * (1::BIGINT << (32 - e % 33)), "
    f"{0x2002 << 32} + (n // (1::BIGINT << (32 - e % 33)) + 1) * (1::BIGINT << (32 - e % 33)) - 1 FROM items WHERE n IS NOT NULL AND e % 3 = 2), "
    f"cut_nets AS ({_cut_nets})")
ORACLE["j11_segmentation"] = with_alerts(
    f"SELECT alert_id, seg_rule, seg_status FROM (SELECT a.alert_id, s.rule_idx AS seg_rule, "
    f"CASE WHEN a.src_ip = s.exception_ip THEN 'exception' WHEN s.allowed THEN 'allowed' ELSE 'violation' END AS seg_status, "
    f"row_number() OVER (PARTITION BY a.alert_id ORDER BY s.rule_idx) AS rn "
    f"FROM alerts a JOIN seg s ON a.dest_ip = s.dst AND {_num('a.src_ip')} BETWEEN s.src_lo AND s.src_hi "
    f"AND len(list_intersect(COALESCE(a.destination_ports, []::INTEGER[]), s.ports)) > 0) x WHERE rn = 1", seg_cte())

ORACLE["g2_queue_counts"] = with_alerts(
    "SELECT count(*) FILTER (WHERE analysis_status = 'Processing') AS in_flight, "
    "count(*) FILTER (WHERE analysis_status = 'Pending') AS pending FROM alerts")
ORACLE["g3_queue_gate"] = with_alerts(
    "SELECT in_flight, pending, CASE WHEN in_flight > 0 THEN 'skip' WHEN pending > 0 THEN 'trigger' ELSE 'idle' END "
    "AS decision FROM (SELECT count(*) FILTER (WHERE analysis_status = 'Processing') AS in_flight, "
    "count(*) FILTER (WHERE analysis_status = 'Pending') AS pending FROM alerts) x")
ORACLE["o4_startup_recovery"] = with_alerts(
    "SELECT CASE WHEN analysis_status = 'Processing' THEN 'Pending' ELSE analysis_status END AS analysis_status, "
    "count(*) AS n FROM alerts GROUP BY 1")
ORACLE["g7_status_board"] = with_alerts(
    "SELECT analysis_status, triage_status, count(*) AS n FROM alerts GROUP BY 1, 2")
ORACLE["g8_detected_threats"] = with_alerts(
    "SELECT llm_classification, severity, direction, count(*) AS n, round(avg(CAST(llm_confidence AS DOUBLE)), 6) "
    "AS avg_confidence FROM alerts WHERE analysis_status = 'Processed' GROUP BY 1, 2, 3")
ORACLE["g9_threat_patterns"] = with_alerts(
    "SELECT rule_name, src_ip, date_trunc('hour', alert_time) AS hour, count(*) AS n, "
    "count(DISTINCT dest_ip) AS distinct_destinations FROM alerts GROUP BY 1, 2, 3")
_lat = "((epoch_us(analyzed_at) - epoch_us(alert_time)) / 1e6)"
ORACLE["g10_triage_latency"] = with_alerts(
    f"SELECT rule_name, count(*) AS n, round(avg({_lat}), 6) AS avg_seconds, round(min({_lat}), 6) AS min_seconds, "
    f"round(max({_lat}), 6) AS max_seconds FROM alerts WHERE analyzed_at IS NOT NULL GROUP BY 1")
ORACLE["g11_verdict_quality"] = with_alerts(
    "SELECT rule_name, tp, fp, tn, fn, needs_review, "
    "CASE WHEN tp + fp + tn + fn > 0 THEN round((tp + tn) / (tp + fp + tn + fn), 6) END AS accuracy, "
    "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, "
    "CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM ("
    "SELECT rule_name, "
    "count(*) FILTER (WHERE llm_classification = 'True Positive' AND e = 'True Positive') AS tp, "
    "count(*) FILTER (WHERE llm_classification = 'True Positive' AND e = 'False Positive') AS fp, "
    "count(*) FILTER (WHERE llm_classification = 'False Positive' AND e = 'False Positive') AS tn, "
    "count(*) FILTER (WHERE llm_classification = 'False Positive' AND e = 'True Positive') AS fn, "
    "count(*) FILTER (WHERE llm_classification = 'Needs Review') AS needs_review FROM ("
    "SELECT *, CASE WHEN severity IN ('High', 'Critical') THEN 'True Positive' ELSE 'False Positive' END AS e "
    "FROM alerts WHERE llm_classification IS NOT NULL) y GROUP BY rule_name) x")

_LOGS = "list_transform(json_extract(sample_logs, '$[*]'), lambda x: x)"


def _logtxt(x):
    return (f"concat_ws(' ', json_extract_string({x}, '$.url'), json_extract_string({x}, '$.payload'), "
            f"json_extract_string({x}, '$.query'), json_extract_string({x}, '$.command'))")


SQLI_RE2 = "(?i)(union\\s+select|or\\s+1\\s*=\\s*1|information_schema|--|/\\*)"
LOG_MEASURES = (
    "COALESCE(list_sum(list_transform(logs, lambda x: COALESCE(TRY_CAST(json_extract_string(x, '$.bytes_transferred') AS BIGINT), "
    "TRY_CAST(json_extract_string(x, '$.bytes') AS BIGINT), 0))), 0) AS total_bytes, "
    "CAST(len(list_filter(logs, lambda x: lower(json_extract_string(x, '$.status')) = 'failed')) AS INTEGER) AS failed_log_count, "
    "list_sort(list_distinct(list_filter(list_transform(logs, lambda x: TRY_CAST(json_extract_string(x, '$.port') AS INTEGER)), "
    "lambda p: p IS NOT NULL))) AS log_ports, "
    "CAST(len(list_filter(logs, lambda x: upper(json_extract_string(x, '$.action')) IN ('DENY', 'BLOCKED', 'BLOCK'))) AS INTEGER) AS deny_count, "
    f"CAST(len(list_filter(logs, lambda x: regexp_matches({_logtxt('x')}, '{SQLI_RE2}'))) AS INTEGER) AS sqli_hits, "
    f"CAST(len(list_filter(logs, lambda x: regexp_matches({_logtxt('x')}, '(?i)<script'))) AS INTEGER) AS xss_hits")
ORACLE["g12_log_measures"] = with_alerts(
    f"SELECT alert_id, {LOG_MEASURES} FROM (SELECT *, COALESCE(json_extract(sample_logs, '$[*]'), []::JSON[]) AS logs FROM alerts) x")
ORACLE["o3_recent_alerts"] = with_alerts(
    "SELECT alert_id, alert_time, rule_name, severity, analysis_status FROM alerts "
    "ORDER BY alert_time DESC, alert_id DESC LIMIT 20")


# --------------------------------------------------------------------------- F17 feature row

def _ti_int(x, *paths):
    return "COALESCE(" + ", ".join(f"TRY_CAST(json_extract_string({x}, '{p}') AS INTEGER)" for p in paths) + ", 0)"


_SEGX = (f"segx AS (SELECT alert_id, seg_rule, seg_status FROM (SELECT a.alert_id, s.rule_idx AS seg_rule, "
         f"CASE WHEN a.src_ip = s.exception_ip THEN 'exception' WHEN s.allowed THEN 'allowed' ELSE 'violation' END "
         f"AS seg_status, row_number() OVER (PARTITION BY a.alert_id ORDER BY s.rule_idx) AS rn "
         f"FROM alerts a JOIN seg s ON a.dest_ip = s.dst AND {_num('a.src_ip')} BETWEEN s.src_lo AND s.src_hi "
         f"AND len(list_intersect(COALESCE(a.destination_ports, []::INTEGER[]), s.ports)) > 0) x WHERE rn = 1)")
_FEAT0 = (
    "feat0 AS (SELECT a.alert_id, a.protocol, a.event_count, a.destination_ports, "
    f"{classify_sql('a.src_ip', 'source')} AS source_type, {classify_sql('a.dest_ip', 'destination')} AS destination_type, "
    f"{window_seconds_sql('a.time_window')} AS wsec, "
    f"{_ti_int('a.threat_intelligence', '$.abuseipdb.abuseConfidenceScore', '$.abuseipdb.score')} AS abuse_score, "
    f"{_ti_int('a.threat_intelligence', '$.virustotal.malicious')} AS vt_malicious, "
    f"COALESCE({_approved_cond('d')}, false) OR COALESCE({_approved_cond('s')}, false) AS approved_endpoint, "
    "sx.seg_status, sx.seg_rule, "
    f"{LOG_MEASURES} "
    "FROM (SELECT *, COALESCE(json_extract(sample_logs, '$[*]'), []::JSON[]) AS logs FROM alerts) a "
    "LEFT JOIN approved d ON a.dest_ip = d.ip LEFT JOIN approved s ON a.src_ip = s.ip "
    "LEFT JOIN segx sx ON sx.alert_id = a.alert_id)")
_PORTS = "COALESCE(destination_ports, []::INTEGER[])"
_FEAT = (
    "feat AS (SELECT *, list_filter(["
    "CASE WHEN source_type = 'External source' AND failed_logins > 20 AND COALESCE(wsec <= 60, false) "
    f"AND len(list_intersect({_PORTS}, [22, 3389])) > 0 THEN 'brute_force' END, "
    "CASE WHEN sqli_hits > 0 THEN 'sqli' END, CASE WHEN xss_hits > 0 THEN 'xss' END, "
    "CASE WHEN total_bytes > 1000000000 AND COALESCE(protocol = 'HTTPS', false) AND NOT approved_endpoint "
    "THEN 'data_exfiltration' END, "
    "CASE WHEN probed_ports > 10 AND COALESCE(wsec <= 30, false) THEN 'port_scan' END], lambda x: x IS NOT NULL) "
    "AS matched_playbooks FROM (SELECT *, "
    "CASE WHEN failed_log_count > 0 THEN COALESCE(event_count, 0) ELSE 0 END AS failed_logins, "
    f"len(list_distinct(list_concat(list_filter({_PORTS}, lambda p: p IS NOT NULL), log_ports))) AS probed_ports "
    "FROM feat0) y)")
_VERD = (
    "verd AS (SELECT alert_id, "
    "CASE WHEN approved_endpoint AND abuse_score < 50 AND vt_malicious < 3 THEN 'False Positive' "
    "WHEN seg_status IN ('exception', 'allowed') THEN 'False Positive' "
    "WHEN seg_status = 'violation' OR len(matched_playbooks) > 0 THEN 'True Positive' "
    "WHEN abuse_score >= 50 OR vt_malicious >= 3 THEN 'True Positive' ELSE 'Needs Review' END AS llm_classification, "
    "CASE WHEN approved_endpoint AND abuse_score < 50 AND vt_malicious < 3 THEN 90.0 "
    "WHEN seg_status IN ('exception', 'allowed') THEN 85.0 "
    "WHEN seg_status = 'violation' OR len(matched_playbooks) > 0 THEN "
    "CASE WHEN abuse_score >= 50 OR vt_malicious >= 3 THEN 95.0 ELSE 85.0 END "
    "WHEN abuse_score >= 50 OR vt_malicious >= 3 THEN 75.0 ELSE 55.0 END AS llm_confidence FROM feat)")
_FEAT_CTES = ",".join([assets_cte(), approved_cte(), seg_cte(), playbooks_cte(), _SEGX, _FEAT0, _FEAT, _VERD])

ORACLE["j12_playbook_match"] = with_alerts(
    "SELECT m.alert_id, m.playbook, p.playbook_severity, CAST(p.n_actions AS BIGINT) AS n_actions FROM "
    "(SELECT alert_id, unnest(matched_playbooks) AS playbook FROM feat) m JOIN playbooks p ON m.playbook = p.playbook",
    _FEAT_CTES)
ORACLE["f18_rule_verdict"] = with_alerts(
    "SELECT llm_classification, CAST(llm_confidence AS DOUBLE) AS llm_confidence, count(*) AS n FROM verd "
    "GROUP BY 1, 2", _FEAT_CTES)
ORACLE["j6_failsafe"] = with_alerts(
    "SELECT c.alert_id, v.llm_classification, "
    "CASE WHEN v.llm_classification = 'Needs Review' THEN 'Failed' ELSE 'Succeeded' END AS triage_status, "
    "CASE WHEN v.llm_classification = 'Needs Review' THEN 'failsafe_executed' ELSE 'success' END AS request_status "
    "FROM claimed c JOIN verd v ON c.alert_id = v.alert_id", _PENDING + "," + _FEAT_CTES)

ORACLE["s8_kb_point_lookup"] = (f"WITH {_KB} SELECT id, key, COALESCE(value, '') AS value FROM kb "
                                "WHERE id = 'pattern_1_0'")

# --------------------------------------------------------------------------- P8–P10, F12, T5

ORACLE["p8_unwrap_payload"] = with_alerts(
    "SELECT alert_id, CASE WHEN severity = 'High' THEN upper(rule_name) ELSE rule_name END AS rule_name, severity, protocol, event_count FROM alerts")
ORACLE["p9_retrieval_context"] = with_alerts(
    "SELECT alert_id, CASE WHEN analysis_status <> 'Pending' THEN COALESCE(protocol = 'TCP', false) ELSE COALESCE(severity = 'High', false) END AS has_context, "
    "CASE WHEN analysis_status <> 'Pending' AND severity <> 'Low' THEN rule_name ELSE log_source END AS context_block FROM alerts")
ORACLE["p10_missing_id"] = with_alerts(
    "SELECT severity, severity IS NULL OR severity IN ('Low', 'Critical') AS rejected, count(*) AS n, "
    "count(CASE WHEN severity <> 'Critical' THEN alert_id END) AS ids FROM alerts GROUP BY 1, 2")
ORACLE["f12_threshold"] = with_alerts(
    "SELECT alert_id, CASE WHEN event_count IS NOT NULL THEN ['>', '>=', '<', '<=', '=', '='][CAST(event_count % 6 AS INTEGER) + 1] END AS op, "
    "CASE WHEN event_count % 6 <> 5 THEN CAST(event_count AS DOUBLE) * CASE WHEN event_count % 4 = 0 THEN 1e9 ELSE 1 END END AS bound FROM alerts")
ORACLE["t5_threshold_windows"] = with_alerts(
    f"SELECT w AS window_start, src_ip, count(DISTINCT alert_id) AS alerts, "
    "CAST(sum(CASE WHEN i = 1 AND failed_log_count > 0 THEN COALESCE(event_count, 0) ELSE 0 END) AS BIGINT) AS failed_logins, "
    "CAST(sum(CASE WHEN i = 1 THEN total_bytes END) AS BIGINT) AS bytes, count(DISTINCT port) AS probed_ports FROM ("
    "SELECT *, unnest(ports) AS port, unnest(range(1, len(ports) + 1)) AS i FROM ("
    "SELECT *, unnest([time_bucket(INTERVAL 30 SECOND, alert_time), time_bucket(INTERVAL 30 SECOND, alert_time) - INTERVAL 30 SECOND]) AS w, "
    "CASE WHEN len(p) = 0 THEN [NULL] ELSE p END AS ports FROM ("
    "SELECT *, list_concat(COALESCE(destination_ports, []), log_ports) AS p FROM ("
    f"SELECT alert_id, alert_time, src_ip, event_count, destination_ports, {LOG_MEASURES} "
    "FROM (SELECT *, COALESCE(json_extract(sample_logs, '$[*]'), []::JSON[]) AS logs FROM alerts) x)))) GROUP BY 1, 2")
