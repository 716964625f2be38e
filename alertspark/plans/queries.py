"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) → DataFrame``.

Every query reads the driver tables (alerts are derived from ``events``,
vectors from ``embeddings``, texts from ``documents`` / ``conversations``), so
its work grows with the data. Result columns are aliased to match
``oracle_sql.ORACLE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import IPV4_PRIVATE_NETWORKS, STATUS_PENDING, STATUS_PROCESSING
from ..functions.context import context_blocks
from ..functions.ip import classify_cols, ipv4_num, net_bounds, with_direction
from ..functions.normalize import (build_query, confidence_band, event_volume, port_services, threshold_op,
                                   threshold_value, window_seconds)
from ..functions.ti import ti_flat
from ..operators import enrich, monitor, state, triage
from ..operators.ingest import (checked_alerts, primary_key_guard, retrieval_context, split_missing_id,
                                submissions_from_alerts, unwrap_payload)
from ..operators.joins import cidr_join
from ..operators.knowledge import validate_records
from ..operators.prefixes import prefix_join
from ..operators.similarity import best_match, knn, squared_l2
from ..sources.alerts import load_alerts
from ..sources.reference import load_reference
from ..sources.tables import read_table
from ..streaming.pipelines import threshold_windows

NOW = "2024-02-01 00:00:00"
CLAIM_N = 25


def _alerts(spark, sf) -> DataFrame:
    return load_alerts(spark, sf)


# --------------------------------------------------------------------------- sources

def s1_alert_bulk_load(spark, sf):
    return _alerts(spark, sf)


def s2_validated_ingest(spark, sf):
    # One pass: a rejected row shows its id, address and reasons only.
    checked = checked_alerts(submissions_from_alerts(_alerts(spark, sf)))
    ok = F.size("reasons") == 0
    return checked.select("alert_id", "src_ip", *[F.when(ok, F.col(c)).alias(c) for c in ("alert_time", "destination_ports", "event_count", "analysis_status")],
                          F.when(~ok, F.col("reasons")).alias("reasons"))


def s3_constraint_check(spark, sf):
    checked = checked_alerts(submissions_from_alerts(_alerts(spark, sf)))
    return checked.select("alert_id", F.explode("reasons").alias("reason")) \
        .groupBy("reason").agg(F.count("*").cast("bigint").alias("n"))


def s4_reference_load(spark, sf):
    # Reference dimensions joined to the alerts that touch them (per asset ip).
    ref = load_reference(spark)
    a = _alerts(spark, sf)
    return a.join(F.broadcast(ref["assets"].select(F.col("ip").alias("dest_ip"), "name", "criticality")),
                  "dest_ip").groupBy("name", "criticality").agg(F.count("*").cast("bigint").alias("n"))


def _kb_from_conversations(spark, sf) -> DataFrame:
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    q = c.filter(F.col("role") == "user").alias("q")
    a = c.filter(F.col("role") == "assistant").alias("a")
    pairs = q.join(a, (F.col("q.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1), "left")
    return pairs.select(F.concat(F.lit("pattern_"), F.col("q.conv_id").cast("string"), F.lit("_"),
                                 F.col("q.turn").cast("string")).alias("id"),
                        F.col("q.text").alias("key"), F.col("a.text").alias("value"))


def s5_kb_bulk_load(spark, sf):
    return _kb_from_conversations(spark, sf)


def s6_kb_validate(spark, sf):
    kb = _kb_from_conversations(spark, sf)
    v = validate_records(kb)
    return v.select("id", F.length("key").cast("bigint").alias("key_len"),
                    F.length("value").cast("bigint").alias("value_len"),
                    (F.size("reasons") == 0).alias("valid"))


def s7_kb_full_scan(spark, sf):
    return _kb_from_conversations(spark, sf).select("id", "key", "value")


def s8_kb_point_lookup(spark, sf):
    # Point lookup by id (input is trimmed; missing value → ""), over the whole KB.
    from ..operators.knowledge import lookup
    return lookup(_kb_from_conversations(spark, sf), "  pattern_1_0 ")


def g4_kb_count(spark, sf):
    return _kb_from_conversations(spark, sf).agg(F.count("*").cast("bigint").alias("kb_count"))


# --------------------------------------------------------------------------- projections / filters

def p1_status_filter(spark, sf):
    return state.status_filter(_alerts(spark, sf), STATUS_PENDING).select("alert_id", "alert_time", "rule_name")


def o1_fifo_claim(spark, sf):
    return state.claimed_projection(state.claim(_alerts(spark, sf), CLAIM_N))


def p3_ti_projection(spark, sf):
    return state.ti_updated_projection(state.claim_pending(_alerts(spark, sf)))


def p5_retrieval_input(spark, sf):
    return _alerts(spark, sf).select("alert_id", "rule_name", "src_ip", "dest_ip", "protocol",
                                     "destination_ports", "event_count", "time_window")


def p7_ti_flatten(spark, sf):
    return _alerts(spark, sf).select("alert_id", *ti_flat(F.col("threat_intelligence")))


def p11_verdict_checks(spark, sf):
    a = _alerts(spark, sf).filter(F.col("llm_classification").isNotNull())
    return triage.verdict_checks(a.select("alert_id", "llm_classification", "llm_confidence", "llm_reason",
                                          "llm_recommendation", "triage_status")) \
        .select("alert_id", "violations")


def p12_notification_route(spark, sf):
    r = _stored_results(spark, sf)
    return r.select("alert_id", triage.route(F.col("request_status"), F.col("llm_classification")).alias("route"))


def _stored_results(spark, sf):
    p = _alerts(spark, sf).filter(F.col("analysis_status") == "Processed")
    failed = F.col("triage_status") == "Failed"
    return p.select("alert_id", "llm_classification", F.col("llm_confidence").cast("double").alias("llm_confidence"),
                    F.when(failed, "failsafe_executed").otherwise("success").alias("request_status"),
                    F.when(failed, F.lit("System error: scoring unavailable"))
                    .otherwise(F.concat(F.lit("Stored verdict for "), F.col("rule_name"))).alias("analysis_reason"),
                    F.when(failed, F.lit("Escalate to Tier-2 for manual triage."))
                    .otherwise(F.lit("Review the alert.")).alias("llm_recommendation"))


def f9_notification(spark, sf):
    return triage.notifications(_stored_results(spark, sf))


# --------------------------------------------------------------------------- scalar functions

def f1_classify_ip(spark, sf):
    a = classify_cols(_alerts(spark, sf).select("alert_id", "src_ip", "dest_ip"))
    return a.select("alert_id", "source_type", "destination_type")


def f2_direction(spark, sf):
    a = _alerts(spark, sf).select("alert_id", "dest_ip")
    return with_direction(a, "dest_ip", "direction")


def f3_port_services(spark, sf):
    return _alerts(spark, sf).select("alert_id", port_services(F.col("destination_ports")).alias("services"))


def f4_event_volume(spark, sf):
    return _alerts(spark, sf).select("alert_id", event_volume(F.col("event_count")).alias("event_volume"))


def f5_build_query(spark, sf):
    a = classify_cols(_alerts(spark, sf))
    return a.select("alert_id", build_query(F.col("rule_name"), "src_ip", "dest_ip",
                                            F.col("protocol"), F.col("destination_ports"), F.col("event_count"),
                                            source_type=F.col("source_type"),
                                            destination_type=F.col("destination_type")).alias("query_text"))


def f10_failsafe_reason(spark, sf):
    res = triage.with_failsafe(state.claim_pending(_alerts(spark, sf)),
                               spark.createDataFrame([], "alert_id string, llm_classification string, "
                                                     "llm_confidence double, llm_reason string, "
                                                     "llm_recommendation string, triage_status string, "
                                                     "error string"))
    return res.select("alert_id", "llm_reason", "analysis_reason")


def f11_window_seconds(spark, sf):
    return _alerts(spark, sf).select("alert_id", window_seconds(F.col("time_window")).alias("window_seconds"))


def f13_confidence_band(spark, sf):
    a = _alerts(spark, sf).filter(F.col("llm_confidence").isNotNull())
    return a.select("alert_id", confidence_band(F.col("llm_confidence")).alias("band"))


def f15_squared_l2(spark, sf):
    # Native re-scoring of every best match found by the similarity join.
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = best_match(knn(e, e, k=1, query_id="vec_id", kb_id="vec_id", exclude_self=True))
    q = e.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("qv"))
    k = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("kv"))
    j = hits.join(q, "query_id").join(k, "id")
    return j.select("query_id", "id", F.round(squared_l2(F.col("qv"), F.col("kv")), 6).alias("distance"))


# --------------------------------------------------------------------------- joins

def j1_ti_merge(spark, sf):
    a = _alerts(spark, sf)
    abuse, vt = enrich.ti_snapshots_from_alerts(a)
    m = enrich.ti_merge(a, abuse, vt, dedupe=False)
    return m.select("alert_id", *ti_flat(F.col("ti_merged")))


def j3_primary_key_guard(spark, sf):
    a = _alerts(spark, sf)
    existing = a.filter(F.col("analysis_status") == "Processed").select("alert_id")
    # Re-submission batch: ids re-keyed so consecutive events collide.
    eid = F.regexp_extract("alert_id", r"([0-9]+)$", 1).cast("bigint") - 100000
    incoming = a.withColumn("alert_id", F.concat(F.lit("ALT-"), (F.floor(eid / 2) * 2 + 100000).cast("string")))
    accepted, _ = primary_key_guard(incoming.select("alert_id", "alert_time", "rule_name", "src_ip"), existing,
                                    ("alert_time", "rule_name", "src_ip"))
    return accepted


def j4_ti_update(spark, sf):
    a = _alerts(spark, sf)
    abuse, vt = enrich.ti_snapshots_from_alerts(a)
    upd = enrich.ti_merge(a.filter(F.col("analysis_status") == STATUS_PROCESSING), abuse, vt, dedupe=False) \
        .select("alert_id", F.col("ti_merged").alias("threat_intelligence"))
    out, _ = state.apply_ti(a, upd)
    return out.select("alert_id", "analysis_status", *ti_flat(F.col("threat_intelligence"))[:1],
                      *ti_flat(F.col("threat_intelligence"))[4:5])


def j5_verdict_apply(spark, sf):
    a = _alerts(spark, sf)
    claimed = state.claim_pending(a)
    v = triage.with_failsafe(claimed, spark.createDataFrame(
        [], "alert_id string, llm_classification string, llm_confidence double, llm_reason string, "
            "llm_recommendation string, triage_status string, error string"))
    out = state.apply_verdicts(a, v, NOW)
    return out.select("alert_id", "analysis_status", "llm_classification", "llm_confidence",
                      "triage_status", "analyzed_at")


def j6_failsafe(spark, sf):
    a = _alerts(spark, sf)
    claimed = state.claim_pending(a)
    verdicts = enrich.evidence_features(claimed, load_reference(spark))
    v = triage.rule_verdict(verdicts).filter(F.col("llm_classification") != "Needs Review")
    return triage.with_failsafe(claimed, v).select("alert_id", "llm_classification", "triage_status",
                                                   "request_status")


def j8_asset_lookup(spark, sf):
    out = enrich.asset_lookup(_alerts(spark, sf), load_reference(spark)["assets"])
    return out.select("alert_id", "dest_asset_name", "dest_asset_type", "dest_asset_criticality",
                      "dest_asset_zone", "src_asset_name")


def j9_approved_match(spark, sf):
    out = enrich.approved_alerts(_alerts(spark, sf), load_reference(spark)["approved"])
    return out.select("alert_id", "approved_label")


def j10_cidr_containment(spark, sf):
    a = _alerts(spark, sf).select("alert_id", "src_ip")
    nets = spark.createDataFrame(
        [(f"{ad}/{p}", *net_bounds(ad, p)) for ad, p in IPV4_PRIVATE_NETWORKS],
        "network string, net_lo long, net_hi long")
    return cidr_join(a, ipv4_num(F.col("src_ip")), F.broadcast(nets)).select("alert_id", "network")


def j10_networks_in_networks(spark, sf):
    # Addresses, IPv4 networks and their 6to4 networks in the networks that the alerts' sources form.
    a = _alerts(spark, sf).select("alert_id", "src_ip", ipv4_num(F.col("src_ip")).alias("n"),
                                  F.regexp_extract("alert_id", r"([0-9]+)$", 1).cast("bigint").alias("e"))
    num, e = F.col("n"), F.col("e")

    def text6(value: Column, length: Column) -> Column:
        return F.concat(F.lit("2002:"), F.lower(F.hex(F.shiftright(value, 16))), F.lit(":"),
                        F.lower(F.hex(F.pmod(value, F.lit(65536)))), F.lit("::/"), length.cast("string"))

    def text4(value: Column, length: int) -> Column:
        octets = [F.pmod(F.shiftright(value, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
        return F.concat(F.concat_ws(".", *octets), F.lit(f"/{length}"))

    item = F.when(num.isNull(), None).when(e % 3 == 0, F.col("src_ip")) \
        .when(e % 3 == 1, F.concat("src_ip", F.lit("/"), (8 + e % 25).cast("string"))).otherwise(text6(num, 16 + e % 33))
    cut = [F.shiftleft(F.shiftright(num, 32 - n), 32 - n) for n in (8, 16, 20)]
    nets = F.array(text4(cut[0], 8), text4(cut[1], 16), text4(cut[2], 20), text6(cut[0], F.lit(24)), text6(cut[1], F.lit(32)))
    networks = a.where("n is not null").select(F.explode(nets).alias("network")).distinct()
    return prefix_join(a.select("alert_id", item.alias("item")), "item", networks)


def j11_segmentation(spark, sf):
    out = enrich.segmentation_check(_alerts(spark, sf), load_reference(spark)["segmentation"])
    return out.filter(F.col("seg_status").isNotNull()).select("alert_id", "seg_rule", "seg_status")


def j12_playbook_match(spark, sf):
    ref = load_reference(spark)
    m = enrich.playbook_matches(enrich.match_playbooks(_alerts(spark, sf), ref), ref["playbooks"])
    return m.select("alert_id", "playbook", "playbook_severity", F.size("actions").cast("bigint").alias("n_actions"))


def j7_similarity(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    h = knn(e, e, k=3, query_id="vec_id", kb_id="vec_id", exclude_self=True)
    return h.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def o2_topk_clamped(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    h = knn(e, e, k=25, query_id="vec_id", kb_id="vec_id", exclude_self=True)  # clamps to 10
    return h.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def g6_best_match(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    h = best_match(knn(e, e, k=1, query_id="vec_id", kb_id="vec_id", exclude_self=True))
    return h.select("query_id", "id", F.round("distance", 6).alias("distance"))


def f7_context_block(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    h = knn(e, e, k=1, query_id="vec_id", kb_id="vec_id", exclude_self=True)
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("key"),
        F.col("text").alias("value"))
    q = e.select(F.col("vec_id").cast("string").alias("query_id"))
    return context_blocks(h.withColumn("distance", F.round("distance", 6)), docs, q)


# --------------------------------------------------------------------------- aggregations / ordering

def g2_queue_counts(spark, sf):
    return state.queue_counts(_alerts(spark, sf))


def g3_queue_gate(spark, sf):
    return state.queue_gate(_alerts(spark, sf))


def o4_startup_recovery(spark, sf):
    return state.recover(_alerts(spark, sf)).groupBy("analysis_status") \
        .agg(F.count("*").cast("bigint").alias("n"))


def g5_state_fold(spark, sf):
    a = _alerts(spark, sf)
    claimed = state.claim_pending(a)
    abuse, vt = enrich.ti_snapshots_from_alerts(a)
    ti = enrich.ti_merge(claimed, abuse, vt, dedupe=False).select("alert_id", F.col("ti_merged").alias("threat_intelligence"))
    v = triage.with_failsafe(claimed, spark.createDataFrame(
        [], "alert_id string, llm_classification string, llm_confidence double, llm_reason string, "
            "llm_recommendation string, triage_status string, error string"))
    log = state.union_events(
        state.inserted_events(a),
        state.status_events(claimed, "claimed", STATUS_PROCESSING, "2024-02-01 00:00:00", 1),
        state.ti_events(ti, "2024-02-01 00:00:01", 2),
        state.verdict_events(v, "2024-02-01 00:00:02", 3))
    cur = state.fold(log)
    return cur.select("alert_id", "analysis_status", "llm_classification", "llm_confidence", "triage_status",
                      "analyzed_at", *ti_flat(F.col("threat_intelligence"))[:1])


def g7_status_board(spark, sf):
    return monitor.status_board(_alerts(spark, sf))


def g8_detected_threats(spark, sf):
    return monitor.detected_threats(_alerts(spark, sf))


def g9_threat_patterns(spark, sf):
    return monitor.threat_patterns(_alerts(spark, sf))


def g10_triage_latency(spark, sf):
    return monitor.triage_latency(_alerts(spark, sf))


def g11_verdict_quality(spark, sf):
    a = _alerts(spark, sf).filter(F.col("llm_classification").isNotNull())
    a = a.withColumn("expected_label", F.when(F.col("severity").isin("High", "Critical"), "True Positive")
                     .otherwise("False Positive"))
    return monitor.verdict_quality(a, by=["rule_name"])


def g12_log_measures(spark, sf):
    m = enrich.log_measures(_alerts(spark, sf))
    return m.select("alert_id", "total_bytes", "failed_log_count", "log_ports", "deny_count",
                    "sqli_hits", "xss_hits")


def o3_recent_alerts(spark, sf):
    return monitor.recent_alerts(_alerts(spark, sf), 20)


def f18_rule_verdict(spark, sf):
    ref = load_reference(spark)
    v = triage.rule_verdict(enrich.evidence_features(_alerts(spark, sf), ref))
    return v.groupBy("llm_classification", "llm_confidence").agg(F.count("*").cast("bigint").alias("n"))




def f8_render_prompt(spark, sf):
    # P4 + J2 + P9 + F8: the model input and its rendered prompt for every alert
    # (rows-only check: the text embeds JSON renderings that differ by engine).
    from ..functions.context import model_input, render_prompt

    p = model_input(enrich.attach_reference(retrieval_context(_alerts(spark, sf))))
    return p.select(F.col("_key").alias("alert_id"), render_prompt(p).alias("prompt"))


def p8_unwrap_payload(spark, sf):
    # Wrapped alerts whose direct fields override where they are given.
    a = _alerts(spark, sf)
    wrapped = a.select(F.struct("alert_id", "rule_name", "severity", "protocol").alias("alert"),
                       F.when(F.col("severity") == "High", F.upper("rule_name")).alias("rule_name"),
                       F.when(F.col("log_source") == "WAF", F.col("alert_id")).alias("alert_id"), "event_count")
    return unwrap_payload(wrapped).select("alert_id", "rule_name", "severity", "protocol", "event_count")


def p9_retrieval_context(spark, sf):
    a = _alerts(spark, sf)
    block = F.when(F.col("severity") != "Low", F.col("rule_name")).alias("context_block")
    has = F.when(F.col("protocol").isNotNull(), F.col("protocol") == "TCP").alias("has_context")
    nested = a.select("alert_id", F.when(F.col("analysis_status") != STATUS_PENDING, F.struct(has, block)).alias("rag"),
                      (F.col("severity") == "High").alias("has_context"), F.col("log_source").alias("context_block"))
    return retrieval_context(nested).select("alert_id", "has_context", "context_block")


def p10_missing_id(spark, sf):
    a = _alerts(spark, sf).withColumn("alert_id", F.when(F.col("severity") == "Low", "").when(F.col("severity") != "Critical", F.col("alert_id")))
    good, bad = split_missing_id(a)
    both = good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
    return both.groupBy("severity", "rejected").agg(F.count("*").cast("bigint").alias("n"), F.count("alert_id").cast("bigint").alias("ids"))


def f12_threshold(spark, sf):
    # Threshold texts of every shape from the alerts' counts.
    n = F.col("event_count")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in (">", ">= ", "<", "<=", "", "about ")]), F.pmod(n, F.lit(6)) + 1), n.cast("string"),
                    F.when(n % 4 == 0, "GB").otherwise(""))
    a = _alerts(spark, sf).select("alert_id", text.alias("t"))
    return a.select("alert_id", threshold_op(F.col("t")).alias("op"), threshold_value(F.col("t")).alias("bound"))


def t5_threshold_windows(spark, sf):
    # The batch form of the stream: ports, failed logins and bytes per source on sliding windows.
    ports, volume = threshold_windows(_alerts(spark, sf))
    p = ports.select(F.col("w.start").alias("_w"), F.col("src_ip").alias("_s"), "probed_ports")
    both = volume.join(p, (F.col("w.start") == F.col("_w")) & F.col("src_ip").eqNullSafe(F.col("_s")))
    return both.select(F.col("_w").cast("timestamp_ntz").alias("window_start"), "src_ip", "alerts", "failed_logins", "bytes",
                       F.col("probed_ports").cast("bigint").alias("probed_ports"))


QUERIES = {name: fn for name, fn in globals().items()
           if callable(fn) and name[:1] in "sfpjgot" and name[1:2].isdigit()}
