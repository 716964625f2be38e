"""The processing cycle (T3) as one batch plan — the flagship query.

gate → claim → TI merge → retrieval query text → historical retrieval →
evidence features → scorer → fail-safe → apply verdicts → route + render.

The reference handles one alert per 5-second poll; here one cycle handles a
whole claimed batch with one DataFrame plan. Scale notes:

* ``claim`` with a bounded ``n`` is a top-n (TakeOrderedAndProject); with
  ``n=None`` every Pending alert is claimed by a filter (no sort at all).
* Retrieval works on *distinct* query texts: alerts with the same behaviour
  share one sentence, so the similarity join runs on a set bounded by the
  vocabulary of rules × address classes × protocols × services × volumes,
  and the per-text context is joined back (broadcast behind a probe).
* The historical KB is a rollup of processed alerts by query text — an
  aggregation reduced map-side — so it grows with the data but stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table_path
from ..constants import NO_CONTEXT_MESSAGE, STATUS_PENDING, STATUS_PROCESSED, STATUS_PROCESSING
from ..functions.context import context_blocks
from ..functions.ip import classify_cols
from ..functions.normalize import build_query
from ..operators import enrich, state, triage
from ..operators.knowledge import fit_text_embedder
from ..operators.similarity import knn
from ..sources.alerts import load_alerts
from ..sources.reference import load_reference


def with_query_text(alerts: DataFrame) -> DataFrame:
    """F1 + F5: the retrieval sentence per alert."""
    a = classify_cols(alerts)
    return a.withColumn("query_text", build_query(
        F.col("rule_name"), "src_ip", "dest_ip", F.col("protocol"), F.col("destination_ports"),
        F.col("event_count"), source_type=F.col("source_type"), destination_type=F.col("destination_type")))


def kb_rollup(alerts: DataFrame) -> DataFrame:
    """Processed alerts by behaviour sentence, as sums: rollups can be added and taken off."""
    p = with_query_text(alerts.filter(F.col("analysis_status") == STATUS_PROCESSED))
    is_class = lambda c: F.count_if(F.col("llm_classification") == c)
    return p.groupBy("query_text").agg(
        F.count("*").alias("n"), is_class("True Positive").alias("tp"), is_class("False Positive").alias("fp"),
        is_class("Needs Review").alias("nr"), F.coalesce(F.sum("llm_confidence"), F.lit(0)).cast("decimal(30,2)").alias("conf"),
        F.count("llm_confidence").alias("conf_n"))


def kb_records(rollup: DataFrame) -> DataFrame:
    """The knowledge records of a rollup: (id, key, value)."""
    mean = F.when(F.col("conf_n") > 0, F.col("conf").cast("double") / F.col("conf_n"))
    value = F.format_string("%d prior alerts: %d True Positive, %d False Positive, %d Needs Review; "
                            "mean confidence %.2f.", "n", "tp", "fp", "nr", mean)
    return rollup.select(F.sha2("query_text", 256).alias("id"), F.col("query_text").alias("key"), value.alias("value"))


def historical_kb(alerts: DataFrame) -> DataFrame:
    """Historical knowledge: processed alerts rolled up by behaviour sentence."""
    return kb_records(kb_rollup(alerts))


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` as a table of its own; ``scratch`` gets its path, for the caller to delete."""
    path = new_table_path(df.sparkSession, name)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def retrieve_context(queries: DataFrame, kb: DataFrame, k: int = 1, scratch: list[str] | None = None) -> DataFrame:
    """F16 + J7 + F7 over distinct query texts: (query_text, has_context, context_block)."""
    # Both are read by the IDF fit, the kNN and the context join: written once,
    # so nothing stays cached after a batch.
    texts = written(queries.select("query_text").distinct(), "query-texts", scratch)
    kb = written(kb, "knowledge", scratch)
    if kb.limit(1).count() == 0:
        # Empty store: every query gets the "no context" answer.
        return texts.select("query_text", F.lit(False).alias("has_context"),
                            F.lit(NO_CONTEXT_MESSAGE).alias("context_block"))
    embed = fit_text_embedder(kb, "key", dim=None)
    kbv = embed(kb, "key").select("id", "embedding")
    qv = embed(texts.withColumnRenamed("query_text", "key"), "key").select(
        F.col("key").alias("query_id"), "embedding")
    hits = knn(qv, kbv, k=k, query_id="query_id", kb_id="id")
    ctx = context_blocks(hits, kb.select("id", "key", "value"), texts.withColumnRenamed("query_text", "query_id"))
    return ctx.withColumnRenamed("query_id", "query_text")


def run_cycle(spark: SparkSession, alerts: DataFrame, now: str = "2024-02-01 00:00:00", n: int | None = None,
              scorer=triage.rule_verdict, ref: dict | None = None,
              scratch: list[str] | None = None, history: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """One cycle over ``alerts`` (current state). Returns every stage's output. ``history`` gives the
    knowledge records (``kb``) and TI snapshots (``abuse``, ``vt``) where ``alerts`` is not the whole state."""
    ref = ref or load_reference(spark)
    gate = state.queue_gate(alerts)
    claimed = (state.claim(alerts, n) if n is not None
               else alerts.filter(F.col("analysis_status") == STATUS_PENDING)
               .withColumn("analysis_status", F.lit(STATUS_PROCESSING)))
    # The retrieval sentence does not depend on TI, so it is built from the
    # claimed rows directly (F1 is computed once and reused by F17).
    with_q = with_query_text(claimed)
    ctx = retrieve_context(with_q, history["kb"] if history else historical_kb(alerts), scratch=scratch)
    abuse, vt = (history["abuse"], history["vt"]) if history else enrich.ti_snapshots_from_alerts(alerts)
    with_ti = enrich.ti_merge(with_q, abuse, vt, dedupe=False).withColumn("threat_intelligence", F.col("ti_merged")).drop("ti_merged")
    with_ctx = with_ti.join(ctx, "query_text", "left")
    features = enrich.evidence_features(with_ctx, ref)
    keep = ["has_context", "matched_playbooks", "seg_status", "approved_endpoint"]
    if scorer is triage.rule_verdict:
        # The default scorer keeps one row per claimed alert: fail-safe as a projection.
        verdicts = scorer(features, keep=keep)
        results = triage.fill_failsafe(verdicts, keep=keep)
    else:
        verdicts = scorer(features)
        results = triage.with_failsafe(claimed, verdicts).join(features.select("alert_id", *keep), "alert_id", "left")
    applied = state.apply_verdicts(alerts, results, now)
    notes = triage.notifications(results)
    return {"gate": gate, "claimed": claimed, "features": features, "context": ctx, "verdicts": verdicts,
            "results": results, "alerts_after": applied, "notifications": notes}


def cycle_results(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """Per claimed alert: verdict, route and retrieval flag."""
    out = run_cycle(spark, load_alerts(spark, sf_dir), n=n)
    return out["results"].withColumn("route", triage.route(F.col("request_status"), F.col("llm_classification")))


def cycle_summary(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """Flagship summary: counts of claimed alerts by verdict, status and route."""
    r = cycle_results(spark, sf_dir, n)
    return r.groupBy("llm_classification", "triage_status", "route", "has_context").agg(
        F.count("*").cast("bigint").alias("n"), F.round(F.avg("llm_confidence"), 6).alias("avg_confidence"))
