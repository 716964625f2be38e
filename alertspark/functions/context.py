"""Evidence, context block and prompt rendering (F6–F8) and the retrieval /
model-input projections (P4, P5). Native string expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (MAX_CONTEXT_CHARS, NO_CONTEXT_MESSAGE, NO_USABLE_CONTEXT_MESSAGE,
                         UNTRUSTED_FOOTER, UNTRUSTED_HEADER)
from .normalize import py_strip


def distance_text(d: Column) -> Column:
    """Distance rendered with six decimals (portable across engines)."""
    return F.format_string("%.6f", d)


def evidence_record(record_id: Column, key: Column, value: Column, distance: Column) -> Column:
    """one evidence block; null when the value is null or blank after strip."""
    v = F.substring(py_strip(value), 1, MAX_CONTEXT_CHARS)
    return F.when(value.isNotNull() & (py_strip(value) != ""), F.concat(
        F.lit("Historical record:\nID: "), F.coalesce(py_strip(record_id), F.lit("")),
        F.lit("\nPattern: "), F.coalesce(py_strip(key), F.lit("")),
        F.lit("\nSimilarity distance: "), F.coalesce(distance, F.lit("None")),
        F.lit("\nHistorical knowledge:\n"), v))


def context_blocks(hits: DataFrame, kb_text: DataFrame, queries: DataFrame,
                   query_id: str = "query_id") -> DataFrame:
    """per query, ``has_context`` and the wrapped ``context_block``.

    ``hits`` = (query_id, id, distance, rank) from the similarity join,
    ``kb_text`` = (id, key, value). Records are joined in rank order with a
    blank line; queries without hits get the "no context" text, queries whose
    hits all have blank values get the "no usable context" text. Each query
    collects at most k ≤ 10 records, so the per-group list is bounded.
    """
    rec = hits.join(kb_text, "id", "left").select(
        query_id, "rank",
        evidence_record(F.col("id"), F.col("key"), F.col("value"), distance_text(F.col("distance"))).alias("rec"))
    per_q = rec.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", "rec"))).alias("_recs"))
    parts = F.filter(F.transform(F.col("_recs"), lambda r: r["rec"]), lambda x: x.isNotNull())
    q = queries.select(query_id).join(per_q, query_id, "left")
    has = F.coalesce(F.size(parts) > 0, F.lit(False))
    block = (F.when(F.col("_recs").isNull(), F.lit(NO_CONTEXT_MESSAGE))
             .when(F.size(parts) == 0, F.lit(NO_USABLE_CONTEXT_MESSAGE))
             .otherwise(F.concat(F.lit(UNTRUSTED_HEADER), F.array_join(parts, "\n\n"), F.lit(UNTRUSTED_FOOTER))))
    return q.select(query_id, has.alias("has_context"), block.alias("context_block"))


# --------------------------------------------------------------------------- P4, P5

RETRIEVAL_FIELDS = ["rule_name", "src_ip", "dest_ip", "protocol", "destination_ports", "event_count",
                    "time_window"]
MODEL_FIELDS = ["alert_name", "rule_name", "severity", "alert_time", "log_source", "src_ip", "dest_ip",
                "protocol", "destination_ports", "event_count", "time_window", "sample_logs", "asset",
                "threat_intelligence"]


def retrieval_input(df: DataFrame) -> DataFrame:
    """P5: the 7 fields the retrieval step receives (keyed by alert id)."""
    return df.select("alert_id", *RETRIEVAL_FIELDS)


def model_input(df: DataFrame) -> DataFrame:
    """The 16 model-input fields; ``alert_id`` is never part of the payload
    (kept only as the row key ``_key`` for re-joining verdicts)."""
    return df.select(F.col("alert_id").alias("_key"), *MODEL_FIELDS,
                     F.struct("has_context", "context_block").alias("historical_rag"),
                     F.col("organizational_reference_data"))


def _title(key: str) -> str:
    return key.replace("_", " ").title()


def render_prompt(df: DataFrame) -> Column:
    """F8: the prompt text from a P4 row. Sections in fixed order, omitted when
    empty; keys humanised; logs numbered from 1; reference keys in ``[KEY]``.
    Nested values print as JSON, nulls as ``None``."""
    core = [F.concat(F.lit(f"- {_title(c)}: "),
                     F.coalesce(F.col(c).cast("string") if c != "destination_ports"
                                else F.to_json(F.col(c)), F.lit("None")))
            for c in MODEL_FIELDS if c not in ("threat_intelligence", "sample_logs", "asset")]
    asset = F.when(F.coalesce(F.col("asset"), F.lit("")) != "", F.concat(
        F.lit("\n--- TARGET ASSET INFORMATION ---\n"),
        F.array_join(F.transform(F.map_entries(F.from_json("asset", "map<string,string>")),
                                 lambda e: F.concat(F.lit("- "), F.initcap(F.regexp_replace(e["key"], "_", " ")),
                                                    F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")))
    ti = F.when(F.coalesce(F.col("threat_intelligence"), F.lit("")) != "", F.concat(
        F.lit("\n--- THREAT INTELLIGENCE ENRICHMENT ---\n"),
        F.array_join(F.transform(F.map_entries(F.from_json("threat_intelligence", "map<string,string>")),
                                 lambda e: F.concat(F.lit("- "), F.initcap(F.regexp_replace(e["key"], "_", " ")),
                                                    F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")))
    logs_arr = F.from_json("sample_logs", "array<string>")
    logs = F.when(F.size(logs_arr) > 0, F.concat(
        F.lit("\n--- SAMPLE LOGS ---\n"),
        F.array_join(F.transform(logs_arr, lambda x, i: F.concat(F.lit("Log #"), (i + 1).cast("string"),
                                                                  F.lit(": "), x)), "\n")))
    rag = F.when(F.col("historical_rag").isNotNull(), F.concat(
        F.lit("\n--- HISTORICAL RAG CONTEXT ---\n- Has Context: "),
        F.when(F.col("historical_rag.has_context"), "True").otherwise("False"),
        F.lit("\n- Context Block:\n"), F.coalesce(F.col("historical_rag.context_block"), F.lit("None"))))
    ref = F.when(F.size(F.col("organizational_reference_data")) > 0, F.concat(
        F.lit("\n--- ORGANIZATIONAL REFERENCE DATA ---\n"),
        F.array_join(F.transform(F.map_entries("organizational_reference_data"),
                                 lambda e: F.concat(F.lit("["), F.upper(e["key"]), F.lit("]\n"), e["value"],
                                                    F.lit("\n"))), "\n")))
    return F.concat_ws(
        "\n",
        F.lit("Triage the following Security Operations Center (SOC) alert carefully."),
        F.lit("The alert has been enriched with threat intelligence, historical RAG evidence, "
              "and organizational reference data."),
        F.lit("\n--- ALERT CORE DETAILS ---"),
        *core, asset, ti, logs, rag, ref,
        F.lit("\nPerform a thorough analysis based on all the provided data above "
              "and return the final triage classification."))
