"""Verdicts: deterministic scorer, fail-safe, domain checks, notification
routing and rendering (F9, F10, F13, F18, J6, P11, P12).

The reference leaves classification to an external model. Here the scorer is
a plug-in ``DataFrame → DataFrame(alert_id, verdict…)``; the default
``rule_verdict`` is a ``when`` ladder over the F17 evidence row (our rule,
documented in SURVEY §7.4), so it runs natively inside the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CLASS_FP, CLASS_NR, CLASS_TP, CLASSIFICATIONS, FAILSAFE_RECOMMENDATION,
                         FAILSAFE_RETURNED_REASON_PREFIX, FAILSAFE_STORED_REASON_PREFIX,
                         FAILSAFE_STORED_REASON_SUFFIX, NOTIFY_ACTION_MAIL, NOTIFY_FAILURE_MAIL,
                         NOTIFY_FAILURE_REASON, NOTIFY_FAILURE_RECOMMENDATION,
                         REASON_WORD_LIMIT, RECOMMENDATION_WORD_LIMIT, TRIAGE_FAILED,
                         TRIAGE_SUCCEEDED)
from ..functions.ti import ti_malicious

CONTENT_PLAYBOOKS = ["sqli", "xss", "data_exfiltration", "brute_force", "port_scan"]


def rule_verdict(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """ordered ladder, first hit wins (our stand-in for the model).
    ``keep`` passes feature columns through (avoids re-joining features)."""
    mal = ti_malicious(F.col("abuse_score"), F.col("vt_malicious"))
    pb = F.array_join(F.col("matched_playbooks"), ", ")
    has_pb = F.size(F.col("matched_playbooks")) > 0
    seg = F.col("seg_status")
    step1 = F.col("approved_endpoint") & (F.col("abuse_score") < 50) & (F.col("vt_malicious") < 3)
    step2 = seg.isin("exception", "allowed")
    step3 = (seg == "violation") | has_pb
    cls = (F.when(step1, CLASS_FP).when(step2, CLASS_FP).when(step3, CLASS_TP)
           .when(mal, CLASS_TP).otherwise(CLASS_NR))
    conf = (F.when(step1, 90.0).when(step2, 85.0)
            .when(step3, F.when(mal, 95.0).otherwise(85.0))
            .when(mal, 75.0).otherwise(55.0))
    reason = (F.when(step1, F.concat(F.lit("Traffic matches approved endpoint "), F.col("approved_label"),
                                     F.lit(" with allowed protocol and ports; threat intelligence is clean.")))
              .when(step2, F.concat(F.lit("Segmentation rule "), F.col("seg_rule").cast("string"),
                                    F.lit(" permits this traffic ("), seg, F.lit(").")))
              .when(step3, F.concat(F.lit("Evidence matches: "),
                                    F.when(seg == "violation", F.lit("segmentation violation")).otherwise(F.lit("")),
                                    F.when((seg == "violation") & has_pb, F.lit(", ")).otherwise(F.lit("")),
                                    pb, F.lit(".")))
              .when(mal, F.concat(F.lit("Threat intelligence marks the source as malicious (abuse score "),
                                  F.col("abuse_score").cast("string"), F.lit(", VirusTotal malicious "),
                                  F.col("vt_malicious").cast("string"), F.lit(").")))
              .otherwise(F.lit("Evidence is inconclusive.")))
    rec = (F.when(step1 | step2, F.lit("Close as expected activity."))
           .when(step3, F.concat(F.lit("Follow playbook response for "),
                                 F.coalesce(F.try_element_at(F.col("matched_playbooks"), F.lit(1)),
                                            F.lit("segmentation_violation")), F.lit(".")))
           .when(mal, F.lit("Block the source address and investigate related activity."))
           .otherwise(F.lit("Assign to an analyst for manual review.")))
    return features.select("alert_id", *(keep or []), cls.alias("llm_classification"), conf.alias("llm_confidence"),
                           reason.alias("llm_reason"), rec.alias("llm_recommendation"),
                           F.lit(TRIAGE_SUCCEEDED).alias("triage_status"),
                           F.lit(None).cast("string").alias("error"))


def failsafe_reason(err: Column) -> Column:
    """stored text of a failed triage."""
    return F.concat(F.lit(FAILSAFE_STORED_REASON_PREFIX), err, F.lit(FAILSAFE_STORED_REASON_SUFFIX))


def returned_failure_reason(err: Column) -> Column:
    """text returned to the caller (different from the stored one)."""
    return F.concat(F.lit(FAILSAFE_RETURNED_REASON_PREFIX), err)


def fill_failsafe(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """J6 as a projection, for a scorer output that already holds one row per
    claimed alert (null or failed verdicts are replaced; no join needed)."""
    v = df.select("alert_id", *(keep or []), F.col("llm_classification").alias("_c"),
                  F.col("llm_confidence").cast("double").alias("_f"), F.col("llm_reason").alias("_r"),
                  F.col("llm_recommendation").alias("_m"), F.col("triage_status").alias("_t"),
                  F.col("error").alias("_e"), F.lit(True).alias("_hit"))
    return _fill(v, keep or [])


def _fill(j: DataFrame, keep: list[str]) -> DataFrame:
    failed = F.col("_hit").isNull() | F.col("_e").isNotNull() | F.col("_c").isNull()
    err = F.coalesce(F.col("_e"), F.when(F.col("_hit").isNull(), F.lit("no verdict returned")),
                     F.lit("empty classification"))
    return j.select(
        "alert_id", *keep,
        F.when(failed, F.lit(CLASS_NR)).otherwise(F.col("_c")).alias("llm_classification"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("_f")).alias("llm_confidence"),
        F.when(failed, failsafe_reason(err)).otherwise(F.col("_r")).alias("llm_reason"),
        F.when(failed, F.lit(FAILSAFE_RECOMMENDATION)).otherwise(F.col("_m")).alias("llm_recommendation"),
        F.when(failed, F.lit(TRIAGE_FAILED)).otherwise(F.coalesce(F.col("_t"), F.lit(TRIAGE_SUCCEEDED)))
        .alias("triage_status"),
        F.when(failed, F.lit("failsafe_executed")).otherwise(F.lit("success")).alias("request_status"),
        F.when(failed, returned_failure_reason(err)).otherwise(F.col("_r")).alias("analysis_reason"))


def with_failsafe(claimed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every claimed alert gets a verdict. Missing or failed scoring →
    Needs Review, 0, fixed reason/recommendation, Failed. Adds ``request_status``
    (``success`` / ``failsafe_executed``) and the returned ``analysis_reason``."""
    v = verdicts.select("alert_id", F.col("llm_classification").alias("_c"),
                        F.col("llm_confidence").cast("double").alias("_f"),
                        F.col("llm_reason").alias("_r"), F.col("llm_recommendation").alias("_m"),
                        F.col("triage_status").alias("_t"), F.col("error").alias("_e"),
                        F.lit(True).alias("_hit"))
    j = claimed.select("alert_id").join(v, "alert_id", "left")
    return _fill(j, [])


def _words(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def verdict_checks(verdicts: DataFrame, reason_words: int = REASON_WORD_LIMIT,
                   recommendation_words: int = RECOMMENDATION_WORD_LIMIT) -> DataFrame:
    """Domain checks; adds ``violations`` (array of failed check names)."""
    c = F.col("llm_confidence").cast("double")
    checks = [
        (~F.coalesce(F.col("llm_classification").isin(*CLASSIFICATIONS), F.lit(False)), "classification"),
        (~F.coalesce(c.between(0, 100), F.lit(False)), "confidence_range"),
        (F.coalesce(_words(F.col("llm_reason")) > reason_words, F.lit(False)), "reason_words"),
        (F.coalesce(_words(F.col("llm_recommendation")) > recommendation_words, F.lit(False)),
         "recommendation_words"),
        (~F.coalesce(F.col("triage_status").isin(TRIAGE_SUCCEEDED, TRIAGE_FAILED), F.lit(False)), "triage_status"),
    ]
    v = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
    return verdicts.withColumn("violations", v)


def route(request_status: Column, classification: Column) -> Column:
    """``action_mail`` for success + (True Positive | Needs Review),
    ``none`` for success + False Positive, ``failure_mail`` otherwise."""
    ok = F.coalesce(request_status == "success", F.lit(False))
    return (F.when(ok & classification.isin(CLASS_TP, CLASS_NR), "action_mail")
            .when(ok, "none").otherwise("failure_mail"))


def notifications(results: DataFrame) -> DataFrame:
    """F9 + P12: subject and body for every result routed to a mail; on the
    failure route a reason starting with ``System error`` is replaced by the
    fixed failure reason and recommendation."""
    r = route(F.col("request_status"), F.col("llm_classification"))
    sys_err = F.coalesce(F.col("analysis_reason").startswith("System error"), F.lit(False))
    fail = r == "failure_mail"
    reason = F.when(fail & sys_err, F.lit(NOTIFY_FAILURE_REASON)).otherwise(F.col("analysis_reason"))
    recommendation = F.when(fail & sys_err, F.lit(NOTIFY_FAILURE_RECOMMENDATION)) \
        .otherwise(F.col("llm_recommendation"))
    values = {"alert_id": F.col("alert_id"), "classification": F.col("llm_classification"),
              "confidence": F.col("llm_confidence").cast("string"), "reason": F.coalesce(reason, F.lit("")),
              "recommendation": F.coalesce(recommendation, F.lit(""))}

    def mail(text: str) -> Column:
        return F.concat(*[values[p[1:-1]] if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p])

    body = F.when(fail, mail(NOTIFY_FAILURE_MAIL)).otherwise(mail(NOTIFY_ACTION_MAIL))
    return (results.withColumn("route", r).filter(F.col("route") != "none")
            .select("alert_id", "route",
                    F.concat(F.col("llm_classification"), F.lit(" Alert - "), F.col("alert_id")).alias("subject"),
                    body.alias("body")))
