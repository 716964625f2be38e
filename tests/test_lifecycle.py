"""J12 from data; T3 that survives a failed cycle; T4 / O4 timers."""

import datetime as dt
import json
import os
import time

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from alertspark.operators import enrich, playbooks, state, triage
from alertspark.sources import reference
from alertspark.sources.alerts import load_alerts
from alertspark.streaming import pipelines, recovery


def with_playbooks(spark, more):
    """The reference dimensions, with playbooks added to the document."""
    raw = reference.read_reference_raw(spark)
    docs = {r.reference_type: json.loads(r.data) for r in raw.collect()}
    docs["playbooks"].update(more)
    rows = [(k, json.dumps(v)) for k, v in docs.items()]
    df = spark.createDataFrame(rows, "reference_type string, data string")
    return {"playbooks": reference.playbooks(df), "approved": reference.approved_endpoints(df)}


def test_a_playbook_added_to_the_document_matches(spark):
    match = {"event_count": ">=5", "src": "internal", "protocol": ["DNS", "UDP"], "window": "5m", "patterns": ["UNION  SELECT", "failed"]}
    ref = with_playbooks(spark, {"sixth": {"severity": "Low", "match": {k: v for k, v in match.items() if k != "patterns"}, "actions": ["a", "b"]},
                                 "seventh": {"severity": "Low", "match": {"patterns": ["information_schema", "union select"], "severity": "Low"}, "actions": []},
                                 "never": {"severity": "Low", "match": {}, "actions": []}})
    alerts = load_alerts(spark, SF_SMALL)
    got = {r.alert_id: set(r.matched_playbooks) for r in enrich.match_playbooks(alerts, ref).collect()}
    plain = enrich.classify_cols(alerts)
    sixth = {r.alert_id for r in plain.where("event_count >= 5 AND source_type LIKE 'Internal %' AND protocol IN ('DNS', 'UDP') AND time_window IN ('30s', '60s', '5m')").collect()}
    seventh = {r.alert_id for r in alerts.where("sample_logs LIKE '%UNION SELECT%' AND severity = 'Low'").collect()}
    assert sixth and {i for i, m in got.items() if "sixth" in m} == sixth
    assert seventh and {i for i, m in got.items() if "seventh" in m} == seventh
    assert not any("never" in m for m in got.values())


def test_thresholds_and_unknown_keys(spark):
    df = spark.createDataFrame([(19,), (20,), (21,), (None,)], "n int")
    hits = lambda t: [r.n for r in df.where(F.coalesce(playbooks.threshold(F.col("n"), t), F.lit(False))).collect()]
    assert (hits(">20"), hits(">=20"), hits("<20"), hits("<=20"), hits("20"), hits("= 20"), hits("many")) == ([21], [20, 21], [19], [19, 20], [20], [20], [])
    assert playbooks.phrase_regex(["OR 1=1"]) == r"(?i)(OR\s+1\s*=\s*1)"
    with pytest.raises(ValueError, match="moon"):
        playbooks.compile_rule("x", '{"moon": "full"}')


def test_a_poisoned_batch_is_set_aside_and_paroled(spark, tmp_path):
    src, log, dead, ck = (str(tmp_path / x) for x in ("src", "log", "dead", "ck"))
    rows = load_alerts(spark, SF_SMALL).drop("direction").where("analysis_status <> 'Processing'")
    ids = [r.alert_id for r in rows.where("analysis_status = 'Pending'").orderBy("alert_id").limit(3).collect()]
    poison = [True]

    def scorer(features):
        v = triage.rule_verdict(features)
        bad = F.col("alert_id") == ids[1]
        return v.withColumn("llm_reason", F.when(bad, F.raise_error(F.lit("poison")).cast("string")).otherwise(F.col("llm_reason"))) if poison[0] else v

    def run():
        s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = pipelines.start_cycle(s, log, checkpoint=ck, trigger={"availableNow": True}, dead_letter_path=dead, attempts=2, scorer=scorer)
        q.awaitTermination(240)
        assert q.exception() is None

    for i in ids:
        rows.where(F.col("alert_id") == i).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by their time
    run()
    events = lambda: {(r.alert_id, r.kind) for r in spark.read.schema(pipelines.LOG_SCHEMA).parquet(log).collect()}
    assert {i for i, k in events() if k == "verdict"} == {ids[0], ids[2]} and ids[1] not in {i for i, _ in events()}
    letters = spark.read.schema(pipelines.DEAD_LETTER_SCHEMA).parquet(dead).collect()
    assert [(r.alert_id, r.attempts) for r in letters] == [(ids[1], 2)] and letters[0].error
    # Parole: the next cycle claims it.
    poison[0] = False
    pipelines.parole(spark, log, dead, letters[0].batch_id)
    rows.where("analysis_status = 'Processed'").limit(1).coalesce(1).write.mode("append").parquet(src)
    run()
    assert (ids[1], "verdict") in events()
    assert spark.read.schema(pipelines.DEAD_LETTER_SCHEMA).parquet(dead).count() == 0
    left = [d for d in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if d.startswith("cycle-results")]
    assert not left


def test_a_replay_with_fewer_rows_leaves_nothing_stale(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "alert_id string, kind string")
    pipelines._write_batch(df, path, 3, ("kind",))
    pipelines._write_batch(df.where("alert_id = 'a'"), path, 3, ("kind",))
    assert [r.alert_id for r in spark.read.parquet(path).collect()] == ["a"]
    pipelines._write_batch(df.where("false"), path, 3, ("kind",))
    assert not os.path.exists(f"{path}/batch_id=3")


def test_a_stuck_claim_comes_back_and_is_claimed_again(spark, tmp_path):
    log, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    alerts = load_alerts(spark, SF_SMALL).drop("direction").where("analysis_status = 'Pending'").orderBy("alert_id").limit(3).cache()
    ids = [r.alert_id for r in alerts.orderBy("alert_id").collect()]
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    def write(batch, kind, when, only, **cols):
        e = state.status_events(alerts.where(F.col("alert_id").isin(only)), kind, cols.get("status", "Processing"), when, batch * 10 + 1)
        pipelines._write_batch(e, log, batch, ("kind",), (f"kind={kind}",))

    pipelines._write_batch(state.inserted_events(alerts), log, 0, ("kind",), ("kind=inserted",))
    old, fresh = now - dt.timedelta(hours=2), now + dt.timedelta(hours=1)
    write(1, "claimed", old, ids[:2])  # two old claims, of which one has its verdict
    write(2, "verdict", old + dt.timedelta(minutes=1), ids[1:2], status="Processed")
    write(3, "claimed", fresh, ids[2:])  # not due for long

    def recovered():
        r = spark.read.schema(pipelines.LOG_SCHEMA).parquet(log).where("kind = 'recovered'")
        return [x.alert_id for x in r.collect()]

    def until(n, query):
        end = time.time() + 90
        while len(recovered()) < n and time.time() < end and query.isActive:
            time.sleep(1)
        time.sleep(2)
        query.stop()
        assert query.exception() is None

    until(1, recovery.start_recovery(spark, log, 5, ck))
    assert recovered() == ids[:1]
    fold = lambda: state.fold(spark.read.schema(pipelines.LOG_SCHEMA).parquet(log).drop("batch_id"))
    status = {r.alert_id: r.analysis_status for r in fold().collect()}
    assert status == {ids[0]: "Pending", ids[1]: "Processed", ids[2]: "Processing"}
    assert [r.alert_id for r in state.claim(fold(), 1).collect()] == ids[:1]
    # It is claimed again while the query is down: the restart finds it stuck once more.
    write(4, "claimed", dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), ids[:1])
    until(2, recovery.start_recovery(spark, log, 5, ck))
    assert recovered() == [ids[0], ids[0]]
    assert {r.alert_id: r.analysis_status for r in fold().collect()}[ids[0]] == "Pending"
