"""Streaming forms equal their batch forms."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from alertspark.operators.ingest import ingest_alerts, submissions_from_alerts
from alertspark.operators.state import fold, inserted_events
from alertspark.sources.alerts import load_alerts
from alertspark.streaming import pipelines as P
from paths import SF_SMALL


def _payload_dir(spark, n_files=3):
    d = tempfile.mkdtemp(prefix="alertspark-stream-")
    rows = [r.payload for r in submissions_from_alerts(load_alerts(spark, SF_SMALL)).collect()]
    rows += ['{"alert_id": "BAD-1"}', "{broken"]
    for i in range(n_files):
        with open(os.path.join(d, f"part-{i}.json"), "w") as fh:
            for p in rows[i::n_files]:
                fh.write(json.dumps({"payload": p}) + "\n")
    return d, len(rows)


def test_stream_ingest_equals_batch(spark):
    src, n = _payload_dir(spark)
    out = tempfile.mkdtemp(prefix="alertspark-sink-")
    q = P.start_ingest(P.read_payload_stream(spark, src, max_files=1), f"{out}/valid", f"{out}/rejected",
                       checkpoint=f"{out}/ckpt")
    q.awaitTermination(300)
    valid = spark.read.parquet(f"{out}/valid")
    rejected = spark.read.parquet(f"{out}/rejected")
    bv, br = ingest_alerts(spark.read.schema("payload string").json(src))
    assert valid.count() + rejected.count() == n
    assert sorted(r.alert_id for r in valid.select("alert_id").collect()) == \
        sorted(r.alert_id for r in bv.select("alert_id").collect())
    assert rejected.count() == br.count()
    assert valid.select("batch_id").distinct().count() == 3


def test_dedup_stream(spark):
    src, _ = _payload_dir(spark, 1)
    stream = P.read_payload_stream(spark, src)
    parsed = stream.select(F.get_json_object("payload", "$.alert_id").alias("alert_id"),
                           F.get_json_object("payload", "$.alert_time").cast("timestamp").alias("alert_time"))
    doubled = parsed.unionByName(parsed)
    q = (P.dedup_stream(doubled).writeStream.format("memory").queryName("dedup_t")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT alert_id FROM dedup_t")
    # the two broken payloads give one named and one null id
    assert got.count() == got.distinct().count() == load_alerts(spark, SF_SMALL).count() + 2


def test_dedup_stream_keeps_late_alerts(spark):
    src = tempfile.mkdtemp(prefix="alertspark-late-")
    # Late by hours: a first alert, then an id from before the watermark again.
    for i, rows in enumerate(([("A", "10:00")], [("B", "20:00")], [("C", "01:00")], [("A", "20:30"), ("D", "20:30")])):
        path = os.path.join(src, f"part-{i}.json")
        with open(path, "w") as fh:
            fh.writelines(json.dumps({"alert_id": a, "alert_time": f"2024-01-01 {t}:00"}) + "\n" for a, t in rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("alert_id string, alert_time timestamp").option("maxFilesPerTrigger", 1).json(src)
    q = P.dedup_stream(stream).writeStream.format("memory").queryName("late_t").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(r.alert_id for r in spark.sql("SELECT alert_id FROM late_t").collect()) == ["A", "B", "C", "D"]


def test_lifecycle_stream_equals_batch_fold(spark):
    a = load_alerts(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="alertspark-log-")
    inserted_events(a).write.mode("overwrite").parquet(d)
    stream = spark.readStream.schema(spark.read.parquet(d).schema).parquet(d)
    q = (P.lifecycle_state(stream).writeStream.outputMode("complete").format("memory")
         .queryName("life_t").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT alert_id, analysis_status FROM life_t")
    want = fold(spark.read.parquet(d)).select("alert_id", "analysis_status")
    assert sorted(got.collect()) == sorted(want.collect())


def test_threshold_windows_batch(spark):
    a = load_alerts(spark, SF_SMALL)
    ports, volume = P.threshold_windows(a)
    p, v = P.threshold_flags(ports, volume)
    assert p.count() > 0 and v.count() > 0
    # every alert falls in exactly two sliding windows (60 s window, 30 s slide)
    assert v.agg(F.sum("alerts")).first()[0] == 2 * a.filter(F.col("alert_time").isNotNull()).count()


def test_stream_cycle_appends_claim_and_verdict_events(spark):
    from alertspark.streaming.pipelines import LOG_SCHEMA

    a = load_alerts(spark, SF_SMALL).drop("direction")
    src = tempfile.mkdtemp(prefix="alertspark-alerts-")
    a.filter("analysis_status = 'Pending'").limit(40).write.mode("overwrite").parquet(src)
    log = tempfile.mkdtemp(prefix="alertspark-eventlog-")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = P.start_cycle(stream, log, checkpoint=f"{log}-ckpt", trigger={"availableNow": True}, notifications_path=f"{log}-mails")
    q.awaitTermination(600)
    assert q.exception() is None
    events = spark.read.schema(LOG_SCHEMA).parquet(log)
    kinds = {r.kind: r.n for r in events.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["inserted"] == 40 and kinds["claimed"] == 40 and kinds["verdict"] == 40
    cur = fold(events.drop("batch_id"))
    assert {r.analysis_status for r in cur.collect()} == {"Processed"}
    assert kinds["ti_updated"] == 40
    mails = spark.read.parquet(f"{log}-mails")
    assert 0 < mails.count() <= 40 and mails.count() == mails.select("alert_id").distinct().count()


def test_stream_ingest_keeps_the_first_of_an_id(spark):
    src, _ = _payload_dir(spark, 1)
    with open(os.path.join(src, "part-0.json")) as fh:
        line = fh.readline()
    for name in ("part-1.json", "part-2.json"):
        with open(os.path.join(src, name), "w") as fh:
            fh.write(line * 2)
    out = tempfile.mkdtemp(prefix="alertspark-sink-")
    q = P.start_ingest(P.read_payload_stream(spark, src, max_files=1), f"{out}/valid", f"{out}/rejected", checkpoint=f"{out}/ckpt")
    q.awaitTermination(300)
    valid = spark.read.parquet(f"{out}/valid")
    once = ingest_alerts(spark.read.schema("payload string").json(f"{src}/part-0.json"))[0]
    assert valid.count() == valid.select("alert_id").distinct().count() == once.count()
    assert spark.read.parquet(f"{out}/rejected").where("reasons[0] = 'alert_id already exists'").count() == 4


def test_stuck_alerts_go_by_their_claim(spark):
    log = spark.createDataFrame([("A", "2024-01-01 00:00:00", 0, "Pending"), ("A", "2024-01-01 09:58:00", 1, "Processing"),
                                 ("B", "2024-01-01 00:00:00", 1, "Processing"), ("C", "2024-01-01 01:00:00", 1, "Processing"),
                                 ("C", "2024-01-01 02:00:00", 2, "Processed")],
                                "alert_id string, event_ts string, seq long, analysis_status string").withColumn(
        "event_ts", F.col("event_ts").cast("timestamp_ntz"))
    assert [r.alert_id for r in P.stuck_alerts(log, "2024-01-01 10:00:00").collect()] == ["B"]
