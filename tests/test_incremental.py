"""State that is kept equals the fold of the whole log; boards follow; ids are guarded by an index."""
import random

from paths import SF_SMALL
from pyspark.sql import functions as F

from alertspark.functions.ip import with_direction
from alertspark.operators import monitor, state
from alertspark.plans.cycle import run_cycle
from alertspark.sources.alerts import load_alerts
from alertspark.streaming import incremental, pipelines
from alertspark.streaming.keyed import KeyedTable, summed


def rows(df):
    return sorted(map(str, df.collect()))


def test_keyed_table_equals_the_sum_of_all_batches(spark, tmp_path):
    rng, want = random.Random(5), {}
    merge = summed(["k"], {"n": "bigint"})
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "k string, n bigint", merge, target_rows=40, compact_every=3)
    for b in range(14):
        part = [(f"k{rng.randrange(20 * (b + 1))}" if rng.random() > 0.05 else None, rng.choice([-1, 1, 2])) for _ in range(30)]
        table.compact(b)
        table.append(spark.createDataFrame([("gone", 9)], "k string, n bigint"), b)  # an attempt that failed
        table.append(spark.createDataFrame(part, "k string, n bigint"), b)
        for k, n in part:
            want[k] = want.get(k, 0) + n
    assert {r.k: r.n for r in table.read(14).collect()} == {k: n for k, n in want.items() if n}
    keys = spark.createDataFrame([("k3",), (None,), ("absent",)], "k string")
    assert {r.k: r.n for r in table.read(14, keys).collect()} == {k: want[k] for k in ("k3", None) if want.get(k)}
    last, bits = table._versions()[-1]
    assert bits >= 2 and len(table._versions()) <= 2 and len(table._deltas(-1, 99)) <= 2 * 3 + 1
    # One key's read touches one bucket and the deltas since.
    one = table.read(14, spark.createDataFrame([("k3",)], "k string")).inputFiles()
    assert len({f for f in one if "/snapshot/" in f}) == 1
    assert len({f for f in table.read(14).inputFiles() if "/snapshot/" in f}) >= 4


def test_kept_parts_equal_the_fold_in_any_order(spark, tmp_path):
    a = load_alerts(spark, SF_SMALL).limit(60).cache()
    some = a.where("analysis_status = 'Pending'")
    log = state.union_events(
        state.inserted_events(a), state.inserted_events(a.limit(9).withColumn("alert_name", F.lit("again"))).withColumn("seq", F.lit(7).cast("long")),
        state.status_events(some, "claimed", "Processing", "2024-02-01 00:00:00", 11),
        state.ti_events(some.withColumn("threat_intelligence", F.lit("{}")), "2024-02-01 00:00:00", 12),
        state.status_events(a.where("alert_id > 'ALT-100020'"), "recovered", "Pending", "2024-02-02 00:00:00", 21)).withColumn(
        "_batch", F.pmod(F.xxhash64("alert_id", "kind", "seq"), F.lit(5))).cache()
    kept = incremental.CycleState(spark, str(tmp_path / "s"), target_rows=16, compact_every=2)
    for b in range(5):
        kept.alerts.compact(b)
        kept.alerts.append(state.partials(log.where(F.col("_batch") == b)), b)
    want = rows(state.fold(log.drop("_batch")))
    assert len(want) == 60 and rows(state.finish(kept.alerts.read(5))) == want


def test_incremental_cycle_equals_the_cycle_over_the_whole_log(spark, tmp_path):
    every = load_alerts(spark, SF_SMALL).drop("direction")
    done = every.where("analysis_status = 'Processed'").orderBy("alert_id").limit(30)
    waiting = every.where("analysis_status = 'Pending'").orderBy("alert_id").limit(24).withColumn("_r", F.substring("alert_id", 5, 9).cast("long"))
    batches = [done.unionByName(waiting.where("_r % 7 < 2").drop("_r")), waiting.where("_r % 7 BETWEEN 2 AND 4").drop("_r"),
               # An alert that was done comes in once more and is open again.
               waiting.where("_r % 7 > 4").drop("_r").unionByName(done.limit(2).withColumns(
                   {"analysis_status": F.lit("Pending"), "created_at": F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")}))]
    kept = incremental.CycleState(spark, str(tmp_path / "state"), target_rows=16, compact_every=2)
    log, folded, total = None, None, None
    for b, batch in enumerate(batches):
        inserted = state.inserted_events(batch).withColumn("seq", F.lit(b * 10).cast("long"))
        now = state.ts_lit(f"2031-01-0{b + 1} 00:00:00")
        for _ in range(2 if b == 1 else 1):  # the second batch is run again
            added, board, _ = incremental.step(kept, inserted, b, now)
        log = inserted if log is None else state.union_events(log, inserted)
        # The same cycle over the fold of the whole log.
        current = with_direction(state.fold(log))
        out = run_cycle(spark, current)
        res, ti = out["results"], out["features"].select("alert_id", "threat_intelligence")
        events = [state.status_events(res, "claimed", "Processing", now, b * 10 + 1), state.ti_events(ti, now, b * 10 + 2), state.verdict_events(res, now, b * 10 + 3)]
        path = str(tmp_path / f"log{b}")
        state.union_events(log, *events).write.parquet(path)
        log = spark.read.parquet(path)
        folded = with_direction(state.fold(log))
        assert rows(state.finish(kept.alerts.read(b + 1))) == rows(folded.drop("direction"))
        total = board if total is None else total.unionByName(board)
        tmp = str(tmp_path / f"board{b}")
        total.write.parquet(tmp)
        total = spark.read.parquet(tmp)
        assert rows(incremental.status_board(total)) == rows(monitor.status_board(folded))
    counts = kept.board.read(len(batches))
    assert rows(incremental.status_board(counts)) == rows(monitor.status_board(folded))
    assert rows(incremental.detected_threats(counts)) == rows(incremental.detected_threats(total)) == rows(monitor.detected_threats(folded))
    assert folded.where("analysis_status = 'Processed'").count() == 54
    assert total.where("n < 0").count() > 0
    assert kept.open_alerts(9).count() == 0


def test_incremental_stream(spark, tmp_path):
    src, log, st = (str(tmp_path / x) for x in ("src", "log", "state"))
    pending = load_alerts(spark, SF_SMALL).drop("direction").where("analysis_status = 'Pending'").orderBy("alert_id").limit(5)
    stuck = load_alerts(spark, SF_SMALL).drop("direction").where("analysis_status = 'Processing'").orderBy("alert_id").limit(1)
    pending.coalesce(1).write.parquet(src)

    def run():
        s = spark.readStream.schema(pending.schema).parquet(src)
        q = incremental.start_incremental_cycle(s, log, st, checkpoint=f"{st}-ck", trigger={"availableNow": True},
                                                changes_path=f"{st}-changes", notifications_path=f"{st}-mails", recover_after=60)
        q.awaitTermination(240)
        assert q.exception() is None

    run()
    stuck.coalesce(1).write.mode("append").parquet(src)
    run()  # something is in flight: the gate is shut
    pending.limit(1).withColumn("alert_id", F.lit("ALT-x")).coalesce(1).write.mode("append").parquet(src)
    run()  # its claim is long past the limit: it comes back and both are claimed
    events = spark.read.schema(pipelines.LOG_SCHEMA).parquet(log)
    kinds = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
    assert kinds == {"inserted": 7, "recovered": 1, "claimed": 7, "ti_updated": 7, "verdict": 7}
    assert {r.analysis_status for r in state.fold(events.drop("batch_id")).collect()} == {"Processed"}
    board = incremental.status_board(spark.read.parquet(f"{st}-changes").drop("batch_id"))
    assert rows(board) == rows(monitor.status_board(state.fold(events.drop("batch_id"))))
    assert spark.read.parquet(f"{st}-mails").count() > 0


def test_ids_are_guarded_by_the_index(spark, tmp_path):
    import json
    import os
    import time

    from alertspark.operators.ingest import ingest_alerts, primary_key_guard, submissions_from_alerts

    lines = [json.dumps({"payload": r.payload}) for r in submissions_from_alerts(load_alerts(spark, SF_SMALL)).limit(60).collect()]
    good = ingest_alerts(spark.createDataFrame([(json.loads(x)["payload"],) for x in lines], "payload string"))[0]
    good = {r.alert_id for r in good.select("alert_id").collect()}
    lines = [x for x in lines if json.loads(json.loads(x)["payload"])["alert_id"] in good][:40]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    os.makedirs(src)

    def run(number, part, **kw):
        path = os.path.join(src, f"p{number}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(part) + "\n")
        os.utime(path, (time.time() + number, time.time() + number))
        q = pipelines.start_ingest(pipelines.read_payload_stream(spark, src), f"{out}/valid", f"{out}/rejected", checkpoint=f"{out}/ck",
                                   target_rows=8, compact_every=2, **kw)
        q.awaitTermination(200)
        assert q.exception() is None

    sent = 0
    for i, part in enumerate((lines[:20], lines[15:20] * 2 + lines[20:30], lines[:1] + lines[30:])):
        run(i, part)
        sent += len(part)
    valid, rejected = spark.read.parquet(f"{out}/valid"), spark.read.parquet(f"{out}/rejected")
    assert valid.count() == valid.select("alert_id").distinct().count() == len(lines) and rejected.count() == sent - len(lines)
    index = pipelines.id_index(spark, f"{out}/valid-ids")
    assert index.read(9).count() == len(lines) and index._versions()
    # The guard alone: every row is accepted or a duplicate.
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("b", 1), ("c", 1)], "alert_id string, alert_time int")
    ok, dup = primary_key_guard(batch, spark.createDataFrame([("b",), ("b",)], "alert_id string"))
    assert rows(ok) == rows(batch.where("alert_id = 'c'").unionByName(spark.createDataFrame([("a", 1)], batch.schema))) and dup.count() == 3


def test_dedup_with_rejects(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 1)], "alert_id string, alert_time int")

    def run():
        s = spark.readStream.schema(df.schema).parquet(src)
        pipelines.dedup_with_rejects(s, f"{out}/ok", f"{out}/no", f"{out}/ids", f"{out}/ck").awaitTermination(120)

    df.coalesce(1).write.parquet(src)
    run()
    df.where("alert_id IS NULL OR alert_id = 'b'").unionByName(spark.createDataFrame([("c", 0)], df.schema)).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(spark.read.parquet(f"{out}/ok").drop("batch_id")) == rows(spark.createDataFrame([("a", 1), (None, 1), ("b", 1), ("c", 0)], df.schema))
    assert spark.read.parquet(f"{out}/no").count() == 5
