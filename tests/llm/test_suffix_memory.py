"""What a worker of op3 holds at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from alertspark.llm import suffix_dedup


def batch(n, size):
    rnd = random.Random(4)
    texts = [rnd.randbytes(size // 2).hex() for _ in range(n)]
    places = np.arange(0, size - suffix_dedup.ANCHOR_BYTES, 60)
    anchors = np.stack([places, places], 1).tobytes()
    return pa.record_batch({"text": texts, "tid": np.arange(n), "anchors": pa.array([anchors] * n, pa.binary())})


@pytest.mark.parametrize("step", [suffix_dedup._anchors, suffix_dedup._phrases])
def test_a_worker_holds_little_of_a_batch(step):
    b = batch(1500, 2000)
    list(step([b.slice(0, 10)]))  # tables made once
    tracemalloc.start()
    try:
        rows = sum(map(len, step([b])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 10_000 and peak < 120e6


@pytest.mark.parametrize("need", [4, 500])
def test_suffixes_rank_as_in_a_plain_sort(spark, need):
    rnd = random.Random(6)
    seqs = [[rnd.randint(-2, 2) for _ in range(rnd.randint(1, 60))] for _ in range(12)] + [[1] * 90, [1] * 40, [1, 2] * 30]
    rows = spark.createDataFrame([(s, x, c) for s, q in enumerate(seqs) for x, c in enumerate(q)], "s long, x long, sym long").repartition(5)
    ranks, _ = suffix_dedup.suffix_ranks(rows, need)
    got = sorted((r.rank, r.s, r.x) for r in ranks.collect())
    assert len(got) == sum(map(len, seqs))
    suffix = [(seqs[s][x:] + [-9])[:need] for _, s, x in got]
    assert suffix == sorted(suffix)
    # Of n equal ones, all ranks lie within n places.
    lo = {}
    for i, ((rank, _, _), key) in enumerate(zip(got, map(tuple, suffix))):
        lo.setdefault(key, [i + 1, 0])[1] += 1
        assert lo[key][0] <= rank
    assert all(rank < lo[key][0] + lo[key][1] for (rank, _, _), key in zip(got, map(tuple, suffix)))


def test_digests_of_neighbouring_starts_travel_together():
    text = random.Random(8).randbytes(3000).hex().encode()
    buf = suffix_dedup.Buffer([text])
    p, h = buf.anchors()
    starts = len(text) - suffix_dedup.LENGTH + 1
    b = pa.record_batch({
        "text": [text.decode()], "tid": np.array([7]), "anchors": pa.array([np.stack([p, h.view(np.int64)], 1).tobytes()], pa.binary()),
        "sure": pa.array([b""], pa.binary()), "open": pa.array([np.array([0, starts], np.int32).tobytes()], pa.binary()),
        "asked": pa.array([h.view(np.int64).tolist()], pa.list_(pa.int64()))})
    rows = [r for out in suffix_dedup._send(10_000)(iter([b])) for r in out.to_pylist()]
    at = sorted(i for r in rows for i in np.frombuffer(r["i"], np.int32).tolist())
    assert len(at) > 5000 and len(set(at)) == len(at)
    assert len({r["bin"] for r in rows}) < len(at) / 30
