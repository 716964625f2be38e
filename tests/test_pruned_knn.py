"""J7 by cells and bounds: the same rows as brute force, with few copies of the KB."""
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertspark.operators import similarity
from alertspark.operators.similarity import _deal, _scored, _sides, knn


def _frame(spark, mat, name):
    return spark.createDataFrame([(f"{name}{i:04d}", [float(x) for x in v]) for i, v in enumerate(mat)], f"id string, embedding array<{'double'}>")


def _want(q, b, k, same=False):
    out = []
    for i, v in enumerate(q):
        d = ((b - v) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(b)), d)) if not (same and i == j)][:k]
        out += [(i, j, r + 1) for r, j in enumerate(order)]
    return sorted((int(i), int(j), r) for i, j, r in out)


def _got(hits):
    return sorted((int(r.query_id[1:]), int(r.id[1:]), r["rank"]) for r in hits.collect())


@pytest.mark.parametrize("spread,offset", [(0.01, 0.0), (0.01, 1e4), (1.0, 0.0)])
def test_cells_give_what_brute_force_gives(spark, spread, offset):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) + offset
    q = centres[rng.integers(0, 6, 150)] + spread * rng.normal(size=(150, 8))
    b = centres[rng.integers(0, 6, 400)] + spread * rng.normal(size=(400, 8))
    b[40:60] = b[0]
    qs, bs = _frame(spark, q, "q"), _frame(spark, b, "b")
    hits = knn(qs, bs, k=3, query_id="id", group_bytes=8 * 8 * 20, tile_bytes=8 * 20 * 30)
    assert _got(hits) == _want(q, b, 3)


def test_vectors_go_where_they_can_matter(spark):
    rng = np.random.default_rng(6)
    centres = 10 * rng.normal(size=(10, 8))
    q = centres[np.arange(200) % 10] + 0.01 * rng.normal(size=(200, 8))
    b = centres[np.arange(500) % 10] + 0.01 * rng.normal(size=(500, 8))
    sides = _sides(_frame(spark, q, "q"), _frame(spark, b, "b"), "id", "embedding", "id", "embedding")
    rows, tiles, blocks = _deal(*sides, 3, False, 8 * 8 * 20)
    assert tiles // blocks >= 10
    assert rows.where("side = 1").count() < 2 * 500  # 10 groups or more would take 5,000


def test_own_id_repeated_rows_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_TILE_BYTES", 512)
    rng = np.random.default_rng(7)
    m = rng.normal(size=(60, 4)) * 0.01 + np.repeat(np.eye(4), 15, axis=0)
    e = _frame(spark, m, "v")
    for group_bytes in (1 << 20, 8 * 4 * 15):
        assert _got(knn(e, e, k=4, query_id="id", exclude_self=True, group_bytes=group_bytes)) == _want(m, m, 4, True)
        twice = e.union(e.where("id = 'v0003'")).union(spark.createDataFrame([("v9999", None), (None, [0.0] * 4)], e.schema))
        hits = knn(twice, e, k=2, query_id="id", group_bytes=group_bytes)
        assert hits.where("query_id = 'v0003'").count() == 4 and hits.where("query_id is null").count() == 2
        assert hits.where("query_id = 'v9999'").count() == 0 and hits.count() == 2 * 62
        # A KB with the own id many times over, and one smaller than k.
        kb = e.where("id = 'v0003'").union(e).union(e.where("id = 'v0003'"))
        assert knn(e, kb, k=1, query_id="id", exclude_self=True, group_bytes=group_bytes).where("query_id = id").count() == 0
        assert knn(e, e.limit(2), k=3, query_id="id", group_bytes=group_bytes).groupBy("query_id").count().where("count != 2").count() == 0
        assert knn(e, e.limit(0), k=3, query_id="id", group_bytes=group_bytes).count() == 0
        assert knn(e.limit(0), e, k=3, query_id="id", group_bytes=group_bytes).count() == 0
        assert knn(e, e.withColumn("embedding", F.col("embedding").cast("array<float>")), k=1, query_id="id", group_bytes=group_bytes).count() == 60


def _tiles(ids, q, b):
    """A task's input: its queries, then the KB by id."""
    for side, mat in ((0, q), (1, b)):
        for a in range(0, len(mat), 1000):
            part = mat[a:a + 1000]
            yield pd.DataFrame({"g": 0, "side": side, "id": ids[a:a + len(part)], "vec": list(part), "vec_key": np.arange(a, a + len(part)), "copies": 1})


def test_a_tile_costs_little_more_than_its_product():
    rng = np.random.default_rng(8)
    b = rng.normal(size=(12000, 64))
    q, ids = b[:4000], np.array([f"v{i:05d}" for i in range(len(b))], dtype=object)
    t = time.process_time()
    for a in range(0, len(b), 1000):
        near = ((b[a:a + 1000] ** 2).sum(axis=1) - 2.0 * (q @ b[a:a + 1000].T)).min()
    bare = time.process_time() - t
    t = time.process_time()
    got = pd.concat(_scored(10, True, similarity.TILE_BYTES)(_tiles(ids, q, b)))
    spent = time.process_time() - t
    assert np.isfinite(near) and len(got) == 40000 and spent < 4 * bare + 1.0
    d = ((b - q[17]) ** 2).sum(axis=1)
    assert got[got["query_id"] == ids[17]]["id"].tolist() == [ids[i] for i in np.lexsort((ids, d)) if i != 17][:10]


@pytest.mark.parametrize("tile_bytes", [8, 8 * 60, 1 << 20])
def test_equal_distances_repeated_and_null_ids_in_a_tile(tile_bytes):
    b = np.repeat(np.eye(3), 10, axis=0)
    ids = np.array([f"v{i // 2:02d}" for i in range(29)] + [None], dtype=object)
    got = pd.concat(_scored(4, True, tile_bytes)(_tiles(ids, b, b)))
    for key, rows in got.groupby("vec_key"):
        d = ((b - b[key]) ** 2).sum(axis=1)
        assert rows["id"].tolist() == [ids[i] for i in np.lexsort((np.arange(30), d)) if ids[i] != ids[key]][:4]
        assert rows["rank"].tolist() == [1, 2, 3, 4]


def test_copies_of_both_sides_are_balanced(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_TILE_BYTES", 64)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rng = np.random.default_rng(9)
        e = _frame(spark, rng.normal(size=(120, 8)), "v")
        sides = _sides(e, e, "id", "embedding", "id", "embedding")
        for group_bytes in (1 << 20, 8 * 8 * 60):  # all queries in a task, and half of them
            rows, tiles, blocks = _deal(*sides, 3, True, group_bytes)
            # 120 vectors in 2 groups and 100 blocks would be 102 copies of each.
            assert tiles >= 32 and rows.count() <= 16 * 120
            assert _got(knn(e, e, k=3, query_id="id", exclude_self=True, group_bytes=group_bytes)) == _want(*[np.array([r.embedding for r in e.orderBy("id").collect()])] * 2, 3, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
