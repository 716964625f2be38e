"""op12 against all scores."""

import math
import random

import numpy as np
import pytest

from alertspark.llm import hard_negatives as hn


def brute(rows, every=50):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) > hn.LIMIT for x in v):
            continue
        r = (math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        seen[i] = min(seen.get(i, r), r)
    out = []
    for a, (la, va) in seen.items():
        if a % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(va, v)), i, label == la) for i, (label, v) in seen.items() if i != a)
        for s, p, _ in [x for x in score if x[2]][:5]:
            ok = [(n, -t) for t, n, same in score if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k, n, -s, t) for k, (n, t) in enumerate(ok, 1)]
    return sorted(out)


COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def check(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS score", "'x' AS w", "2 AS block").repartition(3)
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = sorted(tuple(r[c] for c in COLS) for r in hn.hard_negatives(df).collect())
    assert got == brute(rows)
    return got


@pytest.fixture
def small(monkeypatch):
    """Blocks, groups, nets and batches so small that a few hundred rows fill many."""
    for name, value in (("BLOCK", 32), ("GROUP_BLOCKS", 2), ("NODES", 8), ("BATCH", 4), ("CENTRES", 6)):
        monkeypatch.setattr(hn, name, value)


def test_random_and_clustered_vectors(spark, small):
    rng = random.Random(1)
    flat = [(i, [rng.gauss(0, 0.2) for _ in range(6)], rng.randrange(10)) for i in range(400)]
    assert check(spark, flat)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    close = [(i, [x + rng.gauss(0, 0.05) for x in middles[i % 5]], rng.randrange(3)) for i in range(600)]
    assert check(spark, close)


def test_odd_rows(spark, small):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-2, 3)) / 4 for _ in range(3)], rng.randrange(3)) for i in range(-100, 200)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1050, [1.0, 1.0, 1.0], None), (1100, [float("nan"), 1.0, 1.0], 1), (1150, [1.0, None, 1.0], 2),
             (1200, [float("inf"), 1.0, 1.0], 1), (1250, [1.0], 1), (1300, [], 1), (1350, [1e30, 0.0, 0.0], 1)]
    rows += rows[:120] + [(50, [0.25, 0.25, 0.25], 1), (100, [0.5, 0.5, 0.5], 0)]  # repeated rows, and ids of different rows
    check(spark, rows)
    check(spark, rows, "double")


def test_a_third_of_equal_vectors(spark, small):
    rng = random.Random(3)
    check(spark, [(i, [0.5, 0.5] if i % 3 == 0 else [rng.random(), rng.random()], rng.randrange(10)) for i in range(500)])
    check(spark, [(i, [0.0, 0.0], i % 2) for i in range(120)])


def test_scores_beyond_doubles_are_exact(spark, small):
    rng = random.Random(4)
    check(spark, [(i, [rng.choice([2.0e5, -1.9e5, 1.0, 3.0e4 + rng.random()]) for _ in range(8)], rng.randrange(3)) for i in range(150)], "double")


def test_empty_table_and_no_anchor(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hn.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)], kind)).count() == 0


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(5)
    v = np.rint(np.concatenate([rng.normal(m, 5, (100, 4)) for m in (-300, 0, 300)])).astype(np.int64)
    top = float((v * v).sum(1).max())
    tree = hn.Tree(v.astype(float), top)
    q = np.rint(rng.normal(0, 200, (20, 4)))
    scores = q @ v.T
    own = tree.leaf
    for m, parent, radius in reversed(tree.levels):
        low, high = hn.score_bounds(q @ v[tree.order[:m]].T, radius, np.sqrt((q * q).sum(1)), top)
        assert (scores >= low[:, own]).all() and (scores <= high[:, own]).all()
        own = parent[own]
    # A window about one cluster's scores leaves the others' nodes out.
    class Counting(hn.Block):
        rows = 0

        def scores(self, q, rows):
            Counting.rows += len(rows)
            return super().scores(q, rows)

    one = np.array([[300, 300, 300, 300]])
    s = hn.Search(np.array([-1]), np.array([0]), one, np.array([[300_000]]), np.array([[400_000]]), 3, True, top)
    s.run([Counting(np.arange(300), np.zeros(300, np.int64), v, tree)])
    assert len(s.best) == 3 and Counting.rows <= 110
