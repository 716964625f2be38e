"""Hard negatives by a cover tree over norm-augmented candidates.

Components become whole numbers, so scores (inner products) are exact. A further component
brings every candidate x to the same length M: x^ = (x, sqrt(M^2 - |x|^2)). For an
anchor q = (q, 0) the score is then |q| M cos(angle), and all candidates within a distance r
of a node c have an angle within 2 asin(r / 2M) of c's, which bounds their scores from both sides.

The index. Centres are chosen farthest-first from a bounded sample; every row goes to its
nearest centre, and rows in the order of centre and distance are cut into blocks of BLOCK
rows and groups of blocks. So a cluster of any size, or equal rows, fill as many blocks
as they need. In a block, a cover tree: the farthest-first order of its rows gives nested nets
whose covering radii fall by BASE from level to level; each node's parent is the nearest node
of the net above; each node has the radius that covers the rows below it.

The search. An anchor goes to its own group first, which gives it a lower bound, then to
the groups that its bounds don't rule out. In a group, blocks come in the order of their best
bound. Levels are descended together for a batch of anchors: nodes whose bounds lie outside
an anchor's window, or below what it has, are skipped, with all below them; rows under nodes that are left are verified by
their exact scores. The best of each group are merged by (anchor, window).

First the windows are open above, same label, POSITIVES rows; then one window for each positive, other labels, NEGATIVES rows.

Defined results: rows with a null id, label or vector or a null or non-finite component take
no part, nor do those with a component beyond 2**18, whose scores might not fit a long; shorter
vectors count as filled up with zeros; of rows that share an id the least (label, vector) counts; an
anchor is never its own positive; ties go to the lesser id; an empty table, or one
without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved
from .suffix_dedup import ranked

POSITIVES, NEGATIVES, ANCHOR_EVERY, RELABEL_EVERY, LABELS, SCALE = 5, 3, 50, 7, 10, 256
LOW_PCT, HIGH_PCT = 50, 95
#: Rows of a block; of the sample that centres come from; most centres; most blocks of a group.
BLOCK, SAMPLE, CENTRES, GROUP_BLOCKS = 2048, 4096, 1024, 128
#: Ratio of the covering radii of neighbouring levels, and most nodes of a block's lowest net.
BASE, NODES = 1.3, 256
#: Anchors searched for together.
BATCH = 128
LIMIT = float(1 << 18)

_NONE = -(1 << 62)


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))])


def farthest_first(x: np.ndarray, most: int) -> tuple[list[int], list[float]]:
    """Rows in farthest-first order, and the covering radius before each was added; ends when all are covered."""
    order, radii = [0], [np.inf]
    d = ((x - x[0]) ** 2).sum(1)
    while len(order) < min(most, len(x)):
        k = int(d.argmax())
        if d[k] <= 0:
            break
        order.append(k)
        radii.append(float(np.sqrt(d[k])))
        np.minimum(d, ((x - x[k]) ** 2).sum(1), out=d)
    return order, radii


class Tree:
    """A block's cover tree: for each level its net (a prefix of ``order``), the
    parents in the net above, and the radius that covers the rows under each node."""

    def __init__(self, v: np.ndarray, top: float):
        x = augmented(v, top)
        order, radii = farthest_first(x, NODES)
        sizes = [1]
        if len(order) > 1:
            r = radii[1] / BASE
            for k in range(1, len(order)):
                while radii[k] <= r:
                    if sizes[-1] < k:
                        sizes.append(k)
                    r /= BASE
            if sizes[-1] < len(order):
                sizes.append(len(order))
        self.order = np.array(order)
        c = x[self.order]
        nearest = lambda y, m: ((y * y).sum(1)[:, None] - 2 * y @ c[:m].T + (c[:m] * c[:m]).sum(1)).argmin(1)
        self.levels = []
        own = nearest(x, sizes[-1])  # each row's node in the lowest net
        self.leaf = own
        for i in range(len(sizes) - 1, -1, -1):
            m = sizes[i]
            radius = np.zeros(m)
            np.maximum.at(radius, own, np.sqrt(((x - c[own]) ** 2).sum(1)))
            parent = nearest(c[:m], sizes[i - 1]) if i else np.zeros(m, np.int64)
            self.levels.insert(0, (m, parent, radius))
            if i:
                own = parent[own]


def score_bounds(dot: np.ndarray, radius: np.ndarray, length: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores under nodes: ``dot`` has the nodes' own scores (a row for each
    anchor of that length), M^2 is ``top``."""
    m = np.sqrt(top)
    scale = np.maximum(length * m, 1e-300)[:, None]
    angle = np.arccos(np.clip(dot / scale, -1, 1))
    spread = 2 * np.arcsin(np.clip(radius / (2 * max(m, 1e-300)), 0, 1)) + 1e-6
    slack = 1 + 1e-9 * scale
    return np.cos(np.minimum(angle + spread, np.pi)) * scale - slack, np.cos(np.maximum(angle - spread, 0)) * scale + slack


class Block:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, tree: Tree):
        # Scores are whole numbers; doubles hold them exactly while they stay below 2 ** 53.
        exact = float(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 2.0 ** 53
        self.ids, self.labels, self.tree = ids, labels, tree
        self.v = v.astype(np.float64 if exact else np.int64)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        v = self.v[rows]
        if v.dtype == np.float64 and np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * v.shape[1] < 2.0 ** 53:
            return np.rint(q.astype(np.float64) @ v.T).astype(np.int64)
        return q.astype(np.int64) @ v.T.astype(np.int64)


class Search:
    """The best of some anchors (ids, labels, vectors, windows lo and hi) in a group."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool, top: float):
        self.ids, self.labels, self.q, self.lo, self.hi, self.k, self.same, self.top = ids, labels, q, lo.copy(), hi, k, same, top
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.best = np.empty((0, 4), np.int64)  # anchor, window, score, id

    def open(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the bounds (anchor, node) meet one of the anchor's windows."""
        out = np.zeros(low.shape, bool)
        for w in range(self.lo.shape[1]):
            out |= (high >= self.lo[:, w, None]) & (low <= self.hi[:, w, None]) & (self.lo[:, w] <= self.hi[:, w])[:, None]
        return out

    def bounds(self, block: Block, level: int) -> tuple[np.ndarray, np.ndarray]:
        m, _, radius = block.tree.levels[level]
        return score_bounds(self.q.astype(np.float64) @ block.v[block.tree.order[:m]].astype(np.float64).T, radius, self.length, self.top)

    def visit(self, block: Block) -> None:
        alive = np.ones((len(self.ids), 1), bool)
        for level, (_, parent, _) in enumerate(block.tree.levels):
            alive = alive[:, parent] & self.open(*self.bounds(block, level))
            if not alive.any():
                return
        some = np.flatnonzero(alive.any(1))
        rows = np.flatnonzero(alive.any(0)[block.tree.leaf])
        s = block.scores(self.q[some], rows)
        ok = alive[some][:, block.tree.leaf[rows]]
        ok &= (block.labels[rows][None, :] == self.labels[some, None]) == self.same
        ok &= block.ids[rows][None, :] != self.ids[some, None]
        found = [self.best]
        for w in range(self.lo.shape[1]):
            a, r = np.nonzero(ok & (s >= self.lo[some, w, None]) & (s <= self.hi[some, w, None]))
            found.append(np.column_stack([some[a], np.full(len(a), w), s[a, r], block.ids[rows[r]]]))
        x = np.concatenate(found)
        if len(x) == len(self.best):
            return
        x = x[np.lexsort((x[:, 3], -x[:, 2], x[:, 1], x[:, 0]))]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:, :2] != x[:-1, :2]).any(1)
        place = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
        self.best = x[place < self.k]
        last = x[place == self.k - 1]
        # What can still get in scores as much as the k-th so far.
        self.lo[last[:, 0], last[:, 1]] = np.maximum(self.lo[last[:, 0], last[:, 1]], last[:, 2])

    def run(self, blocks: list[Block]) -> np.ndarray:
        heights = [self.bounds(b, 0)[1].max() for b in blocks]
        for i in np.argsort(-np.array(heights), kind="stable"):
            self.visit(blocks[i])
        return self.best


# -- the index


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column, filled up with zeros to the width."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy()) if len(col) else np.empty(0, np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width), np.int64)
    out[np.repeat(np.arange(len(col)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows that take part, relabelled, in whole numbers, one for each id."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("e"))
    good = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & good)
    x = x.select(
        "vec_id", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
        F.transform("e", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("int")).alias("v"))
    one = x.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


class Index:
    """Blocks of rows with their trees, in groups, and the pieces (of one centre in one group) with their radii."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        got = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))).first()
        self.n, self.width, self.top = got[0], got[1] or 0, float(got[2] or 0)
        if not self.n:
            return
        sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow()
        v = _matrix(sample.column("v"), self.width).astype(np.float64)
        order, _ = farthest_first(augmented(v, self.top), int(min(CENTRES, -(-self.n // BLOCK))))
        self.centres = v[order]
        width, top, centres = self.width, self.top, self.centres

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = augmented(centres, top)
            for b in batches:
                x = augmented(_matrix(b.column("v"), width).astype(np.float64), top)
                k = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                d = np.sqrt(((x - c[k]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k.astype(np.int32)), pa.array(d), pa.array(np.zeros(len(k), np.int32))],
                                                 [*b.schema.names, "centre", "dist", "cls"])

        kinds = "vec_id long, label long, v array<int>"
        placed = ranked(rows.select("vec_id", "label", "v").mapInArrow(nearest, f"{kinds}, centre int, dist double, cls int"), ["centre", "dist", "vec_id"])
        blocks = -(-self.n // BLOCK)
        per_group = int(max(1, min(GROUP_BLOCKS, blocks // (2 * spark.sparkContext.defaultParallelism))))
        self.groups = -(-blocks // per_group)
        self.rows = saved(placed.select("vec_id", "label", "v", "centre", "dist", F.floor(F.col("before_0") / BLOCK).alias("block")).withColumn(
            "grp", F.floor(F.col("block") / per_group)), "negatives-rows")
        pieces = self.rows.groupBy("grp", "centre").agg(F.max("dist").alias("radius")).toArrow()  # at most CENTRES + groups
        self.pieces = [pieces.column(c).to_numpy() for c in ("grp", "centre", "radius")]

        def build(table: pa.Table) -> pa.Table:
            x = _matrix(table.column("v"), width)
            order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
            x = x[order]
            tree = Tree(x.astype(np.float64), top)
            number = lambda a, t: np.concatenate(a).astype(t).tobytes()
            return pa.table({
                "grp": table.column("grp")[:1], "block": table.column("block")[:1], "ids": [table.column("vec_id").to_numpy()[order].tobytes()],
                "labels": [table.column("label").to_numpy()[order].tobytes()], "vectors": [x.astype(np.int32).tobytes()], "order": [tree.order.astype(np.int64).tobytes()],
                "leaf": [tree.leaf.astype(np.int64).tobytes()], "sizes": [np.array([m for m, _, _ in tree.levels], np.int64).tobytes()],
                "parents": [number([p for _, p, _ in tree.levels], np.int64)], "radii": [number([r for _, _, r in tree.levels], np.float64)]})

        parts = ", ".join(f"{c} binary" for c in ("ids", "labels", "vectors", "order", "leaf", "sizes", "parents", "radii"))
        self.blocks = saved(self.rows.select("grp", "block", "vec_id", "label", "v").groupBy("block").applyInArrow(
            build, f"grp long, block long, {parts}"), "negatives-blocks")

    def drop(self) -> None:
        dropped(self.rows, self.blocks)


def _load(width: int, r: dict) -> Block:
    tree = Tree.__new__(Tree)
    number = lambda c, t=np.int64: np.frombuffer(r[c], t)
    tree.order, tree.leaf, sizes = number("order"), number("leaf"), number("sizes")
    at = np.cumsum(sizes)[:-1]
    tree.levels = list(zip(sizes.tolist(), np.split(number("parents"), at), np.split(number("radii", np.float64), at)))
    return Block(number("ids"), number("labels"), number("vectors", np.int32).reshape(-1, width), tree)


_BLOCK_COLUMNS = ("ids", "labels", "vectors", "order", "leaf", "sizes", "parents", "radii")


def _search(width: int, top: float, k: int, same: bool):
    """Of a partition sorted by (grp, kind): the blocks of a group (kind 0), then its anchors (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, blocks, waiting = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting and blocks:
                ids, labels, v, lo, hi = zip(*waiting)
                q = np.zeros((len(v), width), np.int64)
                for i, x in enumerate(v):
                    q[i, :len(x)] = x
                s = Search(np.array(ids), np.array(labels), q, np.array(lo), np.array(hi), k, same, top)
                best = s.run(blocks)
                if len(best):
                    yield pa.RecordBatch.from_arrays([pa.array(s.ids[best[:, 0]]), pa.array(best[:, 1].astype(np.int32)), pa.array(best[:, 2]), pa.array(best[:, 3])],
                                                     ["anchor", "w", "score", "id"])
            waiting.clear()

        for b in batches:
            for r in b.to_pylist():
                if r["grp"] != grp:
                    yield from flush()
                    grp, blocks = r["grp"], []
                if r["kind"] == 0:
                    blocks.append(_load(width, r))
                else:
                    waiting.append((r["vec_id"], r["label"], r["v"], r["lo"], r["hi"]))
                    if len(waiting) >= BATCH:
                        yield from flush()
        yield from flush()

    return run


def _targets(index: Index):
    """The groups that an anchor's bounds don't rule out, but for its own."""
    width, top, centres, (grp, centre, radius) = index.width, index.top, index.centres, index.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                q = _matrix(part.column("v"), width)
                lo, hi = (np.array(part.column(c).to_pylist(), np.int64).reshape(len(q), -1) for c in ("lo", "hi"))
                s = Search(np.zeros(len(q)), np.zeros(len(q)), q, lo, hi, 1, True, top)
                dot = q.astype(np.float64) @ centres.T
                ok = s.open(*score_bounds(dot[:, centre], radius, s.length, top))
                own = part.column("own").to_numpy()
                some = [np.setdiff1d(grp[x], [o]) for x, o in zip(ok, own)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("vec_id", "label", "v", "lo", "hi")] + [pa.array(some, pa.list_(pa.int64()))],
                                                 ["vec_id", "label", "v", "lo", "hi", "grps"])

    return run


_QUERY = "vec_id long, label long, v array<int>, lo array<long>, hi array<long>"


def _pass(index: Index, queries: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """(anchor, w, score, id): the best k of each window in the groups that the queries (grp, ...) name."""
    null = lambda names, t: [F.lit(None).cast(t).alias(c) for c in names]
    binary = [F.lit(None).cast("binary").alias(c) for c in _BLOCK_COLUMNS]
    blocks = index.blocks.select("grp", F.lit(0).alias("kind"), *_BLOCK_COLUMNS, *null(["vec_id", "label"], "long"), *null(["v"], "array<int>"), *null(["lo", "hi"], "array<long>"))
    asked = queries.select("grp", F.lit(1).alias("kind"), *binary, "vec_id", "label", "v", "lo", "hi")
    both = blocks.unionByName(asked).repartition(index.groups, "grp").sortWithinPartitions("grp", "kind", "vec_id")
    found = saved(both.mapInArrow(_search(index.width, index.top, k, same), "anchor long, w int, score long, id long"), name)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def best_in_windows(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, w, score, id, place): of each anchor (own, vec_id, label, v, lo, hi) and window the k
    greatest scores within [lo, hi], of rows with the same or with other labels."""
    near = _pass(index, queries.withColumn("grp", F.col("own")), k, same, "negatives-near")
    # The k-th in the own group is the least that can still count elsewhere.
    least = _best(near, k).where(F.col("place") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    known = queries.join(least.withColumnRenamed("anchor", "vec_id"), "vec_id", "left").withColumn(
        "lo", F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), F.lit(_NONE).cast("long")))))
    asked = known.select("own", "vec_id", "label", "v", "lo", "hi").mapInArrow(_targets(index), f"{_QUERY}, grps array<long>").withColumn(
        "grp", F.explode("grps")).drop("grps")
    far = _pass(index, asked, k, same, "negatives-far")
    out = saved(_best(near.unionByName(far), k), "negatives-best")
    dropped(near, far)
    return out


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = ANCHOR_EVERY,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor
    and positive the first ``negatives`` rows of other labels whose score is between low_pct and
    high_pct per cent of the positive's."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = saved(prepared(vectors, id_col, vector_col, label_col), "negatives-prepared")
    index = Index(rows)
    if not index.n:
        return spark.createDataFrame([], schema)
    longs = lambda *c: F.array(*[F.lit(x).cast("long") for x in c])
    anchors = index.rows.where(F.col("vec_id") % every == 0).select(F.col("grp").alias("own"), "vec_id", "label", "v")
    top = best_in_windows(index, anchors.select("*", longs(_NONE).alias("lo"), longs(-_NONE).alias("hi")), positives, True)
    # A window for each positive, in their order; windows without one are empty.
    windows = top.groupBy(F.col("anchor").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    at = lambda i: F.try_element_at("p", F.lit(i + 1))["score"]
    lo = F.array(*[F.coalesce(F.ceil(at(i) * low_pct / F.lit(100).cast("decimal(3,0)")).cast("long"), F.lit(1).cast("long")) for i in range(positives)])
    hi = F.array(*[F.coalesce(F.floor(at(i) * high_pct / F.lit(100).cast("decimal(3,0)")).cast("long"), F.lit(0).cast("long")) for i in range(positives)])
    queries = anchors.join(windows, "vec_id").select("own", "vec_id", "label", "v", lo.alias("lo"), hi.alias("hi"))
    queries = saved(queries, "negatives-windows")
    got = best_in_windows(index, queries, negatives, False).select("anchor", "w", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
                                                                   F.col("score").alias("negative_score"))
    pos = top.select("anchor", (F.col("place") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = saved(pos.join(got, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"), "negatives-found")
    dropped(rows, queries, top)
    index.drop()
    return out
