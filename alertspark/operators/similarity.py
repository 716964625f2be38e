"""Exact top-k similarity join.

Work is dealt into 2-D tiles. Queries go into cells around pivots (cells over a byte budget
are split), KB vectors into blocks; a task holds one cell's queries and streams one block past them in
tiles of bounded bytes with a running top-k, and the blocks' answers are merged per query. Memory
depends on neither side's size, and nothing passes the driver but pivots and their bounds.

A KB vector goes only to cells that it can improve. With d the distance, p a pivot and K(p) the
distance from p to its k-th nearest KB row, a query's k-th distance is at most d(q, p) + K(p) for every p; a cell
keeps the greatest of these bounds and, per pivot, the range of its queries' distances. By the
triangle inequality a vector whose distance to any pivot is further outside that range than the bound
is no neighbour of any query of the cell. Nothing is lost: where bounds rule nothing out (random
vectors of many dimensions), every vector goes to every cell. Groups of queries and
blocks of the KB are as many as memory asks for and the cores can use, in the proportion that makes the copies of the
two sides fewest; queries that fit one task need no pivots.

Distances are squared L2 in float64. Candidates of a tile are selected by the matrix
product form with a small tolerance; they are re-scored with the direct difference formula
and ordered by (distance, id), so ties and rounding match a direct evaluation. A task gets the KB by id, so
a later row of an equal distance never displaces an earlier one, and a tile costs one product, one comparison and
a merge of those rows alone that improve a query. A null id comes last.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MAX_TOP_K

#: Bytes of query vectors a task holds, and of a tile of distances.
GROUP_BYTES = 32 << 20
TILE_BYTES = 2 << 20
#: Most bytes of KB vectors a task streams, and the side of the least tile that is worth a task of its own.
BLOCK_BYTES = 256 << 20
LEAST_TILE_BYTES = 768 << 10
#: Tiles, where the tables are no larger than memory asks for: so many or three a core. Copies of both sides grow with their root.
TASKS = 32
#: Most pivots, and the bytes of query vectors they are picked from.
PIVOTS = 64
SAMPLE_BYTES = 32 << 20
#: Relative rounding allowed for in bounds; a distance's own is below (dimensions + 2) * 2 ** -52.
ROUNDING = 1e-9

HITS = "query_id string, vec_key long, copies long, id string, distance double, rank int"


def squared_l2(a: Column, b: Column) -> Column:
    """F15 as a native expression: sum((a_i - b_i)^2) in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                       F.lit(0.0), lambda acc, v: acc + v)


def clamp_k(k: int) -> int:
    """O2: k clamped to [1, 10]; a smaller KB gives fewer rows."""
    return min(max(1, int(k)), MAX_TOP_K)


class _Nearest:
    """The queries of a tile and their ``k`` best so far: distances and places of KB rows, by (distance, place)."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int, exclude_self: bool, tile_bytes: int):
        self.k, self.dims = k, mat.shape[1]
        # The rounding of |q|^2 + |k|^2 - 2qk is relative to the norms, not to the distance.
        self.slack = 4 * (self.dims + 4) * np.finfo(float).eps
        self.norms = np.einsum("ij,ij->i", mat, mat)
        # One product with (k, 1, |k|^2) gives the distance less its slack; -2q is exact, so q comes back from it.
        self.sides = np.empty((len(mat), self.dims + 2))
        self.sides[:, :-2] = -2.0 * mat
        self.sides[:, -2], self.sides[:, -1] = self.norms * (1 - self.slack), 1.0
        self.distance = np.full((len(mat), k), np.inf)
        self.place = np.full((len(mat), k), np.iinfo(np.int64).max)
        self.names: list[np.ndarray] = []
        self.seen = 0
        self.rows = max(1, math.isqrt(tile_bytes // 8))
        self.slice = max(1, tile_bytes // (8 * self.rows))
        self.low = np.empty(self.rows * self.slice)
        self.own = None
        if exclude_self:
            code, own = pd.factorize(_named(ids))
            self.by_code = np.argsort(code, kind="stable")
            self.first = np.searchsorted(code[self.by_code], np.arange(len(own) + 1))
            self.own = pd.Index(own, dtype=object)

    def _same_id(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and KB rows with one id, by query."""
        if self.own is None:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        code = self.own.get_indexer(_named(names))
        col = np.flatnonzero(code >= 0)
        start, n = self.first[code[col]], self.first[code[col] + 1] - self.first[code[col]]
        row = self.by_code[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(row, kind="stable")
        return row[order], np.repeat(col, n)[order]

    def stream(self, names: np.ndarray, mat: np.ndarray) -> None:
        """KB rows, which come by id: of equal distances the first stay."""
        self.names.append(names)
        for a in range(0, len(mat), self.rows):
            part = mat[a:a + self.rows]
            norms = np.einsum("ij,ij->i", part, part)
            side = np.column_stack([part, np.ones(len(part)), norms * (1 - self.slack)]).T
            row, col = self._same_id(names[a:a + self.rows])
            for s in range(0, len(self.sides), self.slice):
                mine = slice(*np.searchsorted(row, [s, s + self.slice]))
                self._tile(s, part, norms, side, row[mine] - s, col[mine])
            self.seen += len(part)

    def _tile(self, s: int, part: np.ndarray, norms: np.ndarray, side: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        sides, own = self.sides[s:s + self.slice], self.norms[s:s + self.slice]
        with np.errstate(all="ignore"):
            low = self.low[:len(sides) * len(part)].reshape(len(sides), len(part))
            np.matmul(sides, side, out=low)
            low[row, col] = np.nan
            limit = self.distance[s:s + self.slice, -1].copy()
            fresh = np.flatnonzero(np.isinf(limit))
            if len(fresh) and len(part) >= self.k:
                high = low[fresh] + 2 * self.slack * (own[fresh, None] + norms)
                high[~np.isfinite(high)] = np.inf
                limit[fresh] = np.partition(high, self.k - 1, axis=1)[:, self.k - 1]
            qi, ki = np.divmod(np.flatnonzero(low <= limit[:, None]), len(part))
            fine = np.isfinite(own[qi] + norms[ki])
            qi, ki = qi[fine], ki[fine]
            exact = np.concatenate([((part[ki[a:a + 65536]] - -0.5 * sides[qi[a:a + 65536], :-2]) ** 2).sum(axis=1) for a in range(0, len(qi), 65536)] or [np.empty(0)])
        better = exact < self.distance[s + qi, -1]
        self._merge(s + qi[better], self.seen + ki[better], exact[better])

    def _merge(self, q: np.ndarray, place: np.ndarray, distance: np.ndarray) -> None:
        if not len(q):
            return
        rows, at = np.unique(q, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        distance = np.concatenate([self.distance[rows].ravel(), distance])
        place = np.concatenate([self.place[rows].ravel(), place])
        order = np.lexsort((place, distance, at))
        take = order[np.searchsorted(at[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.distance[rows], self.place[rows] = distance[take], place[take]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids, distances and ranks."""
        q, j = np.nonzero(np.isfinite(self.distance))
        return q, np.concatenate(self.names)[self.place[q, j]], self.distance[q, j], (j + 1).astype("int32")


def _named(ids: np.ndarray) -> np.ndarray:
    """Ids with a value of its own, which is no string, for null."""
    return np.where(pd.isna(ids), 0, ids)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def _prepare(df: DataFrame, id_col: str, vec_col: str, out_id: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias(out_id), F.col(vec_col).alias("vec")) \
        .filter(F.col("vec").isNotNull())


def _scored(k: int, exclude_self: bool, tile_bytes: int):
    def run(batches):
        group, ids, mats, keys, state = None, [], [], [], None

        def result():
            q, name, distance, rank = state.hits()
            who = pd.concat(keys)
            if len(q):
                yield pd.DataFrame({"query_id": np.concatenate(ids)[q], "vec_key": who["vec_key"].to_numpy()[q], "copies": who["copies"].to_numpy()[q],
                                    "id": name, "distance": distance, "rank": rank})

        for batch in batches:
            for (g, side), part in batch.groupby(["g", "side"], sort=True):
                if g != group:
                    if state is not None:
                        yield from result()
                    group, ids, mats, keys, state = g, [], [], [], None
                if side == 0:
                    ids.append(part["id"].to_numpy(dtype=object))
                    mats.append(_matrix(part["vec"]))
                    keys.append(part[["vec_key", "copies"]])
                    continue
                if not ids:
                    continue
                if state is None:
                    state = _Nearest(np.concatenate(ids), np.vstack(mats), k, exclude_self, tile_bytes)
                    mats = []
                state.stream(part["id"].to_numpy(dtype=object), _matrix(part["vec"]))
        if state is not None:
            yield from result()

    return run


# --------------------------------------------------------------------------- cells and bounds

def _to_pivots(vecs: pd.Series, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors (rows) to pivots (columns), by the direct form."""
    rows = max(1, TILE_BYTES // (8 * pivots.shape[1]))
    parts = []
    for a in range(0, len(vecs), rows):
        mat = _matrix(vecs.iloc[a:a + rows])
        parts.append(np.stack([np.sqrt(((mat - p) ** 2).sum(axis=1)) for p in pivots], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, len(pivots)))


def _pick_pivots(q: DataFrame, n: int) -> np.ndarray:
    """Up to ``n`` query vectors far from one another, out of a sample of bounded bytes."""
    width = q.agg(F.max(F.size("vec"))).first()[0]
    sample = q.orderBy(F.xxhash64("id", F.lit(1)), F.xxhash64("vec")).limit(max(1, min(16 * n, SAMPLE_BYTES // (8 * max(width, 1))))).select("vec").collect()
    mat = np.array([r.vec for r in sample], dtype=np.float64)
    mat = mat[np.isfinite(mat).all(axis=1)]
    if not len(mat):
        return np.zeros((1, width))
    picks, far = [0], ((mat - mat[0]) ** 2).sum(axis=1)
    while len(picks) < n and far.max() > 0:
        picks.append(int(far.argmax()))
        far = np.minimum(far, ((mat - mat[picks[-1]]) ** 2).sum(axis=1))
    return mat[picks]


def _kth_of_pivots(b: DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each pivot's distance to its k-th nearest id of the KB (infinite with fewer ids)."""
    def nearest(batches):
        best = pd.DataFrame({"c": np.empty(0, "int32"), "id": np.empty(0, object), "d": np.empty(0)})
        for batch in batches:
            d = _to_pivots(batch["vec"], pivots)
            new = pd.DataFrame({"c": np.tile(np.arange(len(pivots), dtype="int32"), len(batch)), "id": np.repeat(batch["id"].to_numpy(dtype=object), len(pivots)), "d": d.ravel()})
            kth = best.groupby("c")["d"].max().reindex(range(len(pivots))).to_numpy() if len(best) >= k * len(pivots) else np.full(len(pivots), np.inf)
            new = new[np.isfinite(new["d"]) & (new["d"] <= kth[new["c"]])]
            both = pd.concat([best, new], ignore_index=True).sort_values(["c", "d", "id"]).drop_duplicates(["c", "id"])
            best = both.groupby("c", sort=False).head(k)
        yield best

    w = Window.partitionBy("c").orderBy("d", "id")
    rows = b.mapInPandas(nearest, "c int, id string, d double").groupBy("c", "id").agg(F.min("d").alias("d")) \
        .withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).where(F.col("n") == k).collect()
    out = np.full(len(pivots), np.inf)
    for r in rows:
        out[r.c] = r.d
    return out


def _cell_bounds(q: DataFrame, pivots: np.ndarray, cells: int, kth: np.ndarray):
    """Per cell: bytes, ranges of its queries' distances to each pivot, and a bound on
    its queries' k-th distances. Cells x pivots rows reach the driver, at most PIVOTS squared."""
    n = len(pivots)

    def ranges(batches):
        lo, hi = np.full((cells, n), np.inf), np.full((cells, n), -np.inf)
        top, size = np.full(cells, -np.inf), np.zeros(cells)
        for batch in batches:
            d = _to_pivots(batch["vec"], pivots)
            cell = d[:, :cells].argmin(axis=1)
            np.add.at(size, cell, 8 * batch["vec"].map(len).to_numpy())
            fine = np.isfinite(d).all(axis=1)
            cell, d = cell[fine], d[fine]
            np.minimum.at(lo, cell, d)
            np.maximum.at(hi, cell, d)
            np.maximum.at(top, cell, (d + kth).min(axis=1))
        c, j = np.divmod(np.arange(cells * n), n)
        yield pd.DataFrame({"c": c, "j": j, "lo": lo.ravel(), "hi": hi.ravel(), "top": top[c], "size": size[c]})

    lo, hi = np.full((cells, n), np.inf), np.full((cells, n), -np.inf)
    top, size = np.full(cells, -np.inf), np.zeros(cells)
    for r in q.mapInPandas(ranges, "c int, j int, lo double, hi double, top double, size double").groupBy("c", "j").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"), F.sum("size").alias("size")).collect():
        lo[r.c, r.j], hi[r.c, r.j], top[r.c], size[r.c] = r.lo, r.hi, r.top, r["size"]
    return lo, hi, top, size


def _deal(q: DataFrame, b: DataFrame, total: tuple[int, int], k: int, exclude_self: bool, group_bytes: int) -> tuple[DataFrame, int, int]:
    """Both sides' rows with the tile ``g`` they go to, the number of tiles and of blocks; equal query rows as one
    with their number. ``total``: the sides' bytes."""
    needed = max(1, math.ceil(total[0] / group_bytes))
    tasks = max(1, min(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(TASKS, 3 * q.sparkSession.sparkContext.defaultParallelism),
                       math.ceil(total[0] * total[1] / LEAST_TILE_BYTES ** 2)))
    # Groups beyond those that memory asks for, as many as make the copies of both sides fewest.
    groups = max(needed, min(tasks, round(math.sqrt(tasks * total[0] / total[1]))) if total[1] else 1)
    blocks = max(1, math.ceil(total[1] / BLOCK_BYTES), math.ceil(tasks / groups))
    # Pivots and bounds are taken from the rows as they come, which need no shuffle.
    plain = q
    q = q.groupBy("id", "vec").agg(F.count("*").alias("copies")).withColumn("vec_key", F.xxhash64("vec")).withColumn("h", F.xxhash64("id", "vec_key"))
    b = b.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
    if needed == 1:
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        group = F.pmod("h", F.lit(groups)).cast("int")
        rows = q.withColumn("block", each(blocks)).select((group * blocks + F.col("block")).alias("g"), F.lit(0).alias("side"), "id", "vec", "vec_key", "copies") \
            .unionByName(b.withColumn("group", each(groups)).select((F.col("group") * blocks + F.col("block")).alias("g"), F.lit(1).alias("side"), "id", "vec"),
                         allowMissingColumns=True)
        return rows, groups * blocks, blocks
    pivots = _pick_pivots(plain, min(PIVOTS, max(groups, 8)))
    cells = min(groups, len(pivots))
    kth = _kth_of_pivots(b, pivots, k + exclude_self)
    lo, hi, top, size = _cell_bounds(plain, pivots, cells, kth)
    subs = np.maximum(np.maximum(1, np.ceil(size / group_bytes)), np.round(size * groups / max(total[0], 1))).astype(int)
    first = np.concatenate([[0], np.cumsum(subs)[:-1]])
    vec = q.schema["vec"].dataType.simpleString()

    def place_queries(batches):
        for batch in batches:
            cell = _to_pivots(batch["vec"], pivots)[:, :cells].argmin(axis=1)
            group = first[cell] + batch["h"].to_numpy() % subs[cell]
            for block in range(blocks):
                yield pd.DataFrame({"g": (group * blocks + block).astype("int32"), "side": 0, "id": batch["id"], "vec": batch["vec"],
                                    "vec_key": batch["vec_key"], "copies": batch["copies"]})

    def place_kb(batches):
        for batch in batches:
            d = _to_pivots(batch["vec"], pivots)
            for c in np.flatnonzero(size):
                with np.errstate(invalid="ignore"):
                    gap = np.maximum(lo[c] - d, d - hi[c]) - ROUNDING * (d + np.abs(hi[c]))
                    part = batch[~(gap.max(axis=1) > top[c] * (1 + ROUNDING))]
                for s in range(subs[c] if len(part) else 0):
                    yield pd.DataFrame({"g": ((first[c] + s) * blocks + part["block"]).astype("int32"), "side": 1, "id": part["id"], "vec": part["vec"]})

    rows = q.mapInPandas(place_queries, f"g int, side int, id string, vec {vec}, vec_key long, copies long").unionByName(
        b.mapInPandas(place_kb, f"g int, side int, id string, vec {vec}"), allowMissingColumns=True)
    return rows, int(subs.sum()) * blocks, blocks


def _sides(queries: DataFrame, kb: DataFrame, query_id: str, query_vec: str, kb_id: str, kb_vec: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Both sides' (id, vec), vectors of one type, and their bytes."""
    q, b = _prepare(queries, query_id, query_vec, "id"), _prepare(kb, kb_id, kb_vec, "id")
    if q.schema["vec"].dataType != b.schema["vec"].dataType:
        q, b = [df.withColumn("vec", F.col("vec").cast("array<double>")) for df in (q, b)]
    size = F.size("vec").cast("long") * 8
    found = q.select(F.lit(0).alias("side"), size.alias("n")).union(b.select(F.lit(1), size)).groupBy("side").agg(F.sum("n").alias("n")).collect()
    total = {r.side: r.n for r in found}
    return q, b, (total.get(0, 0), total.get(1, 0))


def knn(queries: DataFrame, kb: DataFrame, k: int = 3, query_id: str = "query_id",
        query_vec: str = "embedding", kb_id: str = "id", kb_vec: str = "embedding",
        exclude_self: bool = False, group_bytes: int = GROUP_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """J7 + O2: (query_id, id, distance, rank) for the k nearest KB rows per query.
    Rows with a null vector are no neighbours and get none; repeated query rows get their hits each."""
    k = clamp_k(k)
    q, b, total = _sides(queries, kb, query_id, query_vec, kb_id, kb_vec)
    rows, tiles, blocks = _deal(q, b, total, k, exclude_self, group_bytes)
    hits = rows.repartitionById(tiles, "g").sortWithinPartitions("g", "side", F.col("id").asc_nulls_last()).mapInPandas(_scored(k, exclude_self, tile_bytes), HITS)
    if blocks > 1:
        w = Window.partitionBy("query_id", "vec_key").orderBy("distance", F.col("id").asc_nulls_last())
        hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "id", "distance", "rank")


def best_match(hits: DataFrame) -> DataFrame:
    """The single nearest KB row per query: rank 1 of the hits, which come
    one row per (query, rank)."""
    return hits.where(F.col("rank") == 1).select("query_id", "id", "distance")
