"""K-d tree sharding: leaves of near-equal bytes, near each other in metadata.

A node that holds m shards is split so that its halves hold m // 2 and
m - m // 2 of them, at the weighted quantile (weight: size) of the dimension in
which the node is widest; a node of one shard is a leaf. The number of shards
is given, or follows from the target bytes of a leaf.

Dimensions are whole numbers. Rows are put in order by (dimension, row id), the
row id being unique, so any number of equal values can be cut. Every level of
the tree handles all its nodes in the same few passes over a slim table: a
pass sums sizes per (node, bucket), with partial sums before the shuffle, and
the bucket that holds the quantile is split into buckets by the next pass until
it is a single value. The driver sees the tree and a pass's bucket sums, at most nodes x BUCKETS
rows, whatever the table's size.

Law: ``bytes``. A shard is off its equal share by less than one row per level.

Slots: rows are written in order of shard within each partition, so a row's
place is its own number there plus the rows of that shard in earlier
partitions: a running sum over (partition, shard) counts. No task holds a
whole shard.

Defined results: a null text has size 16 and CRC 0; null metadata is a value
of its own (-1); repeated rows are placed one by one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, whole_text

BUCKETS = 1024
OVERHEAD = 16
N_SHARDS = 40


def _values(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers, one row per node, for a broadcast join."""
    body = ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})"))


def _search(rows: DataFrame, dims: list[str], jobs: dict[int, dict]) -> None:
    """Per node the least v with sum(size where value <= v) >= need.

    A job has ``dim`` (its place in ``dims``), ``lo``, ``hi`` and ``need``, and
    optionally ``eq_dim`` and ``eq`` (only rows of that value count). It gets
    ``cut`` = v, and ``need`` becomes what is still needed of the rows at v.
    """
    pick = lambda c: F.get(F.array(*dims), F.col(c).cast("int"))
    while todo := {k: j for k, j in jobs.items() if "cut" not in j}:
        for j in todo.values():
            j["width"] = max(1, -(-(j["hi"] - j["lo"] + 1) // BUCKETS))
        table = _values(rows.sparkSession, "node, dim, lo, hi, width, eq_dim, eq", [
            (k, j["dim"], j["lo"], j["hi"], j["width"], j.get("eq_dim", -1), j.get("eq", 0)) for k, j in todo.items()])
        sums = rows.join(table, "node").withColumn("v", pick("dim")).where(
            F.col("v").between(F.col("lo"), F.col("hi")) & ((F.col("eq_dim") < 0) | (pick("eq_dim") == F.col("eq")))
        ).groupBy("node", F.expr("(v - lo) div width").alias("b")).agg(F.sum("size").alias("s")).collect()
        for k, j in todo.items():
            for b, s in sorted((r["b"], r["s"]) for r in sums if r["node"] == k):
                if s >= j["need"]:
                    break
                j["need"] -= s
            start = j["lo"] + b * j["width"]
            if j["width"] == 1:
                j["cut"] = start
            else:
                j["lo"], j["hi"] = start, min(j["hi"], start + j["width"] - 1)


def split_rows(rows: DataFrame, dims: list[str], n_shards: int) -> DataFrame:
    """``rows`` (rid, size and the dimensions, all long) with their ``node``:
    in the end the number of the leaf, its shard."""
    dims = [*dims, "rid"]
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    shards, whole = {0: n_shards}, None
    while nodes := {k: m for k, m in shards.items() if m > 1}:
        spans = rows.where(F.col("node").isin(list(nodes))).groupBy("node").agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        spans = {r["node"]: r for r in spans}
        width = lambda r, d: r[f"{d}_hi"] - r[f"{d}_lo"]
        whole = whole or {d: max(1, width(r, d)) for r in spans.values() for d in dims}
        jobs = {}
        for k, r in spans.items():
            d = max(dims[:-1], key=lambda d: width(r, d) / whole[d])
            jobs[k] = {"dim": dims.index(d), "lo": r[f"{d}_lo"], "hi": r[f"{d}_hi"],
                       "need": max(1, r["bytes"] * (nodes[k] // 2) // nodes[k])}
        _search(rows, dims, jobs)
        rid = {k: {"dim": len(dims) - 1, "lo": spans[k]["rid_lo"], "hi": spans[k]["rid_hi"], "need": j["need"],
                   "eq_dim": j["dim"], "eq": j["cut"]} for k, j in jobs.items()}
        _search(rows, dims, rid)
        if jobs:
            table = _values(rows.sparkSession, "node, dim, cut, last, step", [
                (k, j["dim"], j["cut"], rid[k]["cut"], nodes[k] // 2) for k, j in jobs.items()])
            at = F.get(F.array(*dims), F.col("dim").cast("int"))
            right = (at > F.col("cut")) | ((at == F.col("cut")) & (F.col("rid") > F.col("last")))
            kept = rows.columns
            rows = saved(rows.join(table, "node", "left").withColumn(
                "node", F.when(right, F.col("node") + F.col("step")).otherwise(F.col("node"))).select(kept), "kd-level")
        for k, m in nodes.items():
            shards[k], shards[k + m // 2] = m // 2, m - m // 2
    return rows


#: Ids beyond this are ordered by their digest too, so that widths fit a long.
_WIDEST = 1 << 61


def _ordinal(c: str) -> Column:
    """A text dimension as a whole number; equal values stay together."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("long")


def shard_rows(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
               text_col: str = "text", text_dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row. The dimensions
    are the texts in ``text_dims``, the size and the id (of any type; one that is no
    whole number is ordered by its digest)."""
    text, number = whole_text(text_col), F.col("doc_id").cast("string").try_cast("long")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[_ordinal(c).alias(f"dim_{c}") for c in text_dims]).withColumns({
            "dim_size": F.col("size"), "dim_id": F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).when(
                number.between(-_WIDEST, _WIDEST), number).otherwise(F.shiftright(F.xxhash64(F.col("doc_id").cast("string")), 2)),
            "rid": F.monotonically_increasing_id()})
    slim = saved(slim, "kd-rows")
    if n_shards is None:
        total = slim.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    rows = split_rows(slim, [f"dim_{c}" for c in text_dims] + ["dim_size", "dim_id"], n_shards)
    placed = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard")).sortWithinPartitions("shard")
    placed = saved(placed.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33).cast("int")), "kd-placed")
    # One row per (partition, shard): as many as tasks times shards.
    runs = placed.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "shard", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(runs, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.col("first") + F.col("offset")).cast("long").alias("slot"))
