"""Merkle manifest of a dataset, as a persistent path-copying tree.

The leaves of a source ascend by id and are its tree's lowest nodes; RUN
neighbours become a node of the level above, until one is left. The subroots
become the leaves of one more such tree, in the order of the sources.

Built upwards, an aligned block of RUN ** LEVELS nodes at a time: a block is a
task's work, whose subtree needs nothing of other blocks; the blocks' roots are
the next round's nodes. So a source with a third of all rows is many blocks, and
rounds grow with the logarithm of the largest source.

Going down again, every block hands its nodes their way to the root: for each level
above, the place in the run and the run's other digests. It is the same for all leaves
of a block but for the block's own levels, so it is joined to blocks and not to rows.

Tampering with a leaf makes a version of the tree: all nodes but the leaf's ancestors are
shared, and the ancestors are copied with the new digest in them, first inside the leaf's
block, then along the way that the block was handed. A version is a path, never a tree of its own.

Positions come from one range-partitioned sort; equal keys are told apart by a row
number written with the leaves.

Defined results: nulls are `-` in a leaf, also a null id, which sorts first; a null
source is a source of its own and sorts first; a row whose id is null is not tampered with; rows that
repeat an id are leaves each, in the order of their digests; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import broadcast_if_small, dropped, lower_ascii, saved
from .suffix_dedup import ranked

#: Nodes that become one, and levels that a block holds.
RUN, LEVELS = 16, 3
BLOCK = RUN ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of the ids, by their digest, one in so many is tampered with.
TAMPER_ONE_IN = 5


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(leaves: list[str], n_group: int) -> list[list[str]]:
    """The levels of a block of a group with ``n_group`` nodes, lowest first. A group of
    one block ends with its root; else a block has all its LEVELS, also where a run is one node."""
    out = [leaves]
    while len(out[-1]) > 1 if n_group <= BLOCK else len(out) <= LEVELS:
        x = out[-1]
        out.append([node(x[i:i + RUN]) for i in range(0, len(x), RUN)])
    return out


def way_up(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """For each level of a block above its node i: the place in the run, the run's other digests."""
    out = []
    for x in levels[:-1]:
        first = i // RUN * RUN
        out.append((i - first, x[first:i] + x[i + 1:first + RUN]))
        i //= RUN
    return out


def folded(digest: str, way: list[tuple[int, list[str]]]) -> str:
    """The root of the version that has ``digest`` at the way's lower end."""
    for at, others in way:
        digest = node(others[:at] + [digest] + others[at:])
    return digest


def pack(way: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes((at, len(others))) + bytes.fromhex("".join(others)) for at, others in way)


def unpack(data: bytes) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(data):
        at, n = data[i], data[i + 1]
        text = data[i + 2:i + 2 + 32 * n].hex()
        out.append((at, [text[64 * k:64 * k + 64] for k in range(n)]))
        i += 2 + 32 * n
    return out


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each group, and ``n``, the group's rows."""
    got = saved(ranked(rows.withColumn("cls", F.lit(0)), [F.col("grp").asc_nulls_first(), *order]).drop("cls"), "merkle-ranked")
    size = got.groupBy("grp").agg(F.min("before_0").alias("first"), F.count(F.lit(1)).alias("n"))
    size = saved(size, "merkle-groups")
    return got.join(broadcast_if_small(size, 100).withColumnRenamed("grp", "g2"), F.col("grp").eqNullSafe(F.col("g2"))).withColumn(
        "pos", F.col("before_0") - F.col("first")).drop("g2", "before_0", "first")


def _blocks(rows: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each aligned block: (grp, block, n, rows); ``rows`` holds
    (pos, digest, *carried) of at most BLOCK nodes, in order."""
    return rows.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("rows"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roots = [levels_of(x, n)[-1][0] for x, n in zip(b.column("digests").to_pylist(), b.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("block"), b.column("n"), pa.array(roots, pa.string())], ["grp", "block", "n", "root"])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ways of the nodes of upper blocks."""
    for b in batches:
        for i in range(b.num_rows):
            x, n, above = b.column("digests")[i].as_py(), b.column("n")[i].as_py(), b.column("way")[i].as_py()
            levels = levels_of(x, n)
            ways = [pack(way_up(levels, k)) + above for k in range(len(x))]
            first = b.column("block")[i].as_py() * BLOCK
            grp = pa.array(b.column("keys")[i].as_py() if "keys" in b.schema.names else [b.column("grp")[i].as_py()] * len(x), pa.string())
            yield pa.RecordBatch.from_arrays([grp, pa.array(np.arange(first, first + len(x))), pa.array(ways, pa.binary())], ["grp", "block", "way"])


_SCHEMA = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied int"


def _versions(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column("rows")[i].values
                leaves, changed = rows.field("digest").to_pylist(), rows.field("changed").to_pylist()
                n, above = b.column("n")[i].as_py(), unpack(b.column("way")[i].as_py())
                subroot, root = b.column("subroot")[i].as_py(), b.column("root")[i].as_py()
                levels = levels_of(leaves, n)
                out = []
                for k, leaf in enumerate(leaves):
                    way = way_up(levels, k) + above
                    proof = node([x for _, others in way for x in others])
                    got = folded(leaf if changed[k] is None else changed[k], way)
                    out.append((leaf, subroot, root, proof, got, got == root, len(way)))
                yield pa.RecordBatch.from_arrays(
                    [rows.field("doc_id").cast(id_type), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.string(),) * 5 + (pa.bool_(), pa.int32()))]],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_copied"])

    return run


class Tree:
    """The blocks of a tree's rounds, lowest first: the first round's hold the rows."""

    def __init__(self, rows: DataFrame, carried: list[str], name: str):
        self.rounds = [saved(_blocks(rows, carried), f"merkle-{name}")]
        while True:
            last = self.rounds[-1]
            digests = F.transform("rows", lambda r: r["digest"])
            roots = saved(last.select("grp", "block", "n", digests.alias("digests")).mapInArrow(
                _roots, "grp string, block long, n long, root string"), f"merkle-{name}-roots")
            more = roots.where(F.col("n") > BLOCK)
            self.done = roots.where(F.col("n") <= BLOCK).select("grp", "root") if len(self.rounds) == 1 else \
                self.done.unionByName(roots.where(F.col("n") <= BLOCK).select("grp", "root"))
            if more.isEmpty():
                return
            up = more.select("grp", F.col("block").alias("pos"), F.col("root").alias("digest"), F.ceil(F.col("n") / BLOCK).alias("n"))
            self.rounds.append(saved(_blocks(up, []), f"merkle-{name}"))

    def ways(self, tops: DataFrame) -> DataFrame:
        """(grp, block, way) of the first round's blocks; ``tops`` has (grp, way) of each group's root."""
        same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
        tops = tops.select(F.col("grp").alias("g2"), "way")
        known = None
        for blocks in reversed(self.rounds):
            base = blocks.select("grp", "block", "n", F.transform("rows", lambda r: r["digest"]).alias("digests"))
            # A group's last round has one block, which gets the way of the group's root.
            ends = base.where(F.col("n") <= BLOCK).join(tops, same("grp", "g2")).drop("g2")
            inner = base.where(F.col("n") > BLOCK).join(
                known.select(F.col("grp").alias("g2"), F.col("block").alias("b2"), "way"), same("grp", "g2") & (F.col("block") == F.col("b2"))
            ).drop("g2", "b2") if known is not None else None
            here = ends if inner is None else ends.unionByName(inner)
            if blocks is self.rounds[0]:
                return here.select("grp", "block", "way")
            known = saved(here.mapInArrow(_ways, "grp string, block long, way binary"), "merkle-ways")


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = COLUMNS, group_col: str = "source",
             tamper_one_in: int = TAMPER_ONE_IN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_copied) for every
    row: its leaf, the roots, the digest of its proof, and the root of the version in which
    its text's A-Z are lower-cased, if its id is tampered with; n_copied is the ancestors that a version copies."""
    id_text = F.col(id_col).cast("string")
    kept = [F.col(c) for c in columns]
    changed = [lower_ascii(F.col(c).cast("string")) if c == text_col else F.col(c) for c in columns]
    leaves = docs.select(
        F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("grp"), leaf_digest(kept).alias("digest"),
        F.when(F.crc32(id_text) % tamper_one_in == 0, leaf_digest(changed)).alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = saved(leaves, "merkle-leaves")
    id_type = leaves.schema["doc_id"].dataType
    placed = _positions(leaves, [F.col("doc_id").asc_nulls_first(), "digest", "row"])
    tree = Tree(placed, ["doc_id", "changed"], "block")
    subroots = saved(tree.done, "merkle-subroots")
    # The tree over the sources: one group, whose nodes are the subroots.
    top_rows = ranked(subroots.select(F.col("grp").alias("key"), F.col("root").alias("digest"), F.lit(0).alias("cls")), [F.col("key").asc_nulls_first()])
    n_groups = subroots.count()
    top = Tree(top_rows.select(F.lit("").alias("grp"), F.col("before_0").alias("pos"), "digest", F.lit(n_groups).cast("long").alias("n"), "key"), ["key"], "top")
    root = top.done.first()["root"] if n_groups else None
    top_ways = top.ways(docs.sparkSession.createDataFrame([("", b"")], "grp string, way binary"))
    tops = top.rounds[0].join(top_ways.select("block", "way"), "block").select(
        "grp", "block", "n", F.transform("rows", lambda r: r["digest"]).alias("digests"), F.transform("rows", lambda r: r["key"]).alias("keys"), "way")
    tops = saved(tops.mapInArrow(_ways, "grp string, block long, way binary").drop("block"), "merkle-tops")
    ways = tree.ways(tops)
    g = lambda df, x: df.withColumnRenamed("grp", x)
    full = tree.rounds[0].join(g(ways, "g2").withColumnRenamed("block", "b2"), F.col("grp").eqNullSafe(F.col("g2")) & (F.col("block") == F.col("b2"))).join(
        broadcast_if_small(g(subroots, "g3").withColumnRenamed("root", "subroot"), 200), F.col("grp").eqNullSafe(F.col("g3")))
    out = full.select("n", "rows", "way", "subroot", F.lit(root).cast("string").alias("root")).mapInArrow(
        _versions(to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, {_SCHEMA}")
    dropped(leaves)
    return out
