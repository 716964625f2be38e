"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else.

1. Texts are cut at content-defined places (window minima of gram digests), the same
   in every occurrence of a string but near its ends. Anchors, sparse places,
   carry the digest of the ANCHOR_BYTES that follow; every repeated string
   holds an anchor whose digest occurs at another place, so only texts and
   stretches about such anchors go on. Nothing repeated is lost here.
2. The stretches are written as sequences of phrases, finer pieces of the same
   kind. Their suffixes are sorted by the difference cover modulo 3: the
   suffixes at places 1 and 2 modulo 3 are named by their triples' places in a sort; equal
   names are told apart by recursion on the sequence of names (until names
   differ or cover LENGTH bytes); the suffixes at 0 modulo 3 are
   merged in by (phrase, rank) and (phrase, phrase, rank), as running counts
   over two sorted unions. Each sort is a range-partitioned Spark sort with
   ties spread by place, so equal phrases never meet in one task.
3. Adjacent suffixes are compared, in runs of RUN places of the order: the longest common
   prefix, in whole phrases, tells for nearly every byte whether its string is repeated, or cannot be.
   What a comparison needs of a suffix is made and moved once, then.
4. Starts that phrases leave open, within a phrase of an end of a repeat, are
   settled byte by byte: the digest of their LENGTH bytes is looked for among the
   starts by equal anchors. Digests travel in blocks of 8 bytes each, those of neighbouring
   starts mostly together.

A table of a step is deleted once nothing reads it any more.

Equal texts are one text: the anchors of a copy count as the same place, and a
text of LENGTH bytes or more held by several rows goes whole.

Digests have 64 bits (a text's key 128); a collision could remove a string that
is not repeated, with probability n**2 / 2**65 for n strings compared.

Defined results: null and empty texts have 0 bytes and nothing removed; texts
shorter than LENGTH stay whole; repeated rows count as copies; a null id is
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, saved, whole_text
from .shingles import mix

LENGTH = 400
#: Anchors: gram and window of their places, bytes of their digest. Among the
#: first ANCHOR_WINDOW places of a string is one, and its bytes end within LENGTH.
GRAM, ANCHOR_WINDOW, ANCHOR_BYTES = 32, 150, 250
#: Phrases: gram and window; none is longer than the window.
PHRASE_GRAM, PHRASE_WINDOW = 16, 100
#: Bytes of texts taken together; what is made of them takes over 100 times as many.
BUFFER = 500_000
#: Starts whose digests are sorted together before they are sent.
SENT = 500_000
#: While a table is written: texts go to Python in batches of few bytes, and partitions are no smaller than this
#: where there are many (every task that writes a file starts processes to set its rights).
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24m"}
#: Windows whose minima are taken together; their places fit PLACE_BITS.
SPAN, PLACE_BITS = 1 << 16, 24
#: A repeated string holds a phrase cut in its first PHRASE_WINDOW places, and
#: another this far or further from its start; whole phrases lie between.
LAST_CUT = LENGTH - PHRASE_GRAM - PHRASE_WINDOW + 1
#: Neighbours in the order that are compared together.
RUN = 4096
#: Bytes after an anchor, or a phrase's start, that matter.
REACH = LENGTH + PHRASE_WINDOW
#: Reducers' blocks of digests for each shuffle partition.
BINS_PER_PARTITION = 4

_U = np.uint64
_R = 0x9E3779B97F4A7C15


#: Tables made once in a worker (a plain dict: cached functions can't be sent by value).
_TABLES: dict = {}


def _bytes_table() -> np.ndarray:
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    return _TABLES["bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse, ``n`` or more of each."""
    if len(_TABLES.get("powers", ((),))[0]) < n:
        out = []
        for r in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(n, r, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _TABLES["powers"] = out[0], out[1]
    return _TABLES["powers"]


class Digests:
    """Digests of all substrings of a buffer."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, (len(data) + 1).bit_length())
        power, self.inverse = _powers(size)
        self.sum = np.zeros(len(data) + 1, _U)
        np.cumsum(_bytes_table()[data] * power[:len(data)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))

    def grams(self, first: int, n: int, gram: int) -> np.ndarray:
        """Those of ``gram`` bytes, at ``n`` places from the first."""
        z = first + n
        return mix((self.sum[first + gram:z + gram] - self.sum[first:z]) * self.inverse[first:z] + _U(gram * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))


def _least(d: Digests, n: int, gram: int, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of the windows, SPAN at a time: the first one's place, and for each the place of its least gram digest, the
    leftmost on ties (places in a key count from the span's first)."""
    windows = n - gram - window + 2
    for first in range(0, max(0, windows), SPAN):
        k = min(SPAN, windows - first)
        m = k + window - 1
        # The place in the low bits: unique, and leftmost on ties.
        key = (d.grams(first, m, gram) >> _U(PLACE_BITS) << _U(PLACE_BITS)) | np.arange(m).astype(_U)
        rows = -(-m // window)
        padded = np.full(rows * window, np.iinfo(np.uint64).max, _U)
        padded[:m] = key
        grid = padded.reshape(rows, window)
        left = np.minimum.accumulate(grid, 1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        yield first, (np.minimum(right[:k], left[window - 1:m]) & _U((1 << PLACE_BITS) - 1)).astype(np.int64) + first


def _minima(d: Digests, n: int, end: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places that hold the least gram digest of some window, the leftmost on
    ties; ``end`` is the end of each place's text. A text of any length."""
    out = [np.empty(0, np.int64)]
    for first, least in _least(d, n, gram, window):
        k = len(least)
        least = least[np.arange(first + window + gram - 1, first + k + window + gram - 1) <= end[first:first + k]]
        # The least of later windows lie later.
        out.append(least[np.append(True, least[1:] != least[:-1])] if len(least) else least)
    return np.unique(np.concatenate(out))


class Buffer:
    """Some texts end to end."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.cumsum(size) - size
        self.size = size
        self.text = np.repeat(np.arange(len(texts)), size)
        self.end = np.repeat(self.start + size, size)
        self.digests = Digests(self.data)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        p = _minima(self.digests, len(self.data), self.end, GRAM, ANCHOR_WINDOW)
        p = p[p + ANCHOR_BYTES <= self.end[p]]
        return p, self.digests.of(p, p + ANCHOR_BYTES)

    def homes(self, at: np.ndarray) -> np.ndarray:
        """The same number for equal strings of LENGTH bytes, and mostly for neighbours: the digest of the least gram in the first window."""
        least = np.concatenate([np.empty(0, np.int64), *(x for _, x in _least(self.digests, len(self.data), GRAM, ANCHOR_WINDOW))])[at]
        return self.digests.of(least, least + GRAM)

    def cuts(self) -> np.ndarray:
        return _minima(self.digests, len(self.data), self.end, PHRASE_GRAM, PHRASE_WINDOW)


def _buffers(texts: list[bytes]) -> Iterator[list[int]]:
    part, n = [], 0
    for i, t in enumerate(texts):
        if part and n + len(t) > BUFFER:
            yield part
            part, n = [], 0
        part.append(i)
        n += len(t)
    if part:
        yield part


def _utf8(col: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("pos", pa.int32()), ("h", pa.int64())])
    seen: set[bytes] = set()
    for b in batches:
        texts = [t for t in _utf8(b.column(0)) if len(t) >= LENGTH]
        for part in _buffers(texts):
            mine, keys = [], []
            for i in part:
                k = hashlib.md5(texts[i], usedforsecurity=False).digest()
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    mine.append(texts[i])
            if not mine:
                continue
            buf = Buffer(mine)
            p, h = buf.anchors()
            who, pos = buf.text[p], p - buf.start[buf.text[p]]
            yield _batch(schema, pa.array(keys, pa.binary()).take(pa.array(who)), pos.astype(np.int32), h.view(np.int64))


def _marked_phrases(b: pa.RecordBatch, part: list[int], texts: list[bytes]) -> tuple | None:
    """Of some texts: (buffer, cuts, the phrases' ends, numbers of the phrases within reach of an anchor)."""
    buf = Buffer([texts[i] for i in part])
    anchors = [np.frombuffer(b.column("anchors")[i].as_buffer(), np.int64).reshape(-1, 2)[:, 0] for i in part]
    cut = buf.cuts()
    if not len(cut):
        return None
    # A phrase runs to the next cut of its text, or the text's end.
    nxt = np.append(cut[1:], len(buf.data))
    nxt = np.minimum(nxt, buf.end[cut])
    p = np.concatenate([a + buf.start[k] for k, a in enumerate(anchors)])
    delta = np.zeros(len(buf.data) + 1, np.int64)
    np.add.at(delta, np.maximum(p - ANCHOR_WINDOW, buf.start[buf.text[p]]), 1)
    np.add.at(delta, np.minimum(p + REACH, buf.end[p]), -1)
    return buf, cut, nxt, np.cumsum(delta)[cut] > 0


def _ends(buf: Buffer, cut: np.ndarray, nxt: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of the phrases that end where a comparison from each place looks."""
    a = np.searchsorted(nxt, cut[row] + LAST_CUT - PHRASE_WINDOW)
    z = np.searchsorted(nxt, cut[row] + REACH, "right")
    stop = np.searchsorted(cut, buf.end[cut[row]])
    return np.minimum(a, stop), np.minimum(z, stop)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, t, s, x, sym, sym1, sym2, n): the phrases of the stretches. s numbers the
    stretch (by its first place), x the phrase in it; sym1 and sym2 are the next two there (the least number
    past its end), n is the number of phrases a comparison spans."""
    schema = pa.schema([("tid", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("x", pa.int64()),
                        *((c, pa.int64()) for c in ("sym", "sym1", "sym2")), ("n", pa.int32())])
    for b in batches:
        texts, tids = _utf8(b.column("text")), b.column("tid").to_numpy(zero_copy_only=False)
        for part in _buffers(texts):
            if (got := _marked_phrases(b, part, texts)) is None:
                continue
            buf, cut, nxt, keep = got
            sym = np.append(buf.digests.of(cut, nxt).view(np.int64), [0, 0])
            new = np.ones(len(cut), bool)
            new[1:] = (buf.text[cut[1:]] != buf.text[cut[:-1]]) | ~keep[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(cut)), 0))
            row = np.flatnonzero(keep)
            z = _ends(buf, cut, nxt, row)[1]
            goes_on = np.append(keep[1:] & ~new[1:], [False, False, False])
            one = goes_on[row]
            past = np.iinfo(np.int64).min
            sym1, sym2 = np.where(one, sym[row + 1], past), np.where(one & goes_on[row + 1], sym[row + 2], past)
            pos = cut - buf.start[buf.text[cut]]
            tid = tids[part][buf.text[cut]]
            # A stretch's number from its text and first place.
            s = (mix(tid.astype(_U) * _U(_R) + pos[first].astype(_U)) >> _U(16)).astype(np.int64)
            yield _batch(schema, tid[row], pos[row], s[row], row - first[row], sym[row], sym1, sym2, (z - row).astype(np.int32))


_PLACED = "run long, at long, tid long, t long, prefix binary"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases again, each with its place in the order and its prefix: the ends and digests that a comparison needs."""
    schema = pa.schema([("run", pa.int64()), ("at", pa.int64()), ("tid", pa.int64()), ("t", pa.int64()), ("prefix", pa.binary())])
    for b in batches:
        texts, tids = _utf8(b.column("text")), b.column("tid").to_numpy(zero_copy_only=False)
        for part in _buffers(texts):
            if (got := _marked_phrases(b, part, texts)) is None:
                continue
            buf, cut, nxt, keep = got
            row = np.flatnonzero(keep)
            a, z = _ends(buf, cut, nxt, row)
            k = z - a
            ends = nxt[np.repeat(a, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))]
            begin = np.repeat(cut[row], k)
            # 48 bits of digest and the end, in a word.
            pair = (buf.digests.of(begin, ends) >> _U(16) << _U(16) | (ends - begin).astype(_U)).tobytes()
            offs = np.concatenate([[0], np.cumsum(k)]) * 8
            order = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for i in part if (x := b.column("places")[i]).is_valid]
            order = np.concatenate([np.empty((0, 2), np.int64), *order])
            pos = (cut - buf.start[buf.text[cut]])[row]
            assert np.array_equal(order[:, 0], pos)
            at = order[:, 1]
            yield _batch(schema, at // RUN, at, tids[part][buf.text[cut[row]]], pos, [pair[i:j] for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())])


# -- global ranks


def _running(schema: pa.Schema, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), np.zeros(classes, np.int64)
        for b in batches:
            c = b.column("cls").to_numpy(zero_copy_only=False)
            cols = []
            for k in range(classes):
                n = np.cumsum(c == k)
                cols.append(pa.array(before[k] + n - (c == k)))
                before[k] += n[-1] if len(n) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(c), part, np.int32)), *cols],
                                             [*b.schema.names, "part", *[f"before_{k}" for k in range(classes)]])

    return run


def ranked(df: DataFrame, order: list, classes: int = 1, keep: list[str] | None = None, writing: dict[str, str] | None = None) -> DataFrame:
    """``df`` (with ``cls``; once sorted, its columns ``keep`` only) and, for each class, how many of its rows come
    before a row in the order: counts within the range partitions of a sort,
    and the totals of earlier partitions."""
    df = df.orderBy(*order)
    df = df if keep is None else df.select(*keep)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    more = ", ".join(f"before_{k} long" for k in range(classes))
    rows = saved(df.mapInArrow(_running(None, classes), f"{types}, part int, {more}"), "suffix-rank", writing)
    total = rows.groupBy("part").agg(*[F.sum((F.col("cls") == k).cast("long")).alias(f"sum_{k}") for k in range(classes)])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    total = total.select("part", *[F.coalesce(F.sum(f"sum_{k}").over(earlier), F.lit(0)).alias(f"sum_{k}") for k in range(classes)])
    out = rows.join(F.broadcast(total), "part")
    for k in range(classes):
        out = out.withColumn(f"before_{k}", F.col(f"before_{k}") + F.col(f"sum_{k}"))
    out = out.drop("part", *[f"sum_{k}" for k in range(classes)])
    out.saved_path = rows.saved_path
    return out


_NAMED = "s long, x long, part int, start long, n long, repeats long, first binary, last binary"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their triples: the place in the partition where the row's triple starts. A last row,
    the only one with n, tells the partition's rows, how many have the triple before them, its first and last triple and where that starts."""
    from pyspark import TaskContext

    schema = pa.schema([("s", pa.int64()), ("x", pa.int64()), ("part", pa.int32()), ("start", pa.int64()),
                        ("n", pa.int64()), ("repeats", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
    part, n, start, repeats, first, last = TaskContext.get().partitionId(), 0, 0, 0, None, None
    for b in batches:
        if not len(b):
            continue
        triple = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("sym", "sym1", "sym2")], 1)
        first = triple[0] if n == 0 else first
        new = (triple != np.concatenate([triple[:1] if n == 0 else last, triple[:-1]])).any(1)
        new[0] |= n == 0
        at = np.maximum.accumulate(np.where(new, n + np.arange(len(b)), start))
        n, start, repeats, last = n + len(b), int(at[-1]), repeats + int((~new).sum()), triple[-1:]
        none = [pa.nulls(len(b), f.type) for f in list(schema)[4:]]
        yield _batch(schema, b.column("s"), b.column("x"), np.full(len(b), part, np.int32), at, *none)
    if n:
        yield _batch(schema, [None], [None], [part], [start], [n], [repeats], [first.tobytes()], [last.tobytes()])


def _names(sample: DataFrame) -> tuple[DataFrame, bool, DataFrame]:
    """(s, x, v): how many rows have a smaller triple (sym, sym1, sym2); whether rows share one; and the table to delete."""
    rows = saved(sample.orderBy("sym", "sym1", "sym2", "s", "x").mapInArrow(_named, _NAMED), "suffix-names", WRITING)
    by_part = Window.orderBy("part")  # a row for each partition
    parts = rows.where("n is not null").select(
        "part", "start", "repeats", F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
        F.coalesce(F.lag("last").over(by_part) == F.col("first"), F.lit(False)).alias("goes_on"))
    # Where the last triple of a partition starts, which may be an earlier one.
    starts = F.last(F.when(~F.col("goes_on") | (F.col("start") > 0), F.col("earlier") + F.col("start")), True)
    parts = parts.withColumn("starts", starts.over(by_part.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("head", F.when(F.col("goes_on"), F.lag("starts").over(by_part)).otherwise(F.col("earlier")))
    shared = not parts.where("goes_on or repeats > 0").isEmpty()
    v = F.when(F.col("start") == 0, F.col("head")).otherwise(F.col("earlier") + F.col("start")).alias("v")
    return rows.where("n is null").join(F.broadcast(parts.select("part", "earlier", "head")), "part").select("s", "x", v), shared, rows


def _before(rows: DataFrame, need: int, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(s, x, v): the sum of a suffix's v is the number of suffixes before it. And the written tables that this is read from."""
    seq = Window.partitionBy("s").orderBy("x")
    spent = []
    if "sym1" not in rows.columns:
        ahead = lambda k: F.lead("sym", k, -1 << 63).over(seq)
        rows = saved(rows.withColumns({"sym1": ahead(1), "sym2": ahead(2)}), "suffix-triples", WRITING)
        spent = [rows]
    before, shared, names = _names(rows.where("x % 3 <> 0").select("s", "x", "sym", "sym1", "sym2"))
    spent.append(names)
    if shared and 3 ** (level + 1) < need:
        # The sequences of names, of the places 1 and 2 modulo 3 each.
        deeper = before.select((F.col("s") * 2 + F.col("x") % 3 - 1).alias("s"), F.expr("x div 3").alias("x"), F.col("v").alias("sym"))
        deeper, more = _before(deeper, need, level + 1)
        spent += more
        before = deeper.select(F.shiftright("s", 1).alias("s"), (F.col("x") * 3 + F.col("s") % 2 + 1).alias("x"), "v")
    # Places and counts meet by sequence; ranks at x, x + 1 and x + 2, 0 past the end.
    no = F.lit(None).cast("long").alias
    both = rows.select("s", "x", "sym", "sym1", no("v")).unionByName(before.select("s", "x", no("sym"), no("sym1"), "v"))
    both = both.repartition("s").groupBy("s", "x").agg(F.max("sym").alias("sym"), F.max("sym1").alias("sym1"), (F.sum("v") + 1).alias("rank"))
    rank = lambda k: F.coalesce(F.lead("rank", k).over(seq), F.lit(0))
    full = saved(both.select("s", "x", (F.col("x") % 3).cast("int").alias("m"), "sym", "sym1", "rank", rank(1).alias("r1"), rank(2).alias("r2")), "suffix-merge", WRITING)
    dropped(*spent)
    at = ["s", "x"]
    # Those before a sample among the samples are known from its rank.
    merge = lambda m, *key: ranked(
        full.where(F.col("m").isin(0, m)).select(*at, *key, (F.col("rank") - 1).alias("own"), F.when(F.col("m") == m, 1).otherwise(0).alias("cls")),
        [*key, *at], 2, [*at, "own", "cls"], WRITING)
    ones, twos = merge(1, "sym", "r1"), merge(2, "sym", "sym1", "r2")
    dropped(full)
    v = lambda zero: F.when(F.col("cls") == 0, zero).otherwise(F.col("before_0") + F.col("own")).alias("v")
    parts = ones.select(*at, v(F.col("before_0") + F.col("before_1"))).unionByName(twos.select(*at, v(F.col("before_1"))))
    return parts, [ones, twos]


def suffix_ranks(rows: DataFrame, need: int, held: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """(s, x, held columns, rank) of the suffixes of sequences (s, x, sym; with sym1 and sym2, the next two, if at hand): the difference
    cover algorithm. Suffixes that agree on ``need`` symbols have neighbouring
    ranks in any order, or share some. And the written tables that the result is read from."""
    parts, spent = _before(rows, need)
    parts = rows.select("s", "x", F.lit(0).cast("long").alias("v"), *held).unionByName(parts, allowMissingColumns=True)
    return parts.groupBy("s", "x").agg(*[F.max(c).alias(c) for c in held], (F.sum("v") + 1).alias("rank")), spent


def _common(x: list[bytes | None], y: list[bytes | None]) -> np.ndarray:
    """Bytes that each two suffixes share, as far as the ends in their prefixes tell."""
    words, begin, size = [], [], []
    for p in (x, y):
        size.append(np.fromiter((len(b or b"") // 8 for b in p), np.int64, len(p)))
        begin.append(np.cumsum(size[-1]) - size[-1])
        words.append(np.frombuffer(b"".join(b or b"" for b in p), np.int64))
    n = np.minimum(*size)
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    other = np.flatnonzero(words[0][begin[0][which] + k] != words[1][begin[1][which] + k])
    shared = n.copy()
    # The first word that differs: written last.
    shared[which[other[::-1]]] = k[other[::-1]]
    out = np.zeros(len(n), np.int64)
    some = np.flatnonzero(shared)
    out[some] = words[0][begin[0][some] + shared[some] - 1] & 0xFFFF
    return out


_ADJACENT = "tid long, t long, common long, run long, edge int, prefix binary"


def _adjacent(table: pa.Table) -> pa.Table:
    """Of a run: the most bytes that each suffix shares with the one before or after; its
    first (edge 1) and last row (edge 2) also go out with their prefix."""
    table = table.take(pa.array(np.argsort(table.column("at").to_numpy())))
    prefix, n = table.column("prefix").to_pylist(), len(table)
    common = np.zeros(n + 1, np.int64)
    common[1:n] = _common(prefix[:-1], prefix[1:])
    best = np.maximum(common[:-1], common[1:])
    some = np.flatnonzero(best)
    row = np.concatenate([some, [0, n - 1]])
    edge = np.concatenate([np.zeros(len(some), np.int32), [1, 2]])
    return pa.table({
        "tid": table.column("tid").take(row), "t": table.column("t").take(row), "common": pa.array(np.concatenate([best[some], [0, 0]]), pa.int64()),
        "run": table.column("run").take(row), "edge": pa.array(edge, pa.int32()),
        "prefix": pa.array([None] * len(some) + [prefix[0], prefix[-1]], pa.binary())})


def _edge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tid", pa.int64()), ("t", pa.int64()), ("common", pa.int64())])
    for b in batches:
        a, t, p, a2, t2, p2 = b.columns
        c = _common(p.to_pylist(), p2.to_pylist())
        some = pa.array(np.flatnonzero(c))
        for x in ((a, t), (a2, t2)):
            yield _batch(schema, *(y.take(some) for y in x), c[c > 0])


def common_prefixes(texts: DataFrame) -> DataFrame:
    """(tid, t, common): the most bytes a suffix shares with a neighbour, for texts with the places of their suffixes."""
    rows = texts.select("tid", "text", "anchors", "places").mapInArrow(_placed, _PLACED)
    near = saved(rows.groupBy("run").applyInArrow(_adjacent, _ADJACENT), "suffix-near", WRITING)
    end = lambda edge, n, run: near.where(F.col("edge") == edge).select(
        run.alias("run"), *[F.col(c).alias(f"{c}{n}") for c in ("tid", "t", "prefix")])
    ends = end(2, "", F.col("run") + 1).join(end(1, "2", F.col("run")), "run").drop("run").mapInArrow(_edge_pairs, "tid long, t long, common long")
    out = near.where("edge = 0").select("tid", "t", "common").unionByName(ends).groupBy("tid", "t").agg(F.max("common").alias("common"))
    out.saved_path = near.saved_path
    return out


# -- the starts


def _starts(b: pa.RecordBatch, part: list[int], texts: list[bytes]) -> tuple[Buffer, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: (buffer, sure, open, anchors, their digests); sure and
    open say of each byte whether the string that starts there is repeated, or may be."""
    buf = Buffer([texts[i] for i in part])
    anchors = [np.frombuffer(b.column("anchors")[i].as_buffer(), np.int64).reshape(-1, 2) for i in part]
    p = np.concatenate([a[:, 0] + buf.start[k] for k, a in enumerate(anchors)])
    h = np.concatenate([a[:, 1] for a in anchors])
    n = len(buf.data)
    cand = np.zeros(n + 1, np.int64)
    np.add.at(cand, np.maximum(p - ANCHOR_WINDOW + 1, buf.start[buf.text[p]]), 1)
    np.add.at(cand, p + 1, -1)
    cand = (np.cumsum(cand)[:n] > 0) & (np.arange(n) + LENGTH <= buf.end)
    common = np.zeros(n, np.int64)
    for k, i in enumerate(part):
        if (c := b.column("common")[i]).is_valid:
            c = np.frombuffer(c.as_buffer(), np.int64).reshape(-1, 2)
            common[buf.start[k] + c[:, 0]] = c[:, 1]
    cut = buf.cuts()
    m = common[cut]
    # Sure: from a cut on, as long as LENGTH bytes of the common prefix are left.
    sure = np.zeros(n + 1, np.int64)
    ok = m >= LENGTH
    np.add.at(sure, cut[ok], 1)
    np.add.at(sure, cut[ok] + m[ok] - LENGTH + 1, -1)
    sure = (np.cumsum(sure)[:n] > 0) & cand
    # Possible: a cut follows within a phrase that shares all whole phrases left.
    may = np.zeros(n + 1, np.int64)
    ok = m > 0
    np.add.at(may, np.maximum(cut[ok] - PHRASE_WINDOW, buf.start[buf.text[cut[ok]]]), 1)
    np.add.at(may, np.minimum(cut[ok], np.maximum(0, cut[ok] + m[ok] - LAST_CUT)) + 1, -1)
    return buf, sure, (np.cumsum(may)[:n] > 0) & cand & ~sure, p, h


def _near_anchor(buf: Buffer, p: np.ndarray) -> np.ndarray:
    d = np.zeros(len(buf.data) + 1, np.int64)
    np.add.at(d, np.maximum(p - ANCHOR_WINDOW + 1, buf.start[buf.text[p]]), 1)
    np.add.at(d, p + 1, -1)
    return np.cumsum(d)[:-1] > 0


def _runs(mask: np.ndarray) -> np.ndarray:
    """First places and ends of the runs of a mask."""
    d = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return d.reshape(-1, 2).astype(np.int32)


def _masked(n: int, runs: bytes | None) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    r = np.frombuffer(runs or b"", np.int32).reshape(-1, 2)
    np.add.at(d, r[:, 0], 1)
    np.add.at(d, r[:, 1], -1)
    return np.cumsum(d)[:n] > 0


_MARKED = "key binary, text string, anchors binary, tid long, sure binary, open binary, hs array<long>, asks array<long>"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with runs of sure and open starts, the digests of their anchors, and of those with an open start before them."""
    for b in batches:
        texts = _utf8(b.column("text"))
        for part in _buffers(texts):
            buf, sure, open_, p, h = _starts(b, part, texts)
            n = np.concatenate([[0], np.cumsum(open_)])
            some = n[p + 1] > n[np.maximum(p - ANCHOR_WINDOW + 1, buf.start[buf.text[p]])]
            out = [[] for _ in range(4)]
            who = buf.text[p]
            for k in range(len(part)):
                a, z = buf.start[k], buf.start[k] + buf.size[k]
                mine = slice(*np.searchsorted(who, [k, k + 1]))
                for c, x in zip(out, (_runs(sure[a:z]).tobytes(), _runs(open_[a:z]).tobytes(), np.unique(h[mine]), np.unique(h[mine][some[mine]]))):
                    c.append(x)
            i = pa.array(part)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(i) for c in ("key", "text", "anchors", "tid")), pa.array(out[0], pa.binary()),
                                              pa.array(out[1], pa.binary()), pa.array(out[2], longs), pa.array(out[3], longs)],
                                             ["key", "text", "anchors", "tid", "sure", "open", "hs", "asks"])


# What blocks hold: digests of starts, digests and places of open starts, and places that are settled.
DIGEST, ASKED, SETTLED = range(3)


def _send(bins: int):
    """Digests of the LENGTH bytes at starts by anchors that open starts ask for, open ones with
    their place. A string that occurs several times among those sent together is sent as two digests, and its open places are settled."""
    names = ["bin", "kind", "g", "tid", "i"]

    def blocks(g: np.ndarray, home: np.ndarray, open_: np.ndarray, tid: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(g, kind="stable")
        g, home, open_, tid, i = g[order], home[order], open_[order], tid[order], i[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(g)))
        several = np.repeat(size > 1, size)
        second = np.concatenate([[False], new[:-1]]) & ~new
        out = []
        for kind, mine in ((DIGEST, (several & (new | second)) | (~several & ~open_)), (ASKED, ~several & open_), (SETTLED, several & open_)):
            e = np.flatnonzero(mine)
            bin_ = ((tid if kind == SETTLED else home)[e].view(_U) % _U(bins)).astype(np.int64)
            # By bin, and there by place: texts' numbers come in runs.
            by_bin = np.lexsort((order[e], bin_))
            e = e[by_bin]
            ids, begin = np.unique(bin_[by_bin], return_index=True)
            for bin_no, x in zip(ids.tolist(), np.split(e, begin[1:])):
                out.append((bin_no, kind, b"" if kind == SETTLED else g[x].tobytes(),
                            b"" if kind == DIGEST else tid[x].tobytes(), b"" if kind == DIGEST else i[x].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            texts, tids, asked = _utf8(b.column("text")), b.column("tid").to_numpy(zero_copy_only=False), b.column("asked")
            for part in _buffers(texts):
                buf = Buffer([texts[i] for i in part])
                pairs = [np.frombuffer(b.column("anchors")[i].as_buffer(), np.int64).reshape(-1, 2) for i in part]
                want = [x[np.isin(x[:, 1], asked[i].values.to_numpy(zero_copy_only=False)), 0] + buf.start[k] for k, (i, x) in enumerate(zip(part, pairs))]
                masks = {c: np.concatenate([_masked(len(texts[i]), b.column(c)[i].as_py()) for i in part]) for c in ("sure", "open")}
                at = np.flatnonzero((masks["sure"] | masks["open"]) & _near_anchor(buf, np.concatenate(want)))
                who = buf.text[at]
                held.append((buf.digests.of(at, at + LENGTH).view(np.int64), buf.homes(at), masks["open"][at], tids[part][who], (at - buf.start[who]).astype(np.int32)))
                n += len(at)
                if n >= SENT:
                    yield blocks(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield blocks(*map(np.concatenate, zip(*held)))

    return run


def _settle(table: pa.Table) -> pa.Table:
    """(tid, places): the open starts whose string occurs twice at least."""
    got = {k: {c: [b""] for c in ("g", "tid", "i")} for k in (DIGEST, ASKED, SETTLED)}
    for kind, *cols in zip(*(table.column(c).to_pylist() for c in ("kind", "g", "tid", "i"))):
        for c, x in zip(("g", "tid", "i"), cols):
            got[kind][c].append(x)
    all_ = lambda kind, c, t: np.frombuffer(b"".join(got[kind][c]), t)
    asked = all_(ASKED, "g", np.int64)
    values, which, count = np.unique(np.concatenate([all_(DIGEST, "g", np.int64), asked]), return_inverse=True, return_counts=True)
    yes = count[which[len(which) - len(asked):]] > 1
    tid = np.concatenate([all_(ASKED, "tid", np.int64)[yes], all_(SETTLED, "tid", np.int64)])
    i = np.concatenate([all_(ASKED, "i", np.int32)[yes], all_(SETTLED, "i", np.int32)])
    order = np.argsort(tid, kind="stable")
    tid, i = tid[order], i[order]
    ids, begin = np.unique(tid, return_index=True)
    return pa.table({"tid": pa.array(ids, pa.int64()), "places": pa.array([x.tobytes() for x in np.split(i, begin[1:])][:len(ids)], pa.binary())})


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for b in batches:
        texts = _utf8(b.column("text"))
        for part in _buffers(texts):
            removed, spans, sha = [], [], []
            for i in part:
                data = np.frombuffer(texts[i], np.uint8)
                sure = _masked(len(data), b.column("sure")[i].as_py())
                sure[np.frombuffer(b"".join(b.column("settled")[i].as_py() or []), np.int32)] = True
                start = np.flatnonzero(sure)
                d = np.zeros(len(data) + 1, np.int64)
                np.add.at(d, start, 1)
                np.add.at(d, start + LENGTH, -1)
                g = np.cumsum(d)[:-1] > 0
                removed.append(int(g.sum()))
                spans.append(int((g[1:] & ~g[:-1]).sum() + g[:1].sum()))
                sha.append(hashlib.sha256(data[~g].tobytes()).hexdigest())
            yield _batch(schema, [b.column("key")[i].as_py() for i in part], removed, spans, sha)


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    key: Column = F.unhex(F.md5(F.col("text").cast("binary")))
    d = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    # 1. Anchors whose digest occurs at more than one place of different texts or one.
    anchors = saved(d.where(F.octet_length("text") >= LENGTH).select("text").mapInArrow(
        _anchors, "key binary, pos int, h long"), "suffix-anchors", WRITING)
    place = F.xxhash64("key", "pos")
    again = anchors.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h")
    marked = anchors.select("key", "pos", "h").join(again, "h", "left_semi").distinct().groupBy("key").agg(
        F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "h")).alias("list"))
    texts = d.select(key.alias("key"), "text").dropDuplicates(["key"]).join(marked, "key")
    texts = saved(texts.mapInArrow(_packed(["key", "text"], "pos", "h", "anchors"), "key binary, text string, anchors binary").withColumn(
        "tid", F.monotonically_increasing_id()), "suffix-texts", WRITING)
    dropped(anchors)

    # 2. and 3. The suffix sort, and what neighbours share.
    phrases = saved(texts.select("tid", "text", "anchors").mapInArrow(
        _phrases, "tid long, t long, s long, x long, sym long, sym1 long, sym2 long, n int"), "suffix-phrases", WRITING)
    need = phrases.agg(F.max("n")).first()[0] or 0
    ranks, spent = suffix_ranks(phrases, need, ("tid", "t"))
    # Each suffix's own place in the order, also where ranks are shared.
    order = ranked(ranks.withColumn("cls", F.lit(0)), ["rank", "s", "x"], 1, ["tid", "t", "cls"], WRITING)
    dropped(phrases, *spent)
    places = order.groupBy("tid").agg(F.collect_list(F.struct("t", "before_0")).alias("list"))
    held = ["key", "text", "anchors", "tid"]
    with_places = saved(texts.join(places, "tid", "left").mapInArrow(
        _packed(held, "t", "before_0", "places"), "key binary, text string, anchors binary, tid long, places binary"), "suffix-places", WRITING)
    dropped(texts, order)
    near = common_prefixes(with_places)
    common = near.groupBy("tid").agg(F.collect_list(F.struct("t", "common")).alias("list"))
    full = saved(with_places.drop("places").join(common, "tid", "left").mapInArrow(
        lambda batches: _mark(_packed(held, "t", "common", "common")(batches)), _MARKED), "suffix-marked", WRITING)
    dropped(with_places, near)

    # 4. What phrases leave open.
    asked = saved(full.select(F.explode("asks").alias("h")).distinct(), "suffix-asked", WRITING)
    by_text = full.select("tid", F.explode("hs").alias("h")).join(asked, "h", "left_semi").groupBy("tid").agg(F.collect_list("h").alias("asked"))
    bins = BINS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = full.select("tid", "text", "anchors", "sure", "open").join(by_text, "tid").mapInArrow(
        _send(bins), "bin int, kind int, g binary, tid binary, i binary")
    settled = saved(sent.groupBy("bin").applyInArrow(_settle, "tid long, places binary"), "suffix-settled", WRITING)
    by_tid = settled.groupBy("tid").agg(F.collect_list("places").alias("settled"))
    gone = saved(full.select("tid", "key", "text", "sure").join(by_tid, "tid", "left").mapInArrow(
        _cover, "key binary, n_removed long, n_spans long, kept_sha256 string"), "suffix-gone", WRITING).where("n_removed > 0")
    dropped(full, asked, settled)

    slim = d.select("doc_id", key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    copies = slim.where(F.col("n_bytes") >= LENGTH).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    out = slim.join(gone, "key", "left").join(copies, "key", "left")
    all_gone = F.coalesce("copied", F.lit(False))
    return out.select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))


def _pairs(col: pa.Array, a: str, b: str) -> list[bytes | None]:
    out = []
    for x in col:
        if x.is_valid:
            v = x.values
            m = np.stack([v.field(a).to_numpy(zero_copy_only=False), v.field(b).to_numpy(zero_copy_only=False)], 1)
            out.append(m[np.argsort(m[:, 0], kind="stable")].tobytes())
        else:
            out.append(None)
    return out


def _packed(held: list[str], a: str, b: str, name: str):
    """Columns to keep, and the pairs in the column ``list`` as the bytes of 64-bit numbers, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(_pairs(batch.column("list"), a, b), pa.binary())], [*held, name])

    return run
