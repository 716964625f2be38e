"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sets of J >= t have sizes within a factor t, and differ in at most
(1 - t) / (1 + t) of the sum of their sizes. Sizes fall into bands; an
*instance* holds a band and those sizes above it that can link with it, and
has a bound k on the differences. In an instance the feature domain is cut
into n1 parts and each of those into n2; with n1 * (k2 + 1) > k, some part
holds at most k2 differences, so dropping the right k2 of its n2 pieces leaves
equal projections: all subsets of n2 - k2 pieces are enumerated, and two sets
that link share a signature (instance, part, subset, projection).

Empty projections would put unlike sets together, so they are not signatures.
A set of up to SMALL features that has one adds signatures under the next seed, and
after the last seed its least features (the prefix filter), so that no link of small sets
is lost. For larger sets a link could only be missed if all common features
fell into parts that hold a difference, less likely than 1e-14 for any pair.

Steps, each a Spark job over all rows: equal sets fall together as classes.
Signatures are sent in blocks. A signature of up to PAIRS classes gives their
pairs; a more common one is *open* and keeps the list of its classes. The pairs are verified,
components are formed, and classes of open signatures that are in different components are
tested further: first against the class that is in most open signatures, then
pair by pair, each pair at the least signature it shares. No pair that could link goes
untested unless it is connected already.

Before a pair is tested, its odd sketches are compared: bit i of a set's sketch is the parity of
its features of digest i. Each feature that is in one set only flips a bit at most, so the
bits that differ never exceed the difference of the sets, and a pair whose sketches differ in more than
two linking sets may is out. A sketch has as many bits as the set features, or more (1024, 4096, 16384 and
so on), and folds to the next narrower width by parity, for sets on both sides of a limit.
So near copies of one text that do not link among themselves cost a comparison of
some words each; only for the few pairs left are the sets made and moved, and compared exactly.

Each task forwards at most PAIRS classes of a signature from each batch of texts, so a
signature common to a third of all rows stays small in its reducer.

Defined results: null and empty texts have an empty set, no links, and their
own id as component; null ids count for links but not as the least id (a
component of null ids only has null); repeated rows are copies; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, dropped, saved
from .components import components
from .shingles import WordDigests, mix, parts, shingle_sets

N_WORDS, THRESHOLD_PCT = 5, 80
#: Sets of up to this many features get the extra signatures for empty parts.
SMALL, SEEDS = 64, 3
#: Reducers' blocks for each shuffle partition.
BINS_PER_PARTITION = 4
#: Bits of the narrowest odd sketch, and ratio of neighbouring widths.
SKETCH, WIDER = 1024, 4
#: Classes that a signature may have for all their pairs to be verified at once.
PAIRS = 8
#: Bytes of a signature and of a short key that are sent. Digests that fall together
#: by chance only give pairs that the verification drops.
SENT = 6

_U = np.uint64


def bands(top: int, pct: int = THRESHOLD_PCT) -> list[tuple[int, int]]:
    """Inclusive size bands up to ``top``: the largest size can link with the least."""
    out, low = [], 1
    while low <= top:
        out.append((low, max(low, low * 100 // pct)))
        low = out[-1][1] + 1
    return out


def shape(high: int, pct: int = THRESHOLD_PCT) -> tuple[int, int, int]:
    """(n1, n2, k2) of the instance whose band ends at ``high``."""
    k = (high + high * 100 // pct) * (100 - pct) // (100 + pct)
    if k <= 3:
        return 1, (k + 2 if k else 1), k
    return -(-(k + 1) // 2), 2, 1


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, pct: int = THRESHOLD_PCT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document number) of the sets given as sorted (doc, digest)."""
    size = np.bincount(doc, minlength=n_docs)
    sigs: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    top = int(size.max()) if n_docs else 0
    lows = bands(top, pct)
    for i, (low, high) in enumerate(lows):
        reach = high * 100 // pct
        inside = (size >= low) & (size <= reach)
        if not inside.any():
            continue
        n1, n2, k2 = shape(high, pct)
        for seed in range(SEEDS if low <= SMALL else 1):
            who = np.flatnonzero(inside)
            if not len(who):
                break
            number = np.full(n_docs, -1)
            number[who] = np.arange(len(who))
            own = number[doc]
            e = own >= 0
            x = mix(h[e] + mix(np.array([seed * 1_000_003 + i + 1], _U)))
            cell = own[e] * (n1 * n2) + (x % _U(n1 * n2)).astype(np.int64)
            x = mix(x)
            cells = len(who) * n1 * n2
            count = np.bincount(cell, minlength=cells).reshape(len(who), n1, n2)
            # Sums of 32-bit halves are exact in doubles up to 2**21 features a cell.
            lo = np.bincount(cell, (x & _U(0xFFFFFFFF)).astype(np.float64), cells).astype(_U).reshape(len(who), n1, n2)
            hi = np.bincount(cell, (x >> _U(32)).astype(np.float64), cells).astype(_U).reshape(len(who), n1, n2)
            empty = np.zeros(len(who), bool)
            for c, subset in enumerate(combinations(range(n2), n2 - k2)):
                s = list(subset)
                filled = count[:, :, s].sum(2) > 0
                part = np.arange(n1, dtype=_U)[None, :] + _U((c + 1) << 40) + _U(i << 50) + _U(seed << 60)
                sig = mix(mix(lo[:, :, s].sum(2) + mix(hi[:, :, s].sum(2))) + mix(part))
                d, _ = np.nonzero(filled)
                sigs.append(sig[filled])
                docs.append(who[d])
                empty |= ~filled.all(1)
            inside = np.zeros(n_docs, bool)
            inside[who[empty]] = size[who[empty]] <= SMALL * 100 // pct
        else:
            if low <= SMALL and inside.any():
                # The prefix filter: of s features the s - ceil(t s) + 1 least.
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                keep = size - -(-size * pct // 100) + 1
                e = inside[doc] & (pos < keep[doc])
                sigs.append(mix(h[e] + mix(np.array([(i << 50) + (15 << 60)], _U))))
                docs.append(doc[e])
    if not sigs:
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(docs)


def _keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> list[bytes]:
    """128-bit digest of every set."""
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    return [hashlib.blake2b(h[at[i]:at[i + 1]].tobytes(), digest_size=16).digest() for i in range(n_docs)]


def _short(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:SENT] + bytes(8 - SENT) for k in keys), np.int64)


def _distinct(rows: np.ndarray) -> np.ndarray:
    return np.unique(rows, axis=0) if len(rows) else rows.reshape(0, 2)


def _groups(sig: np.ndarray, key: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records (signature, key), some signatures being open already: the
    distinct records in order, for each whether its signature is open, and the
    number of its signature's first record."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(sig)))
    wide = (size > PAIRS) | np.isin(sig[at], open_)
    return np.stack([sig.view(np.int64), key], 1), np.repeat(wide, size), np.repeat(at, size)


def _all_pairs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs (greater key, lesser key) within signatures of at most PAIRS records."""
    out = [np.empty((0, 2), np.int64)]
    for step in range(1, PAIRS):
        i = np.flatnonzero(np.arange(len(rows)) - step >= first)
        out.append(np.stack([rows[i, 1], rows[i - step, 1]], 1))
    return _distinct(np.concatenate(out))


def _blocks(rows: np.ndarray, bins: int) -> Iterator[tuple[int, bytes]]:
    """Rows (numbers of SENT bytes) by the bin of their first number."""
    bin_ = (rows[:, 0].view(_U) % _U(bins)).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    order = np.argsort(bin_, kind="stable")
    ids, at = np.unique(bin_[order], return_index=True)
    for b, part in zip(ids, np.split(rows[order], at[1:])):
        yield int(b), part.view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    """The rows of a block."""
    sent = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    out = np.zeros((len(sent), 8), np.uint8)
    out[:, :SENT] = sent
    return out.view(np.int64).reshape(-1, 2)


# What blocks hold: records of signatures, records of open ones (one each),
# pairs, and the classes of open signatures.
RECORD, OPEN, PAIR, MEMBER = range(4)

_BLOCKS = "bin int, kind int, data binary"


def _send(bins: int, n_words: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, seen = WordDigests(), set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in parts(texts):
                doc, h = shingle_sets(texts[part], n_words, digests)
                n = part.stop - part.start
                keys = _keys(doc, h, n)
                # A copy met before in this task adds nothing.
                fresh = np.array([not (k in seen or seen.add(k)) for k in keys], bool)
                e = fresh[doc] if n else np.zeros(0, bool)
                sig, d = signatures(doc[e], h[e], n, pct)
                sig = sig >> _U(64 - 8 * SENT)
                rows, wide, first = _groups(sig, _short(keys)[d], np.empty(0, _U))
                own = np.arange(len(rows)) == first
                out = [(i, kind, x) for kind, part_ in (
                    (RECORD, rows[~wide]), (OPEN, rows[wide & own]), (MEMBER, rows[wide])) for i, x in _blocks(np.ascontiguousarray(part_), bins)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["bin", "kind", "data"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    got = {k: [np.empty((0, 2), np.int64)] for k in (RECORD, OPEN, MEMBER)}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data")):
        got[kind].append(_unpacked(data.as_buffer()))
    got = {k: np.concatenate(v) for k, v in got.items()}
    both = np.concatenate([got[RECORD], got[OPEN]])
    rows, wide, first = _groups(both[:, 0].copy().view(_U), both[:, 1].copy(), got[OPEN][:, 0].copy().view(_U))
    pairs = _all_pairs(rows, np.where(wide, np.arange(len(rows)), first))
    members = _distinct(np.concatenate([got[MEMBER], rows[wide]]))
    out = np.concatenate([pairs, members])
    return pa.table({"kind": pa.array(np.repeat([PAIR, MEMBER], [len(pairs), len(members)]), pa.int32()),
                     "a": pa.array(out[:, 0].copy()), "b": pa.array(out[:, 1].copy())})


def _members(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for b in batches:
            texts, ids, nameless = b.column(1).to_pylist(), b.column(0), b.column(2)
            for part in parts(texts):
                doc, h = shingle_sets(texts[part], n_words, digests)
                n = part.stop - part.start
                keys = _keys(doc, h, n)
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start:part.stop], nameless[part.start:part.stop], pa.array(keys, pa.binary()), pa.array(_short(keys)),
                     pa.array(np.bincount(doc, minlength=n))], ["doc_id", "nameless", "key", "short", "n_shingles"])

    return run


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """A set's sketch as words of 64 bits."""
    bits = SKETCH
    while bits < len(h):
        bits *= WIDER
    return np.packbits(np.bincount((h % _U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _close(x_size: Column, x: Column, y_size: Column, y: Column, pct: int) -> Column:
    """Whether the sizes and sketches of two sets allow a link."""
    count = lambda u, v: F.bit_count(u.bitwiseXOR(v))
    total = lambda words: F.aggregate(words, F.lit(0), lambda n, k: n + k)

    def folded(wide: Column, narrow: Column) -> Column:
        n = F.size(narrow)
        return total(F.transform(narrow, lambda v, i: count(v, functools.reduce(Column.bitwiseXOR, [F.get(wide, i + n * k) for k in range(WIDER)]))))

    # The narrowest sketches, nearly all, word by word: this much is compiled.
    words = SKETCH // 64
    narrowest = functools.reduce(lambda p, q: p + q, [count(F.get(x, F.lit(i)), F.get(y, F.lit(i))) for i in range(words)])
    nx, ny = F.size(x), F.size(y)
    apart = F.when((nx == words) & (ny == words), narrowest).when(nx == ny, total(F.zip_with(x, y, count))).when(nx > ny, folded(x, y)).otherwise(folded(y, x))
    sizes = 100 * F.least(x_size, y_size) >= pct * F.greatest(x_size, y_size)
    return F.when(sizes, apart * (100 + pct) <= (x_size + y_size) * (100 - pct)).otherwise(F.lit(False))


def _near_pairs(pairs: DataFrame, names: DataFrame, on: str, pct: int) -> DataFrame:
    """Of pairs (a, b) of classes, named by the column ``on`` of ``names``, those of keys that may link, in the same order."""
    side = lambda c: names.select(F.col(on).alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("key", "size", "odd")])
    c = F.col
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        (c("a_key") != c("b_key")) & _close(c("a_size"), c("a_odd"), c("b_size"), c("b_odd"), pct)).select(
        c("a_key").alias("a"), c("b_key").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(n_words: int, sketches: bool):
    """Of texts: (key, short, size, odd), or (key, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in parts(texts):
                doc, h = shingle_sets(texts[part], n_words, digests)
                n = part.stop - part.start
                at = np.searchsorted(doc, np.arange(n + 1))
                keys = _keys(doc, h, n)
                sets = [h[at[i]:at[i + 1]] for i in range(n)]
                if sketches:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array(_short(keys)), pa.array([len(x) for x in sets], pa.int64()),
                         pa.array(list(map(odd_sketch, sets)), pa.list_(pa.int64()))], ["key", "short", "size", "odd"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "features"])

    return run


def _verify(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if 100 * min(len(x), len(y)) < pct * max(len(x), len(y)):
                    ok.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= pct * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class Texts:
    """The text of one row of each class: of the one that ``one`` names by its id, or by its digest if it has none."""

    def __init__(self, docs: DataFrame, one: DataFrame, n_words: int):
        self.docs, self.one, self.n_words = docs, one, n_words

    def of(self, keys: DataFrame | None) -> DataFrame:
        one = self.one if keys is None else self.one.join(broadcast_if_small(keys, 16), "key", "left_semi")
        texts = self.docs.join(broadcast_if_small(one.where("doc_id is not null").select("doc_id").distinct(), 8), "doc_id", "left_semi").select("text")
        alone = one.where("doc_id is null").select("nameless").distinct()
        if not alone.isEmpty():
            # Classes that have null ids only: copies fall together, as one row stands for a class.
            texts = texts.unionByName(self.docs.where("doc_id is null").join(broadcast_if_small(alone, 8), "nameless", "left_semi").dropDuplicates(
                ["nameless", "text"]).select("text"))
        return texts

    def sketches(self) -> DataFrame:
        """(key, short, size, odd) of every class, once."""
        got = self.of(None).mapInArrow(_sets(self.n_words, True), "key binary, short long, size long, odd array<long>")
        return got.join(broadcast_if_small(self.one.select("key"), 16), "key", "left_semi").dropDuplicates(["key"])

    def features(self, keys: DataFrame) -> DataFrame:
        """(key, features) of some classes."""
        got = self.of(keys).mapInArrow(_sets(self.n_words, False), "key binary, features binary")
        return got.join(broadcast_if_small(keys, 16), "key", "left_semi")


def _linked(pairs: DataFrame, texts: Texts, pct: int) -> DataFrame:
    """The pairs of keys (a, b) whose sets link. Only sets in a pair are made and moved."""
    few = saved(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "partenum-few")
    own = saved(texts.features(few), "partenum-sets")
    x, y = (own.select(F.col("key").alias(c), F.col("features").alias(f)) for c, f in (("a", "x"), ("b", "y")))
    out = saved(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(pct), "a binary, b binary").distinct(), "partenum-links")
    dropped(few, own)
    return out


def _apart(open_: DataFrame, names: DataFrame, label: DataFrame) -> DataFrame:
    """(sig, key, component) of open signatures with several components."""
    rows = names.select("short", "key").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = open_.select(F.col("a").alias("sig"), F.col("b").alias("short")).join(rows, "short").select("sig", "key", "component")
    rows = saved(rows, "partenum-members")
    split = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    out = saved(rows.join(split, "sig", "left_semi"), "partenum-apart")
    dropped(rows)
    return out


def _more_links(open_: DataFrame, names: DataFrame, texts: Texts, first: DataFrame, links: DataFrame, label: DataFrame, pct: int) -> DataFrame:
    """The components of all links, with the pairs of open signatures that
    are apart tested: first with the class that is in most of them, then each pair."""
    rest = _apart(open_, names, label)
    links_, tested, done = links, first, []
    for step in ("center", "pair"):
        if step == "center":
            often = rest.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
            best = rest.join(often, "key").groupBy("sig").agg(F.max(F.struct("often", "key", "component")).alias("z"))
            stars = rest.join(best, "sig").where(F.col("component") != F.col("z.component")).select(F.col("key").alias("a"), F.col("z.key").alias("b")).distinct()
            # One centre for each class: this step need not find all, the next one does.
            near = _near_pairs(stars, names, "key", pct)
            pairs = _ordered(near.groupBy("a").agg(F.min("b").alias("b")))
        else:
            # Only the sketch is moved besides; a pair that shares several signatures is made at each.
            rows = saved(rest.join(names.select("key", "size", "odd"), "key"), "partenum-sketched")
            done.append(rows)
            c = F.col
            pairs = rows.alias("x").join(rows.alias("y"), (c("x.sig") == c("y.sig")) & (c("x.key") < c("y.key")) & (c("x.component") != c("y.component"))
                                         & _close(c("x.size"), c("x.odd"), c("y.size"), c("y.odd"), pct)).select(c("x.key").alias("a"), c("y.key").alias("b"))
        pairs = saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), f"partenum-{step}")
        found = _linked(pairs, texts, pct)
        done += [rest, pairs, found]
        if not found.isEmpty():
            links_ = links_.unionByName(found)
            done.append(label)
            label = saved(components(links_), "partenum-labels")
        tested = tested.unionByName(pairs)
        if step == "center":
            rest = _apart(open_, names, label)
    dropped(*done)
    return label


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
                 threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark, pct = docs.sparkSession, threshold_pct
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A row without an id is found again by its text's digest.
    d = d.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    id_type = d.schema["doc_id"].dataType.simpleString()
    members = saved(d.mapInArrow(_members(n_words), f"doc_id {id_type}, nameless long, key binary, short long, n_shingles long"), "partenum-members")
    bins = BINS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = saved(d.select("text").mapInArrow(_send(bins, n_words, pct), _BLOCKS).groupBy("bin").applyInArrow(
        _meet, "kind int, a long, b long").distinct(), "partenum-met")
    near, open_ = met.where(F.col("kind") == PAIR).select("a", "b"), met.where(F.col("kind") == MEMBER)

    # The classes that share a signature, each read from one row.
    in_pair = near.select(F.explode(F.array("a", "b")).alias("short")).unionByName(open_.select(F.col("b").alias("short"))).distinct()
    one = members.where("n_shingles > 0").groupBy("key", "short").agg(
        F.min("doc_id").alias("doc_id"), F.min("nameless").alias("nameless")).join(in_pair, "short", "left_semi")
    one = saved(one.select("doc_id", "nameless", "key"), "partenum-one")
    texts = Texts(d, one, n_words)
    names = saved(texts.sketches(), "partenum-names")
    # Short digests that two classes share give pairs of both; a class is no pair with itself.
    first = _ordered(_near_pairs(near, names, "short", pct))
    first = saved(first, "partenum-first")
    links = _linked(first, texts, pct)
    label = saved(components(links), "partenum-labels")
    label = _more_links(open_, names, texts, first, links, label, pct)
    dropped(met, one, names, first, links)

    group = members.drop("nameless").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = group.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return group.join(least, "component").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
                threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """The rows of ``docs`` without all but the least id of each component.
    Rows that repeat an id and a text are copies, of which one stays; rows
    without an id stay."""
    found = saved(similar_sets(docs, id_col, text_col, n_words, threshold_pct), "partenum-found")
    ids = lambda df: df.select(F.col("doc_id").alias(id_col)).distinct()
    d = docs.join(ids(found.where("doc_id <> component_id")), id_col, "left_anti")
    again = ids(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1"))
    if again.isEmpty():
        return d.select(docs.columns)
    return d.join(again, id_col, "left_anti").select(docs.columns).unionByName(
        d.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(docs.columns))
