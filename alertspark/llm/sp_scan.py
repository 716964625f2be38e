"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding finds the segmentation of a text into pieces with the highest sum of
scores. A text longer than CHUNK characters is split into chunks. The state at a
boundary is the number of characters by which the piece across it reaches
into the next chunk, less than the longest piece. A chunk gives a transfer matrix:
the best score from every state at its left to every state at its right. The
max-plus product of matrices is associative, so they are combined in a tree of
groups; going down the tree again fixes the states at all boundaries; then
each chunk is traced on its own between its two states.

A place no piece can cross (before a run of U+2581 that follows another
character, and around characters that stand in no longer piece) cuts a text:
there the state is 0 for certain, and what lies between two cuts adds the same to
every entry of a matrix. Only differences matter, so matrices are shifted to a
greatest entry of 0. A segment met before is looked up. Scores are whole
numbers. The total score does not depend on where chunks end; of segmentations
of equal score, the choice can.

White space and case are kept (identity normalisation with a dummy prefix),
which is what the model files here declare; others are refused. Characters
without a piece become byte pieces. Decoding joins the pieces' bytes, chunk by
chunk. U+2581 in a text decodes as a space, as in the format itself.

Defined results: null and empty texts have no pieces, as one chunk; repeated
rows each give their rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

CHUNK = 32_768
#: Matrices combined by one task in a step of the tree.
GROUP = 256
#: Characters encoded at a time, remembered segments, and the length from
#: which a segment is handled on its own.
BATCH_CHARS, MEMO, LONG = 500_000, 200_000, 48
#: Segments searched together.
TOGETHER = 30_000

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_PENALTY = 10.0
UNIT = 1 << 10
NEVER = -(1 << 61)

_U = np.uint64
_MUL = 0x9E3779B97F4A7C15

def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + n]
            at += n


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, proto: bytes):
        pieces = []
        for number, value in _fields(proto):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
                    raise ValueError("only identity normalisation with a dummy prefix is supported")
        normal = [s for _, s, t in pieces if t == NORMAL]
        top, self.unk = max(normal), int((min(normal) - UNK_PENALTY) * UNIT)
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.out: list[bytes] = []
        self.score = np.zeros(len(pieces), np.int64)
        for i, (p, s, t) in enumerate(pieces):
            if t == BYTE:
                self.byte[int(p[1:-1], 16)] = i
                self.out.append(bytes([int(p[1:-1], 16)]))
                continue
            self.out.append(b"" if t in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode())
            if t in (NORMAL, USER_DEFINED) and p:
                s = len(p) * top - 0.1 if t == USER_DEFINED else s
                self.id[p] = i
                self.score[i] = int(s * UNIT)
        self.longest = max(map(len, self.id))
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        joined = {c for p in self.id if len(p) > 1 for c in p}
        lonely = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.segment = re.compile((f"[{lonely}]|" if lonely else "") + (
            f"[^{lonely}]+" if crossing and lonely else ".+" if crossing else f"{SPACE}+[^{SPACE}{lonely}]*|[^{SPACE}{lonely}]+"), re.S)
        self._tables()
        size = np.fromiter(map(len, self.out), np.int64, len(self.out))
        self.bytes, self.size, self.at = np.frombuffer(b"".join(self.out), np.uint8), size, np.cumsum(size) - size
        self.memo: dict[str, tuple[int, ...]] = {}

    # -- pieces of many short segments at once

    def _tables(self) -> None:
        """Piece digests in tables without collisions, tried in turn."""
        h = np.zeros(len(self.id), _U)
        ids = np.fromiter(self.id.values(), np.int64, len(self.id))
        for n, p in enumerate(self.id):
            x = 0
            for c in p:
                x = (x * _MUL + ord(c) + 1) % (1 << 64)
            h[n] = x
        # What may be the beginning of a piece; a few others pass as well.
        self.begins = np.zeros(1 << 20, bool)
        for p in self.id:
            x = 0
            for c in p:
                x = (x * _MUL + ord(c) + 1) % (1 << 64)
                self.begins[(x ^ x >> 29) >> 20 & 0xFFFFF] = True
        self.tables, seed = [], 1
        while len(h):
            slot = self._slot(h, seed)
            _, first = np.unique(slot, return_index=True)
            keys, value = np.zeros(1 << 18, _U), np.full(1 << 18, -1, np.int64)
            keys[slot[first]], value[slot[first]] = h[first], ids[first]
            self.tables.append((seed, keys, value))
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, ids, seed = h[rest], ids[rest], seed + 2

    @staticmethod
    def _slot(h: np.ndarray, seed: int) -> np.ndarray:
        return (((h ^ (h >> _U(29))) * _U((_MUL * seed) % (1 << 64) | 1)) >> _U(46)).astype(np.int64)

    def _short(self, words: list[str]) -> list[tuple[int, ...]]:
        text = "".join(words)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(c))  # characters to the segment's end
        rel = np.repeat(size, size) - left
        h = np.zeros(len(c), _U)
        at = np.arange(len(c))
        starts, ids, order = [], [], []
        for n in range(1, min(self.longest, int(size.max())) + 1):
            ok = left[at] >= n
            at, h = at[ok], h[ok]
            h = h * _U(_MUL) + c[at + n - 1]
            if n > 1:
                ok = self.begins[((h ^ (h >> _U(29))) >> _U(20) & _U(0xFFFFF)).astype(np.int64)]
                at, h = at[ok], h[ok]
            found, rest = np.full(len(at), -1, np.int64), np.arange(len(at))
            for seed, keys, value in self.tables:
                slot = self._slot(h[rest], seed)
                hit = keys[slot] == h[rest]
                found[rest[hit]] = value[slot[hit]]
                rest = rest[~hit]
            hit = found >= 0 if n > 1 else np.ones(len(at), bool)
            starts.append(at[hit])
            ids.append(found[hit])
            order.append(np.full(int(hit.sum()), n))
        start, piece, n = np.concatenate(starts), np.concatenate(ids), np.concatenate(order)
        score = np.where(piece >= 0, self.score[piece], self.unk)
        # Best score of every place, by its distance from the segment's begin.
        best = np.full(len(c) + len(words), NEVER, np.int64)  # one more place a segment
        shift = np.repeat(np.arange(len(words)), size)
        s = start + shift[start]
        back = np.zeros(len(best), np.int64)
        how = np.full(len(best), -1, np.int64)
        best[begin + np.arange(len(words))] = 0
        group = ((rel[start] + n) * 64 + n).astype(np.uint16)  # sorted by radix
        by = np.argsort(group, kind="stable")
        s, n, piece, score, group = s[by], n[by], piece[by], score[by], group[by]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = s[a:b] + n[a:b]
            v = best[s[a:b]] + score[a:b]
            up = v > best[e]
            e = e[up]
            best[e], back[e], how[e] = v[up], n[a:b][up], piece[a:b][up]
        # Trace all segments together, from their ends.
        place = begin + size + np.arange(len(words))
        first = begin + np.arange(len(words))
        who, what = [], []
        live = np.arange(len(words))
        while len(live):
            p = place[live]
            who.append(live)
            what.append(np.where(how[p] >= 0, how[p], -1 - (p - back[p] - live)))
            place[live] = p - back[p]
            live = live[place[live] > first[live]]
        who_all, what_all = np.concatenate(who[::-1]), np.concatenate(what[::-1])
        by = np.argsort(who_all, kind="stable")
        flat = what_all[by].tolist()
        counts = np.bincount(who_all, minlength=len(words)).tolist()
        out, at_ = [], 0
        for k in counts:
            ids_ = flat[at_:at_ + k]
            at_ += k
            out.append(tuple(ids_) if min(ids_) >= 0 else tuple(chain.from_iterable(
                (i,) if i >= 0 else self._bytes(text[-1 - i]) for i in ids_)))
        return out

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def _long(self, text: str) -> tuple[int, ...]:
        best, how = [0] + [NEVER] * len(text), [(0, -1)] * (len(text) + 1)
        for i in range(len(text)):
            for n, piece, score in self._from(text, i, len(text)):
                if best[i] + score > best[i + n]:
                    best[i + n], how[i + n] = best[i] + score, (n, piece)
        out, at = [], len(text)
        while at:
            n, piece = how[at]
            out.append((piece,) if piece >= 0 else self._bytes(text[at - 1]))
            at -= n
        return tuple(chain.from_iterable(out[::-1]))

    def _from(self, text: str, i: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(length, piece, score) of the pieces that begin at i."""
        for n in range(1, min(self.longest, end - i) + 1):
            piece = self.id.get(text[i:i + n])
            if piece is not None:
                yield n, piece, int(self.score[piece])
            elif n == 1:
                yield 1, -1, self.unk

    # -- texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts, number of pieces of each); texts are prepared."""
        split = [self.segment.findall(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*split).difference(self.memo))
        short = [s for s in new if len(s) <= LONG]
        for k in range(0, len(short), TOGETHER):
            self.memo.update(zip(short[k:k + TOGETHER], self._short(short[k:k + TOGETHER])))
        for s in new:
            if len(s) > LONG:
                self.memo[s] = self._long(s)
        get = self.memo.__getitem__
        lists = [list(chain.from_iterable(map(get, ws))) for ws in split]
        for s in new:
            if len(s) > LONG:
                del self.memo[s]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size

    def decode(self, pieces: np.ndarray, first: bool) -> str:
        n = self.size[pieces]
        total = np.cumsum(n)
        at = np.repeat(self.at[pieces] - (total - n), n) + np.arange(int(n.sum()))
        out = self.bytes[at].tobytes()
        if first and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "surrogatepass")

    def _states(self, text: str, n: int, start: np.ndarray) -> np.ndarray:
        """Rows of best scores at places n, n + 1, ... of ``text``, less a
        constant; the columns are those of ``start``, whose row i is at place i. Pieces begin before n."""
        lx = self.longest
        d = np.full((len(text) + lx + 1, start.shape[1]), NEVER, np.int64)
        d[:len(start)] = start
        d[len(text) + 1:] = NEVER
        for i in range(n):
            if (d[i] > NEVER).any():
                for k, _, score in self._from(text, i, len(text)):
                    np.maximum(d[i + k], np.where(d[i] > NEVER, d[i] + score, NEVER), out=d[i + k])
            if i % 16 == 15:
                live = d[i + 1:i + 1 + lx]
                live[live > NEVER] -= live.max()
        return d[n:n + lx].copy()

    def transfer(self, text: str, n: int) -> np.ndarray:
        """The transfer matrix of the first n characters of ``text``, the rest
        being what pieces may reach into; its greatest entry is 0."""
        lx = self.longest
        ident = np.where(np.eye(lx, dtype=bool), 0, NEVER).astype(np.int64)
        cuts = [m.start() for m in self.segment.finditer(text) if lx <= m.start() <= n]
        if not cuts:
            out = self._states(text, n, ident).T.copy()
        else:
            head = self._states(text[:cuts[0]], cuts[0], ident)[0]
            tail = self._states(text[cuts[-1]:], n - cuts[-1], np.zeros((1, 1), np.int64))[:, 0]
            known = (head[:, None] > NEVER) & (tail[None, :] > NEVER)
            out = np.where(known, head[:, None] + tail[None, :], NEVER)
        out[out > NEVER] -= out.max()
        return out


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    best = np.full((len(x), y.shape[1]), NEVER, np.int64)
    for k in range(x.shape[1]):
        known = (x[:, k, None] > NEVER) & (y[None, k, :] > NEVER)
        np.maximum(best, np.where(known, x[:, k, None] + y[None, k, :], NEVER), out=best)
    best[best > NEVER] -= best.max()
    return best


def prepared(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _batches(texts: list) -> Iterator[slice]:
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t or "") > BATCH_CHARS:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += len(t or "")
    if begin < len(texts):
        yield slice(begin, len(texts))


_OUT = ["doc_id", "chunk", "n_chunks", "pieces"]


def _rows(ids: pa.Array, chunk: list[int], n_chunks: list[int], pieces: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.array(chunk, pa.int32()), pa.array(n_chunks, pa.int32()),
                                       pa.ListArray.from_arrays(pa.array(at), pa.array(pieces))], _OUT)


def _encode_short(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Model(proto)
            texts = [prepared(t) for t in b.column(1).to_pylist()]
            for s in _batches(texts):
                k = s.stop - s.start
                yield _rows(b.column(0)[s.start:s.stop], [0] * k, [1] * k, *model.encode(texts[s]))

    return run


def _split(size: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = prepared(b.column("text")[i].as_py())
                n = -(-len(text) // size)
                for first in range(0, n, 64):
                    part = range(first, min(n, first + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column("row")[i].as_py()] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([n] * len(part), pa.int32()),
                         pa.array([text[c * size:(c + 1) * size + reach] for c in part], pa.string())], ["row", "chunk", "n_chunks", "text"])

    return run


def _matrices(proto: bytes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Model(proto)
            m = [model.transfer(t, min(size, len(t))).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array(m, pa.binary())], ["row", "at", "m"])

    return run


def _square(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.int64)
    return x.reshape(int(len(x) ** 0.5), -1)


def _combine(key, rows):
    import pandas as pd

    ms = [_square(m) for m in rows.sort_values("at")["m"]]
    out = ms[0]
    for m in ms[1:]:
        out = product(out, m)
    return pd.DataFrame({"row": [key[0]], "at": [key[1]], "m": [out.tobytes()]})


def _descend(key, rows):
    """States at the boundaries of a group, from those at its two ends."""
    import pandas as pd

    rows = rows.sort_values("at")
    ms = [_square(m) for m in rows["m"]]
    enter, leave = int(rows["enter"].iloc[0]), int(rows["leave"].iloc[0])
    v = [ms[0][enter]]
    for m in ms[1:-1]:
        v.append(product(v[-1][None, :], m)[0])
    states = [leave]
    for n in range(len(ms) - 1, 0, -1):
        to = ms[n][:, states[-1]]
        states.append(int(np.where((v[n - 1] > NEVER) & (to > NEVER), v[n - 1] + to, NEVER).argmax()))
    states = [enter, *states[::-1]]
    return pd.DataFrame({"row": rows["row"], "at": rows["at"], "enter": states[:-1], "leave": states[1:]})


def boundary_states(matrices: DataFrame, group: int = GROUP) -> DataFrame:
    """(row, at, enter, leave) of (row, at, m): the states of every chunk."""
    levels = [matrices]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("row", F.expr(f"cast(at div {group} as int)").alias("to")).applyInPandas(
            _combine, "row long, at int, m binary")
        levels.append(saved(up, "scan-up"))
    states = levels[-1].select("row", "at", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for level in levels[-2::-1]:
        down = level.withColumn("up", F.expr(f"cast(at div {group} as int)")).join(
            states.withColumnRenamed("at", "up"), ["row", "up"])
        states = saved(down.groupBy("row", "up").applyInPandas(_descend, "row long, at int, enter int, leave int"), "scan-down")
    return states


def _trace(proto: bytes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Model(proto)
            texts = [t[a:min(size, len(t)) + z] for t, a, z in zip(*(b.column(c).to_pylist() for c in ("text", "enter", "leave")))]
            for s in _batches(texts):
                yield _rows(b.column(0)[s.start:s.stop], b.column("chunk")[s.start:s.stop].to_pylist(),
                            b.column("n_chunks")[s.start:s.stop].to_pylist(), *model.encode(texts[s]))

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, chunk, n_chunks, pieces): a row for each chunk of each text."""
    with open(model_path, "rb") as f:
        proto = f.read()
    reach = Model(proto).longest - 1
    d = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, chunk int, n_chunks int, pieces array<int>"
    # A text and its prefix fit one chunk, or the text is split.
    short = d.where(F.length("text") < chunk).mapInArrow(_encode_short(proto), schema)
    giant = saved(d.where(F.length("text") >= chunk).withColumn("row", F.monotonically_increasing_id()), "scan-giant")
    parts = saved(giant.select("row", "text").mapInArrow(_split(chunk, reach), "row long, chunk int, n_chunks int, text string"), "scan-chunks")
    matrices = saved(parts.repartition("row", "chunk").mapInArrow(_matrices(proto, chunk), "row long, at int, m binary"), "scan-matrices")
    states = boundary_states(matrices).withColumnRenamed("at", "chunk")
    traced = parts.join(states, ["row", "chunk"]).join(giant.select("row", "doc_id"), "row").select(
        "doc_id", "chunk", "n_chunks", "text", "enter", "leave").mapInArrow(_trace(proto, chunk), schema)
    return short.unionByName(traced)


def _decode(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Model(proto)
            text = [model.decode(p.values.to_numpy(zero_copy_only=False), c == 0) for p, c in zip(b.column("pieces"), b.column("chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "text"])

    return run


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """The rows of encode() with their text; a text is its chunks in order."""
    with open(model_path, "rb") as f:
        proto = f.read()
    r = rows.select(*_OUT)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema)
    return r.mapInArrow(_decode(proto), f"{types}, text string")
