"""Class-based bigram scores from exchange clustering (Brown et al.).

A text's tokens are its words, A-Z lowered, and one end. P(w | v) is
P(class of w | class of v) * P(w | class of w).

Classes. A word that makes up at least 1 / HEAD of the training tokens and occurs
LEAST times is a head word (so there are at most HEAD) and is put into one of CLASSES classes by exchange:
in each round every head word's best class is found from its neighbours' classes, by the
change of the log-likelihood, and the moves that gain are made for half of the
words at a time, so that words do not change places for ever. Every other word that occurs
LEAST times then gets its best class in the same way, from its neighbours' classes, in one pass over
words' bins; these classes are data of Spark's and stay out of the driver. Words
seen less, and those that gain nowhere, are classed by the order of magnitude of their count; the class of words
seen once also holds the unseen, as one more type, with half of its emissions.
The end is a class of its own, and stands before the first word as well.

Smoothing. Transitions are interpolated with the classes' own probabilities by
ALPHA pseudo-counts; every distribution sums to one over the words and the unseen.

Spark jobs. Each task turns batches of texts into numbers of a batch's own words
and sends each batch's distinct words, with their counts, to reducers by
digest; these send the total counts back to the batches. Counts, bigrams and
contexts so cover every training text, the classes of words beyond the head go back the same way, and nothing whole passes one task or
the driver, which holds the head (at most HEAD words) and the class matrix.

Words are told apart by 64-bit digests.

Defined results: null and empty texts are one end; a null id counts as held out (the CRC of the
empty text is 0); without training texts the base score takes all counts as 0
and the classes have only their prior; repeated rows count as texts; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import dropped, saved, whole_text
from .shingles import WordDigests, text_words

HEAD, LEAST, CLASSES, ROUNDS, ALPHA = 1 << 17, 8, 48, 8, 20.0
#: Every FOLDS-th text by the CRC of its id is held out.
FOLDS = 10
#: Words to a batch, and reducers' blocks for each shuffle partition.
BATCH_WORDS, BINS_PER_PARTITION = 2_000_000, 4
#: Blocks the head words' contexts are kept in; the head is bounded, so their number is.
CONTEXT_BINS = 64

_U = np.uint64
END = int.from_bytes(hashlib.blake2b(b"\n", digest_size=8).digest(), "little")


def _pack(x: np.ndarray) -> bytes:
    """Small numbers, byte plane by byte plane."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _bin(h: np.ndarray, bins: int) -> np.ndarray:
    return (h % _U(bins)).astype(np.int64)


# -- 1. batches of texts, and their words

_READ = "batch long, bin int, words binary, counts binary, held_out boolean, tokens binary"


def _read(bins: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        schema = pa.schema([("doc_id", id_type), ("batch", pa.int64()), ("bin", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()),
                            ("held_out", pa.bool_()), ("tokens", pa.binary())])

        def flush(ids, held, lists):
            size = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
            flat = np.fromiter((d for ws in lists for d in (*(digests[w] for w in ws), END)), _U, int(size.sum()))
            held = np.array(held, bool)
            words, inverse = np.unique(flat, return_inverse=True)
            train = np.repeat(~held, size)
            count = np.bincount(inverse[train], minlength=len(words))
            # Numbers in the order (bin, digest), which the reducers keep.
            by = np.lexsort((words, _bin(words, bins)))
            number = np.empty(len(words), np.int64)
            number[by] = np.arange(len(words))
            tokens = number[inverse]
            words, count = words[by], count[by]
            batch = uuid.uuid4().int >> 65
            which, first = np.unique(_bin(words, bins), return_index=True)
            edges = np.append(first, len(words))
            n = len(which)
            yield _rows(schema, [None] * n, [batch] * n, which, [words[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])],
                        [_pack(count[a:z]) for a, z in zip(edges[:-1], edges[1:])], [None] * n, [None] * n)
            at = np.concatenate([[0], np.cumsum(size)])
            n = len(lists)
            yield _rows(schema, ids, [batch] * n, [None] * n, [None] * n, [None] * n, held,
                        [_pack(tokens[a:z]) for a, z in zip(at[:-1], at[1:])])

        ids, held, lists, n = [], [], [], 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids.append(i)
                held.append(h)
                lists.append(text_words(t))
                n += len(lists[-1])
                if n >= BATCH_WORDS:
                    yield from flush(ids, held, lists)
                    ids, held, lists, n = [], [], [], 0
        if lists:
            yield from flush(ids, held, lists)

    return run


def _rows(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# -- 2. total counts, sent back to the batches

_TOTAL = "batch long, bin int, counts binary, head binary, n_tokens long, n_types long, n_frequent long"


def _total(table: pa.Table) -> pa.Table:
    """Totals of one bin: counts for every batch that asked, and one row with
    the bin's sums and its words that may be head words."""
    batch, bin_ = table.column("batch").to_pylist(), table.column("bin")[0].as_py()
    words = [np.frombuffer(x.as_buffer(), _U) for x in table.column("words")]
    counts = [_unpack(x) for x in table.column("counts").to_pylist()]
    all_, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts).astype(np.float64), len(all_)).astype(np.int64)
    replies = np.split(total[inverse], np.cumsum([len(w) for w in words])[:-1])
    n = int(total.sum())
    # No fewer than the head needs: its words have 1 / HEAD of more tokens.
    head = (total * HEAD >= n) & (total >= LEAST) | (all_ == _U(END))
    pairs = np.stack([all_[head].view(np.int64), total[head]], 1).tobytes()
    k = len(batch)
    return pa.table({"batch": pa.array([*batch, None], pa.int64()), "bin": pa.array([bin_] * (k + 1), pa.int32()),
                     "counts": pa.array([*map(_pack, replies), None], pa.binary()), "head": pa.array([None] * k + [pairs], pa.binary()),
                     "n_tokens": pa.array([None] * k + [n], pa.int64()), "n_types": pa.array([None] * k + [int((total > 0).sum())], pa.int64()),
                     "n_frequent": pa.array([None] * k + [int(((total >= LEAST) & (all_ != _U(END))).sum())], pa.int64())})


def _head_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("head").to_pylist():
            p = np.frombuffer(x, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["word", "n"])


# -- 3. texts as symbols: head words by number, other words by their count


def _by_bin(rows: pa.Table, name: str) -> list[bytes]:
    return [x for _, x in sorted((b, x) for b, x in zip(rows.column("bin").to_pylist(), rows.column(name).to_pylist()) if x is not None)]


def _batch_words(head: np.ndarray, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's words in their order, their symbols and their counts; words and counts come in rows of their own."""
    words = np.concatenate([np.frombuffer(w, _U) for w in _by_bin(replies, "words")])
    count = np.concatenate([_unpack(c) for c in _by_bin(replies, "counts")]).astype(np.int64)
    order = np.argsort(head)
    known = head[order]
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    is_head = known[at] == words if len(known) else np.zeros(len(words), bool)
    return words, np.where(is_head, order[at] if len(known) else 0, len(head) + count), count


def _symbols(head: np.ndarray, classed: bool = False):
    """Texts and counts of a batch together: symbols of each text; ``classed``: every word by its count, and its class."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if classed:
            count = np.concatenate([_unpack(c) for c in _by_bin(replies, "counts")]).astype(np.int64)
            symbol = len(head) + count
            of_word = np.concatenate([np.frombuffer(x, "<u2") for x in _by_bin(replies, "classes")])
        else:
            _, symbol, count = _batch_words(head, replies)
        log = np.log10(count + 0.1)
        out, known_n, log_n, size, kinds = [], [], [], [], []
        for x in texts.column("tokens").to_pylist():
            t = _unpack(x)
            out.append(_pack(symbol[t]))
            known_n.append(int((count[t] > 0).sum()))
            log_n.append(float(log[t].sum()))
            size.append(len(t))
            if classed:
                kinds.append(zlib.compress(of_word[t].tobytes(), 1))
        got = {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "symbols": pa.array(out, pa.binary()),
               "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(known_n, pa.int64()), "log_counts": pa.array(log_n, pa.float64())}
        return pa.table(got | ({"classes": pa.array(kinds, pa.binary())} if classed else {}))

    return run


# -- 4. contexts of the head words


def _unit(symbols: np.ndarray, n_head: int) -> np.ndarray:
    """Head words as they are, other words by the magnitude of their count; the unseen as seen once."""
    c = np.maximum(symbols.astype(np.int64) - n_head, 1)
    return np.where(symbols < n_head, symbols, n_head + np.frexp(c.astype(np.float64))[1] - 1).astype(np.int64)


_PAIRS = "bin int, data binary"


def _bigrams(n_head: int, end: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            order = np.argsort(key % bins, kind="stable")
            which, first = np.unique((key % bins)[order], return_index=True)
            data = np.stack([key, n], 1)[order]
            edges = np.append(first, len(data))
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(
                [data[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])], pa.binary())], ["bin", "data"])

        parts, n = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                u = _unit(_unpack(x), n_head)
                before = np.concatenate([[end], u[:-1]])
                parts.append(before << 20 | u)
                n += len(u)
                if n >= BATCH_WORDS:
                    yield flush(parts)
                    parts, n = [], 0
        if parts:
            yield flush(parts)

    return run


def _contexts(n_head: int, bins: int):
    """Summed bigrams of a bin, as contexts of both words, by head word; side 2
    has those without a head word."""

    def run(table: pa.Table) -> pa.Table:
        data = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in table.column("data")])
        key, inverse = np.unique(data[:, 0], return_inverse=True)
        n = np.bincount(inverse, data[:, 1].astype(np.float64), len(key)).astype(np.int64)
        a, b = key >> 20, key & 0xFFFFF
        rows = [np.stack([np.full(k.sum(), side), w[k], o[k], n[k]], 1) for side, w, o, k in (
            (0, a, b, a < n_head), (1, b, a, b < n_head), (2, a, b, (a >= n_head) & (b >= n_head)))]
        rows = np.concatenate(rows)
        to = np.where(rows[:, 0] == 2, 0, rows[:, 1] % bins)
        order = np.argsort(to, kind="stable")
        which, first = np.unique(to[order], return_index=True)
        rows, edges = rows[order].astype("<u4"), np.append(first, len(to))
        return pa.table({"bin": pa.array(which, pa.int32()), "data": pa.array(
            [zlib.compress(rows[p:q].T.tobytes(), 1) for p, q in zip(edges[:-1], edges[1:])], pa.binary())})

    return run


def _open_contexts(blobs: list[bytes]) -> np.ndarray:
    """(side, word, other, n) rows."""
    return np.concatenate([np.frombuffer(zlib.decompress(x), "<u4").reshape(4, -1).T for x in blobs]).astype(np.int64)


def _class_counts(classes: np.ndarray, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes)
        for b in batches:
            for x in b.column("data").to_pylist():
                side, w, o, n = _open_contexts([x]).T
                # A bigram of two head words stands on both sides; side 0 counts it.
                k = (side != 1) | (o >= len(classes) - 32)
                a, z = np.where(side == 1, o, w)[k], np.where(side == 1, w, o)[k]
                total += np.bincount(classes[a] * n_classes + classes[z], n[k].astype(np.float64), n_classes * n_classes)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1.0)), 0.0)


def best_class(m: np.ndarray, own: int, out: np.ndarray, into: np.ndarray, loop: float, n_free: int) -> tuple[int, float]:
    """The class a word gains most in, and the gain in log-likelihood over its own.

    ``m``: class bigrams; ``out``, ``into``: the word's neighbours by class, without
    itself; ``loop``: how often it follows itself; classes from n_free on are closed.
    """
    m = m.copy()
    m[own] -= out
    m[:, own] -= into
    m[own, own] -= loop
    left, right = m.sum(1), m.sum(0)
    o, i = np.flatnonzero(out), np.flatnonzero(into)
    free = m[:n_free]
    gain = (_f(free[:, o] + out[o]) - _f(free[:, o])).sum(1) + (_f(m[i, :n_free].T + into[i]) - _f(m[i, :n_free].T)).sum(1)
    d = np.diag(m)[:n_free]
    od, id_ = out[:n_free], into[:n_free]
    gain += _f(d + od + id_ + loop) - _f(d + od) - _f(d + id_) + _f(d)
    n_out, n_in = out.sum() + loop, into.sum() + loop
    gain -= _f(left[:n_free] + n_out) - _f(left[:n_free]) + _f(right[:n_free] + n_in) - _f(right[:n_free])
    to = int(gain.argmax())
    return to, float(gain[to] - gain[own])


def _moves(classes: np.ndarray, m: np.ndarray, n_free: int, part: int):
    n_classes = len(m)

    def run(table: pa.Table) -> pa.Table:
        side, w, o, n = _open_contexts(table.column("data").to_pylist()).T
        k = (side < 2) & (classes[w] < n_free) & ((w * 2654435761 >> 8) % 2 == part)
        side, w, o, n = side[k], w[k], o[k], n[k]
        words, at = np.unique(w, return_inverse=True)
        loops = np.bincount(at[(side == 0) & (o == w)], n[(side == 0) & (o == w)].astype(np.float64), len(words))
        tables = []
        for s in (0, 1):
            j = (side == s) & (o != w)
            tables.append(np.bincount(at[j] * n_classes + classes[o[j]], n[j].astype(np.float64), len(words) * n_classes).reshape(-1, n_classes))
        best = [best_class(m, classes[x], tables[0][r], tables[1][r], loops[r], n_free) for r, x in enumerate(words.tolist())]
        return pa.table({"word": pa.array(words, pa.int64()), "to": pa.array([b[0] for b in best], pa.int64()),
                         "gain": pa.array([b[1] for b in best], pa.float64())})

    return run


# -- 5. classes of the words beyond the head

_REST = "bin int, words binary, sizes binary, codes binary, n binary"


def _rest_contexts(head: np.ndarray, classes: np.ndarray, kinds: int, bins: int):
    """Texts and counts of a batch together: for each word beyond the head that occurs LEAST times, how often each class
    follows it (codes from 0), goes before it (from ``kinds``), and the word itself follows (the last code)."""
    codes = 2 * kinds + 1

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        words, symbol, count = _batch_words(head, replies)
        of_word = classes[_unit(symbol, len(head))]
        rest = (symbol >= len(head)) & (count >= LEAST)
        end = np.flatnonzero(words == _U(END))[0]
        lists = [_unpack(x).astype(np.int64) for x, h in zip(texts.column("tokens").to_pylist(), texts.column("held_out").to_pylist()) if not h]
        z = np.concatenate([*lists, np.empty(0, np.int64)])
        a = np.concatenate([*(np.append(end, t[:-1]) for t in lists), np.empty(0, np.int64)])
        loop = a == z
        left, right = rest[a] & ~loop, rest[z] & ~loop
        key, n = np.unique(np.concatenate([a[left] * codes + of_word[z[left]], z[right] * codes + kinds + of_word[a[right]],
                                           z[rest[z] & loop] * codes + codes - 1]), return_counts=True)
        word, size = np.unique(key // codes, return_counts=True)
        bin_ = _bin(words[word], bins)
        which, first = np.unique(bin_, return_index=True)
        edges = np.append(first, len(word))
        at = np.concatenate([[0], np.cumsum(size)])
        spans = list(zip(edges[:-1], edges[1:]))
        return pa.table({"bin": pa.array(which, pa.int32()), "words": pa.array([words[word[p:q]].tobytes() for p, q in spans], pa.binary()),
                         "sizes": pa.array([_pack(size[p:q]) for p, q in spans], pa.binary()),
                         "codes": pa.array([_pack(key[at[p]:at[q]] % codes) for p, q in spans], pa.binary()),
                         "n": pa.array([_pack(n[at[p]:at[q]]) for p, q in spans], pa.binary())})

    return run


def best_classes(m: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, loop: np.ndarray, n_free: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word (row) the best of the first ``n_free`` classes that are not empty and the gain in log-likelihood over its own, which is none of
    them. ``m``: class bigrams, with the word in its own; ``out``, ``into``: its neighbours by class, without itself; ``loop``: how often it follows itself."""
    r = np.arange(len(own))
    fm, n = _f(m), out.sum(1) + loop
    gain = np.zeros((len(own), n_free))
    for side, back, big in ((out, into, m), (into, out, m.T)):
        for a in range(0, len(own), 4096):
            w, o = np.nonzero(side[a:a + 4096])
            w += a
            was = big[:n_free, o].T
            # A class's bigrams with the word's own class lose those with the word.
            was = np.maximum(was - np.where((o == own[w])[:, None], back[w, :n_free], 0.0), 0.0)
            # The corner is added below, for both sides and loops at once.
            plus = _f(was + side[w, o][:, None]) - _f(was)
            plus[np.flatnonzero(o < n_free), o[o < n_free]] = 0.0
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(plus, first) if len(w) else 0.0
    d = np.diag(m)[:n_free]
    gain += _f(d + out[:, :n_free] + into[:, :n_free] + loop[:, None]) - _f(d)
    stay = np.zeros(len(own))
    for side, big in ((out, m[own]), (into, m.T[own])):
        rest = big - side
        rest[r, own] = big[r, own]
        stay += (_f(big) - _f(np.maximum(rest, 0.0))).sum(1)
        total = big.sum(1)
        stay -= _f(total) - _f(np.maximum(total - n, 0.0))
    corner = np.diag(m)[own]
    stay += np.diag(fm)[own] - _f(np.maximum(corner - out[r, own] - into[r, own] - loop, 0.0))
    for total in (m.sum(1)[:n_free], m.sum(0)[:n_free]):
        gain -= _f(total + n[:, None]) - _f(total)
    # An empty class would take all words that move at once.
    gain[:, m.sum(0)[:n_free] == 0] = -np.inf
    to = gain.argmax(1)
    return to, gain[r, to] - stay


def _rest_classes(m: np.ndarray, head: np.ndarray, classes: np.ndarray, n_classes: int, part: int):
    """Words that batches asked for and the contexts of a bin together: the words' classes, for every batch that asked.
    One of ``part`` words may move."""
    kinds, codes = len(m), 2 * len(m) + 1
    order = np.argsort(head)
    known = head[order]

    def run(asked: pa.Table, contexts: pa.Table) -> pa.Table:
        names, to = np.empty(0, _U), np.empty(0, np.int64)
        if contexts.num_rows:
            size = np.concatenate([_unpack(x) for x in contexts.column("sizes").to_pylist()])
            names, at = np.unique(np.concatenate([np.frombuffer(x, _U) for x in contexts.column("words").to_pylist()]), return_inverse=True)
            code = np.concatenate([_unpack(x) for x in contexts.column("codes").to_pylist()]).astype(np.int64)
            n = np.concatenate([_unpack(x) for x in contexts.column("n").to_pylist()]).astype(np.float64)
            t = np.bincount(np.repeat(at, size) * codes + code, n, len(names) * codes).reshape(-1, codes)
            out, into, loop = t[:, :kinds], t[:, kinds:-1], t[:, -1]
            own = n_classes + np.frexp(out.sum(1) + loop)[1]
            best, gain = best_classes(m, own, out, into, loop, n_classes)
            to = np.where((gain > 1e-6) & ((names >> _U(8)) % _U(part) == 0), best, own)
        replies = []
        rows = list(zip(*(asked.column(k).to_pylist() for k in ("batch", "words", "counts"))))
        words = {b: w for b, w, _ in rows if w is not None}
        counts = {b: c for b, _, c in rows if c is not None}
        for b, c in counts.items():
            w = np.frombuffer(words[b], _U)
            at = np.minimum(np.searchsorted(known, w), len(known) - 1)
            kind = classes[np.where(known[at] == w, order[at], _unit(len(head) + _unpack(c).astype(np.int64), len(head)))]
            if len(names):
                at = np.minimum(np.searchsorted(names, w), len(names) - 1)
                kind = np.where(names[at] == w, to[at], kind)
            replies.append(kind.astype("<u2").tobytes())
        return pa.table({"batch": pa.array(list(counts), pa.int64()), "bin": pa.array([asked.column("bin")[0].as_py()] * len(counts), pa.int32()),
                         "counts": pa.array(list(counts.values()), pa.binary()), "classes": pa.array(replies, pa.binary())})

    return run


def _text_matrix(kinds: int, closed: int):
    """Class bigrams of texts whose words' classes are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * kinds)
        for b in batches:
            for x in b.column("classes").to_pylist():
                c = np.frombuffer(zlib.decompress(x), "<u2").astype(np.int64)
                total += np.bincount(np.append(closed, c[:-1]) * kinds + c, minlength=kinds * kinds)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


# -- 6. scores


def _score(n_head: int, closed: int, classes: np.ndarray, head_n: np.ndarray, log_size: np.ndarray, once: float, step: np.ndarray):
    """A word's emission is its count's share of its class; of the class of words seen once half is for the unseen."""
    log_head = np.log10(np.maximum(head_n, 1e-9))
    low = np.log10([0.5, 0.5 / once] if once else [1.0, 1.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            kinds = b.column("classes").to_pylist() if "classes" in b.schema.names else [None] * b.num_rows
            for x, kind in zip(b.column("symbols").to_pylist(), kinds):
                s = _unpack(x).astype(np.int64)
                c = classes[_unit(s, n_head)] if kind is None else np.frombuffer(zlib.decompress(kind), "<u2").astype(np.int64)
                before = np.append(closed, c[:-1])
                n = s - n_head
                e = np.where(n < 0, log_head[np.minimum(s, n_head - 1)], np.log10(np.maximum(n, 1))) - log_size[c]
                e = np.where(c == closed + 1, low[np.clip(n, 0, 1)], e)
                out.append(float((step[before, c] + e).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known", "log_counts")), pa.array(out, pa.float64())],
                                             ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"])

    return run


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_classes: int = CLASSES, rounds: int = ROUNDS,
                 alpha: float = ALPHA) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row."""
    spark = docs.sparkSession
    bins = BINS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fold = F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(FOLDS))
    d = docs.select(F.col(id_col).alias("doc_id"), (fold == 0).alias("held_out"), whole_text(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType
    id_sql = kind.simpleString()
    read = saved(d.mapInArrow(_read(bins, to_arrow_type(kind)), f"doc_id {id_sql}, {_READ}"), "brown-read")
    asked = read.where("bin is not null").select("batch", "bin", "words", "counts")
    totals = saved(asked.groupBy("bin").applyInArrow(_total, _TOTAL), "brown-totals")
    sums = totals.where("head is not null").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_frequent"), F.lit(0))).first()
    n_tokens, n_types, n_frequent = map(int, sums)
    # At most HEAD words and the end.
    rows = totals.where("head is not null").select("head").mapInArrow(_head_words, "word long, n long").where(
        (F.col("n") * HEAD >= n_tokens) & (F.col("n") >= LEAST) | (F.col("word") == int(np.int64(np.uint64(END).view(np.int64))))).collect()
    rows = sorted(((r["n"], r["word"]) for r in rows), reverse=True)
    head = np.array([w for _, w in rows], np.int64).view(_U)
    head_n = np.array([n for n, _ in rows], np.float64)
    n_head = len(head)
    if not n_head:
        schema = f"doc_id {id_sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
        return spark.createDataFrame([], schema)
    end = int(np.flatnonzero(head == _U(END))[0])

    texts = read.where("bin is null").select("batch", "doc_id", "held_out", "tokens")
    # Words and counts of a batch meet in its task, without a join before.
    replies = totals.where("head is null").select("batch", "bin", "counts").unionByName(asked.select("batch", "bin", "words"), allowMissingColumns=True)
    scored = f"doc_id {id_sql}, held_out boolean, symbols binary, n_tokens long, n_known long, log_counts double"
    symbols = saved(texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_symbols(head), scored), "brown-symbols")

    pairs = symbols.where("not held_out").select("symbols").mapInArrow(_bigrams(n_head, end, bins), _PAIRS)
    contexts = pairs.groupBy("bin").applyInArrow(_contexts(n_head, CONTEXT_BINS), _PAIRS)
    contexts = saved(contexts.repartition("bin"), "brown-contexts")

    # Classes of units: head words, then 32 magnitudes; the end is closed.
    count = n_classes + 1 + 32
    classes = np.concatenate([np.arange(n_head) % n_classes, n_classes + 1 + np.arange(32)])
    classes[end] = n_classes

    def matrix() -> np.ndarray:
        got = contexts.mapInArrow(_class_counts(classes, count), "m binary").collect()
        return sum((np.frombuffer(r["m"]).reshape(count, count) for r in got), np.zeros((count, count)))

    m = matrix()
    for k in range(rounds):
        moved = contexts.groupBy("bin").applyInArrow(_moves(classes, m, n_classes, k % 2), "word long, to long, gain double").where(
            "gain > 1e-6").collect()
        old, before = classes.copy(), m
        for r in moved:
            classes[r["word"]] = r["to"]
        m = matrix()
        if _likelihood(m) < _likelihood(before):
            # Moves made at once can lose where each alone gains.
            classes, m = old, before

    if n_frequent > n_head - 1:
        # Made anew below, with the words' classes.
        dropped(symbols, contexts)
        rest = saved(texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_rest_contexts(head, classes, count, bins), _REST), "brown-rest")
        for part in (1, 2, 4):
            found = saved(replies.groupBy("bin").cogroup(rest.groupBy("bin")).applyInArrow(
                _rest_classes(m, head, classes, n_classes, part), "batch long, bin int, counts binary, classes binary"), "brown-found")
            classed = saved(texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_symbols(head, True), scored + ", classes binary"), "brown-classed")
            dropped(found)
            got = classed.where("not held_out").select("classes").mapInArrow(_text_matrix(count, n_classes), "m binary").collect()
            after = sum((np.frombuffer(r["m"]).reshape(count, count) for r in got), np.zeros((count, count)))
            # As above, moves made at once can lose; fewer then.
            if _likelihood(after) >= _likelihood(m):
                symbols, m = classed, after
                break
            if part < 4:
                dropped(classed)
            else:
                # Nothing gains: the words stay as they were.
                found = saved(replies.groupBy("bin").cogroup(rest.where("false").groupBy("bin")).applyInArrow(
                    _rest_classes(m, head, classes, n_classes, part), "batch long, bin int, counts binary, classes binary"), "brown-found")
                symbols = saved(texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_symbols(head, True), scored + ", classes binary"), "brown-classed")
                dropped(found, classed)
        dropped(rest)

    # Emissions: words by their share of the class.
    rare = m.sum(0)
    once = max(rare[n_classes + 1], 0.0)
    log_size = np.log10(np.maximum(rare, 1e-9))
    prior = (rare + 0.1) / (rare.sum() + 0.1 * count)
    step = np.log10((m + alpha * prior) / (m.sum(1, keepdims=True) + alpha))
    base = float(np.log10(n_tokens + 0.1 * (n_types + 1)))
    out = symbols.mapInArrow(_score(n_head, n_classes, classes, head_n, log_size, once, step),
                             f"doc_id {id_sql}, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
                      (F.col("log_counts") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _likelihood(m: np.ndarray) -> float:
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())
