"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits keeps at
least T = m - q + 1 - k * q of its q-grams, all on k + 1 neighbouring
diagonals (place in the text less place in the item). So per item: hits of its
q-grams are counted in overlapping bands of 2 * (k + 1) diagonals, each place
of the item once; bands with T or more are kept; and in the region of the text
that a kept band covers, a banded alignment says whether, where and with how many
edits the item occurs. The filter loses no occurrence.

Both sides are compared in lower case with every run of other characters than
letters and digits as one space; spans are given in the original text.

The benchmark is the stated query set. It goes to the tasks in blocks of at most
BLOCK_CHARS characters, each block one pass over the documents, whatever their
number. Texts are handled in windows that overlap by more than the longest
occurrence, so memory does not grow with a text's length.

Defined results: null and empty texts contain nothing; an item with fewer than
q characters after normalisation (also null) is not searched for; equal items
each give their rows; repeated document rows give their rows once each; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import saved, union
from .shingles import mix

Q, ERROR_RATE = 8, 0.10
#: Characters of benchmark text a task holds at once, and of documents.
BLOCK_CHARS, WINDOW_CHARS = 4_000_000, 1_000_000
#: Bits of the table that says which q-grams may occur in the block.
TABLE_BITS = 22

_U = np.uint64


#: Characters beyond the basic plane count as letters without case.
_PLANE = 0x10000


#: Tables made once in a worker (a plain dict: cached functions can't be sent by value).
_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case, and whether it is a letter or digit, of every character of the basic plane."""
    if "chars" in _TABLES:
        return _TABLES["chars"]
    low, word = np.arange(_PLANE, dtype=np.uint32), np.zeros(_PLANE, bool)
    for i in range(_PLANE):
        c = chr(i)
        if len(l := c.lower()) == 1:
            low[i] = ord(l)
        word[i] = c.isalnum()
    _TABLES["chars"] = low, word
    return low, word


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the normalised text, and each one's place in the text."""
    low, word = _tables()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(c, _PLANE - 1)
    high = c >= _PLANE
    c, w = np.where(high, c, low[at]), high | word[at]
    before = np.concatenate([[False], w[:-1]])
    keep = np.flatnonzero(w | before)
    return np.where(w[keep], c[keep], np.uint32(32)), keep


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, _U)
    h = np.zeros(n, _U)
    for k in range(q):
        h = h * _U(0x9E3779B97F4A7C15) + codes[k:k + n]
    return mix(h)


class Block:
    """Some items, and the index of their q-grams."""

    def __init__(self, items: list[tuple[object, str | None]], q: int, rate: float):
        self.q, self.ids, self.codes, self.k, self.least = q, [], [], [], []
        grams, item, place = [], [], []
        for i, text in items:
            codes, _ = normalised(text or "")
            m = len(codes)
            while m and codes[m - 1] == 32:
                m -= 1
            codes = codes[:m]
            if m < q:
                continue
            k = min(int(rate * m), (m - q) // q)
            grams.append(_grams(codes, q))
            item.append(np.full(m - q + 1, len(self.ids), np.int64))
            place.append(np.arange(m - q + 1))
            self.ids.append(i)
            self.codes.append(codes)
            self.k.append(k)
            self.least.append(m - q + 1 - k * q)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        g = cat(grams, _U)
        order = np.argsort(g, kind="stable")
        self.item, self.place = cat(item, np.int64)[order], cat(place, np.int64)[order]
        self.grams, self.at = np.unique(g[order], return_index=True)
        self.at = np.append(self.at, len(g))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> _U(64 - TABLE_BITS)).astype(np.int64)] = True
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.width = np.array(self.k, np.int64) + 1
        self.least = np.array(self.least, np.int64)
        self.reach = int((self.size + 4 * self.width).max()) + q if self.ids else 0

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, begin, end) of the regions whose band has enough q-grams."""
        h = _grams(codes, self.q)
        j = np.flatnonzero(self.table[(h >> _U(64 - TABLE_BITS)).astype(np.int64)])
        g = np.searchsorted(self.grams, h[j])
        g[g == len(self.grams)] = 0
        real = self.grams[g] == h[j] if len(self.grams) else np.zeros(len(j), bool)
        j, g = j[real], g[real]
        n = self.at[g + 1] - self.at[g]
        e = np.repeat(self.at[g], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        item, place, j = self.item[e], self.place[e], np.repeat(j, n)
        if not len(j):
            return []
        # Bands start every `width` diagonals and are two widths wide; a cell
        # is one width, its number shifted to be positive.
        cell = (j - place) // self.width[item] + int(self.size.max())
        cells = int(cell.max()) + 3
        key = item * cells + cell
        # Cheap upper bound first: hits of a cell and its neighbours, mod a table.
        slots = 1 << max(10, int(4 * len(key)).bit_length())
        c = np.bincount(key & (slots - 1), minlength=slots)
        near = np.maximum(c[(key - 1) & (slots - 1)], c[(key + 1) & (slots - 1)])
        may = c[key & (slots - 1)] + near >= self.least[item]
        key, item, place = key[may], item[may], place[may]
        # Each place of the item once in a band: cell b counts for bands b and b - 1.
        top = int(self.size.max())
        seen = np.unique(np.concatenate([key, key - 1]) * top + np.concatenate([place, place]))
        band, count = np.unique(seen // top, return_counts=True)
        it = band // cells
        ok = count >= self.least[np.clip(it, 0, len(self.ids) - 1)]
        out = []
        for b in band[ok]:
            i, first = int(b // cells), (int(b % cells) - int(self.size.max())) * int(self.width[b // cells])
            out.append((i, max(0, first - int(self.width[i])), min(len(codes), first + int(self.size[i]) + 3 * int(self.width[i]))))
        return out

    def align(self, i: int, region: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, begin, end) of the best occurrence of item i, if within its budget."""
        item, k = self.codes[i], self.k[i]
        if (at := region.tobytes().find(item.tobytes())) >= 0 and at % 4 == 0:
            return 0, at // 4, at // 4 + len(item)
        edits, end = _ends(item, region, free=True)
        if edits > k:
            return None
        back, begin = _ends(item[::-1], region[:end][::-1], free=False)
        return edits, end - begin, end


def _ends(item: np.ndarray, text: np.ndarray, free: bool) -> tuple[int, int]:
    """Least edits of the item against a stretch of the text, and the stretch's
    end; it begins anywhere if ``free``, else at 0."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64) if free else steps.copy()
    for n, c in enumerate(item, 1):
        t = row + 1
        np.minimum(t[1:], row[:-1] + (text != c), out=t[1:])
        row = np.minimum.accumulate(t - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _windows(n: int, reach: int) -> Iterator[tuple[int, int]]:
    step = max(WINDOW_CHARS, 4 * reach)
    at = 0
    while True:
        yield at, min(n, at + step + reach)
        at += step
        if at + reach >= n:
            return


def _occurrences(block: Block, codes: np.ndarray) -> set[tuple[int, int, int, int]]:
    """(item, edits, begin, end) in one text, overlapping ones of an item reduced to the best."""
    found = set()
    for a, b in _windows(len(codes), block.reach):
        for i, lo, hi in set(block.regions(codes[a:b])):
            if got := block.align(i, codes[a + lo:a + hi]):
                found.add((i, got[0], a + lo + got[1], a + lo + got[2]))
    kept: list[tuple[int, int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for x in sorted(found):
        # Kept spans of an item don't overlap: only the neighbours can meet this one.
        spans = taken.setdefault(x[0], [])
        at = bisect.bisect(spans, (x[2], x[3]))
        if not any(y[0] < x[3] and x[2] < y[1] for y in spans[max(0, at - 1):at + 1]):
            spans.insert(at, (x[2], x[3]))
            kept.append(x)
    return set(kept)


def _search(items: list[tuple[object, str | None]], item_type: pa.DataType, q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items, q, rate)
        for b in batches:
            out = []
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for rows in _groups(texts):
                norm = [normalised(texts[r] or "") for r in rows]
                # Short texts are searched together; zeros keep their q-grams apart.
                gap = np.zeros(block.reach + 1, np.uint32)
                joined = np.concatenate([x for c, _ in norm for x in (c, gap)])
                starts = np.cumsum([0] + [len(c) + len(gap) for c, _ in norm])
                hit = set()
                if len(rows) > 1:
                    for _, lo, hi in block.regions(joined):
                        first, last = np.searchsorted(starts, [lo, hi], "right") - 1
                        hit.update(range(max(0, first), min(len(rows), last + 1)))
                else:
                    hit = {0}
                for r in sorted(hit):
                    codes, place = norm[r]
                    for i, edits, begin, end in sorted(_occurrences(block, codes)):
                        out.append((ids[rows[r]], block.ids[i], int(place[begin]), int(place[end - 1]) + 1, edits))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (b.schema.field(0).type, item_type, pa.int64(), pa.int64(), pa.int32()))],
                    ["doc_id", "item_id", "start", "end", "edits"])

    return run


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    part, chars = [], 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if part and chars + n > WINDOW_CHARS:
            yield part
            part, chars = [], 0
        part.append(i)
        chars += n
    if part:
        yield part


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    part, chars = [], 0
    for r in benchmark.toLocalIterator():
        if part and chars + len(r[1] or "") > BLOCK_CHARS:
            yield part
            part, chars = [], 0
        part.append((r[0], r[1]))
        chars += len(r[1] or "") + 1
    if part:
        yield part


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text", q: int = Q, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every occurrence of an item in a
    text with at most error_rate of its characters edited; of occurrences of
    an item that overlap, the one with the fewest edits."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    b = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    schema = (f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {b.schema['item_id'].dataType.simpleString()}, "
              "start long, end long, edits int")
    item_type = to_arrow_type(b.schema["item_id"].dataType)
    found = [saved(d.mapInArrow(_search(items, item_type, q, error_rate), schema), "occurrences") for items in _item_blocks(b)]
    return union(found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs, with all their columns."""
    d = docs.withColumn("_digest", F.sha2(F.col(text_col).cast("string"), 256))
    leaks = occurrences(d, benchmark, "_digest", text_col, q=q, error_rate=error_rate)
    return d.join(leaks.select(F.col("doc_id").alias("_digest")).distinct(), "_digest", "left_anti").select(docs.columns)
