"""Word shingles of texts as 64-bit digests, many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Words handled at a time, and words whose digest is remembered.
BATCH_WORDS = 400_000
CACHE_WORDS = 200_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordDigests(dict):
    """word -> digest; words are bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        d = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = d
        return d


def text_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered; bytes.split() parts at exactly the
    white space of the word rule."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None], n: int, digests: WordDigests) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of the distinct n-word shingles of each text,
    sorted. A text of fewer words is one shingle; one without words has none."""
    lists = [text_words(t) for t in texts]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(size.sum())
    flat = np.fromiter((digests[w] for ws in lists for w in ws), _U, total)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    long = size >= n
    count = np.where(long, size - n + 1, (size > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lists)), count)
    first = np.repeat(start, count) + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    width = np.minimum(np.repeat(size, count), n)
    h = mix(width.astype(_U))
    for k in range(n):
        at = k < width
        w = np.where(at, flat[np.minimum(first + k, total - 1)], _U(0)) if total else h
        h = np.where(at, mix(h * _U(0x9E3779B97F4A7C15) + w), h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def parts(texts: list[str | None]) -> Iterator[slice]:
    """Slices of the list of about BATCH_WORDS words (six characters a word)."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t or "") > 6 * BATCH_WORDS:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += len(t or "") + 1
    if begin < len(texts):
        yield slice(begin, len(texts))
