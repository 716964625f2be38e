"""Language identification by a multilingual mixture.

A text is a mixture of languages: its character n-grams are drawn each from one of
them, P(gram) = sum over l of share(l) * P(gram | l). Expectation-maximisation finds the
shares that make the text most likely, and the set of languages is chosen by penalised
likelihood: starting from the single best language, the language whose share
would raise the likelihood fastest joins if the fit with it gains more than
PENALTY * ln(grams), and so on; one whose removal costs less than that goes again. As the log likelihood is
concave in the shares, the gain is at most grams * (steepest slope - 1), so that
for nearly all texts no second fit is needed.

The prediction is the language with the largest share in the chosen set; the score
is that share, times the posterior of the single language against the
others' where the set has one (a short text that fits two languages alike scores low).

Grams are runs of ORDER characters of the text in lower case in which every run of
other characters than letters is one blank. Each falls into one of BUCKETS classes by its
digest, so the model has languages * BUCKETS numbers whatever the corpus; where that would
be over MODEL_NUMBERS, there are fewer buckets. Its counts come from every training text:
tasks add theirs up before the shuffle. P(gram | l) is smoothed with the grams' share in all languages.

Only text and lang of the training rows are learnt from, and only the text is used for a prediction.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every
text if nothing can be learnt; a null id trains and isn't held out (its remainder counts
as 0); ties go to the language that comes first; texts of any length are read whole,
in pieces; repeated rows count as often as they stand; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import dropped, saved
from .shingles import mix

ORDER, BUCKETS = 3, 1 << 16
MODEL_NUMBERS = 1 << 25
#: Share of all languages' gram distribution in each one's.
SMOOTH = 0.02
#: Log likelihood for each ln(grams) that one more language must gain. Grams overlap,
#: so each character counts ORDER times.
PENALTY = 0.5 * ORDER * 2
ROUNDS, STEP = 60, 1e-4
#: Characters handled at once, and numbers (grams by languages).
PIECE, CELLS = 500_000, 2_000_000
UNKNOWN = "und"

_TABLES: dict = {}
_U = np.uint64


def _letters() -> np.ndarray:
    """The lower case of every letter, by code point; 0 for other characters."""
    if "letters" not in _TABLES:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _TABLES["letters"] = t
    return _TABLES["letters"]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end as lower-case letters and blanks (0), a blank before and
    after each text and no two in a row within one; and the text of each code."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    c = _letters()[np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    # A code belongs to the text whose leading blank came last.
    who = np.repeat(np.arange(len(texts)), size + 1)
    who = np.append(who, len(texts) - 1 if len(texts) else 0)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (who[1:] != who[:-1])
    return c[keep], who[keep]


def _digests(c: np.ndarray) -> np.ndarray:
    n = len(c) - ORDER + 1
    h = np.zeros(max(0, n), _U)
    for k in range(ORDER if n > 0 else 0):
        h = h * _U(0x9E3779B97F4A7C15) + c[k:k + n]
    return mix(h)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every gram."""
    c, who = codes(texts)
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # The blank that ends a text is the next one's first: a gram must not reach past it.
    inner = c[ORDER - 1:] != 0
    for k in range(1, ORDER - 1):
        inner |= c[k:k + n] != 0
    same = (who[:n] == who[ORDER - 1:]) | ((c[ORDER - 1:] == 0) & (who[:n] == who[ORDER - 2:ORDER - 2 + n]))
    ok = inner & same
    return who[:n][ok], (_digests(c)[ok] % _U(buckets)).astype(np.int64)


def _long(text: str, buckets: int) -> np.ndarray:
    """Counts by bucket of a text of any length, PIECE characters at a time."""
    out, carry = np.zeros(buckets, np.int64), np.zeros(1, np.uint32)
    for a in range(0, len(text), PIECE):
        c = np.concatenate([carry, _letters()[np.frombuffer(text[a:a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)],
                            np.zeros(int(a + PIECE >= len(text)), np.uint32)])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep]
        out += np.bincount((_digests(c) % _U(buckets)).astype(np.int64), minlength=buckets)
        carry = c[1 - ORDER:]
    return out


def counted(texts: list[str | None], buckets: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, text number, bucket, count) about PIECE characters at a time: the text numbers, in
    order, index the rows. A longer text comes alone."""
    def some() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        who, g = grams([texts[i] or "" for i in rows], buckets)
        key, n = np.unique(who * buckets + g, return_counts=True)
        return rows, key // buckets, key % buckets, n

    rows, n = [], 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if size > PIECE:
            t = _long(t, buckets)
            at = np.flatnonzero(t)
            yield [i], np.zeros(len(at), np.int64), at, t[at]
            continue
        if n + size > PIECE:
            yield some()
            rows, n = [], 0
        rows.append(i)
        n += size + 1
    if rows:
        yield some()


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for rows, who, g, n in counted(texts, buckets):
                names = sorted({langs[i] for i in rows})
                mine = np.array([names.index(langs[i]) for i in rows])[who]
                for k, name in enumerate(names):
                    if name not in sums and len(sums) >= 64:
                        yield from out()
                    t = sums.setdefault(name, np.zeros(buckets, np.int64))
                    np.add.at(t, g[mine == k], n[mine == k])
        yield from out()

    return run


class Model:
    """Languages, in order, and P(bucket | language), a row for each bucket."""

    def __init__(self, langs: list[str], p: np.ndarray):
        self.langs, self.p = langs, p

    def fit(self, c: np.ndarray, p: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages of ``p``'s columns, and the log likelihood."""
        n = c.sum()
        for _ in range(ROUNDS):
            q = p @ share
            new = share * (c / q @ p) / n
            done = np.abs(new - share).max() < STEP
            share = new
            if done:
                break
        return share, float(c @ np.log(p @ share))

    def mixture(self, c: np.ndarray, p: np.ndarray, single: np.ndarray) -> dict[int, float]:
        """The chosen languages and their shares; ``single`` has the log likelihood of each alone."""
        n, price = c.sum(), PENALTY * np.log(c.sum() + 1)
        chosen, share, best = [int(single.argmax())], np.ones(1), float(single.max())
        while len(chosen) < p.shape[1]:
            slope = c / (p[:, chosen] @ share) @ p / n
            slope[chosen] = 0
            k = int(slope.argmax())
            if n * (slope[k] - 1) <= price:
                break
            new, got = self.fit(c, p[:, [*chosen, k]], np.append(share * 0.9, 0.1))
            if got - best <= price:
                break
            chosen, share, best = [*chosen, k], new, got
            # One of the earlier languages may have become needless.
            while len(chosen) > 1:
                j = int(share.argmin())
                rest = [x for x in range(len(chosen)) if x != j]
                new, got = self.fit(c, p[:, [chosen[x] for x in rest]], share[rest] / share[rest].sum())
                if best - got > price:
                    break
                chosen, share, best = [chosen[x] for x in rest], new, got
        return dict(zip(chosen, share.tolist()))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        none = (UNKNOWN, 0.0, [], [])
        out = [none] * len(texts)
        if not self.langs:
            return out
        for rows, who, g, n in counted(texts, len(self.p)):
            self._decide(out, np.array(rows), who, g, n)
        return out

    def _decide(self, out: list, rows: np.ndarray, who: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        """Predictions of some texts, whose grams come in the texts' order."""
        step = max(1, CELLS // len(self.langs))
        ids, at = np.unique(who, return_index=True)
        at = np.append(at, len(who))
        k = 0
        while k < len(ids):
            z = max(k + 1, int(np.searchsorted(at, at[k] + step, "right")) - 1)
            a, e = at[k], at[z]
            p, c = self.p[bucket[a:e]].astype(np.float64), n[a:e].astype(np.float64)
            single = np.add.reduceat(c[:, None] * np.log(p), at[k:z] - a, 0)
            for j in range(k, z):
                x, y = at[j] - a, at[j + 1] - a
                got = self.mixture(c[x:y], p[x:y], single[j - k])
                order = sorted(got, key=lambda i: (-got[i], i))
                score = got[order[0]]
                if len(order) == 1:
                    # Overlapping grams: each character's evidence counts once.
                    v = (single[j - k] - single[j - k].max()) / ORDER
                    score = 1 / np.exp(v).sum()
                out[int(rows[ids[j]])] = (self.langs[order[0]], float(min(1.0, max(0.0, score))),
                                          [self.langs[i] for i in order], [float(got[i]) for i in order])
            k = z


def remainder(id_col: Column, of: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % of, F.lit(0))


def distributions(counts: np.ndarray) -> np.ndarray:
    """P(bucket | language), a row for each bucket, of counts with a row for each language."""
    total = counts.sum(1, keepdims=True)
    everywhere = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1])
    return ((1 - SMOOTH) * counts / np.maximum(total, 1) + SMOOTH * everywhere).T.astype(np.float32).copy()


def learn(rows: DataFrame, buckets: int = BUCKETS) -> Model:
    """The model of the rows (lang, text)."""
    train = rows.where("lang is not null and text is not null")
    langs = sorted(r[0] for r in train.select("lang").distinct().collect())
    while buckets > 256 and len(langs) * buckets > MODEL_NUMBERS:
        buckets //= 2
    sums = saved(train.select("lang", "text").mapInArrow(_count(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")), "language-counts")
    counts = np.zeros((len(langs), buckets))
    for k, lang in enumerate(langs):
        # A language at a time, at most BUCKETS rows.
        got = sums.where(F.col("lang") == lang).select("bucket", "n").toArrow()
        counts[k, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    dropped(sums)
    return Model(langs, distributions(counts))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) for every row: the chosen languages by falling share."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = d.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.p))  # plain values: tasks need no package
    fields = pa.schema([("doc_id", to_arrow_type(id_type)), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            got = model.predict(b.column("text").to_pylist())
            cols = list(zip(*got)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(fields)[1:])]], schema=fields)

    return d.mapInArrow(run, f"doc_id {id_type.simpleString()}, lang_pred string, score double, languages array<string>, shares array<double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", of: int = 4, out_of: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) for every row. Rows whose id's CRC-32
    leaves ``out_of`` when divided by ``of`` are held out; the others' text and language are learnt from."""
    rest = remainder(F.col(id_col), of)
    model = learn(docs.where(rest != out_of).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    got = predict(docs, model, id_col, text_col)
    return got.select("doc_id", (remainder(F.col("doc_id"), of) == out_of).alias("held_out"), "lang_pred", "score", "languages", "shares")
