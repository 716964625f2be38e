"""Quality rules with risk-controlled thresholds.

Four signals per document, in thousandths: symbols per word, repeated lines
per non-blank line, words in repeated five-word windows per word, and characters per word.
A rule rejects a document whose signal is above its cutoff. Cutoffs are chosen
per stratum on the labelled holdout: cutoff t is *certified* when the exact
binomial bound shows that it rejects at most ``risk / rules`` of the good
documents, i.e. P(Bin(n, risk / rules) <= k) <= delta / tests with k of the n
labelled good documents rejected. ``tests`` counts every (stratum, rule,
cutoff), so with probability 1 - delta all cutoffs chosen hold at once
(Bonferroni), and a stratum loses at most ``risk`` of its good documents over
all rules. Of the certified cutoffs a rule takes the one with the most
rejected bad less rejected good documents, the laxest on ties, and none if
that is not above 0. Without labels, or with too few, a stratum keeps
everything the base rule keeps.

All of it is DataFrame functions; the holdout is every labelled row.

Defined results: null text has no words and fails the base rule; a null
stratum is a stratum of its own; a document labelled more than once is good if
any label says so; null labels and labels without a document are ignored;
repeated rows each give a row (each counts for its label); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved, whole_text, words

WINDOW = 5
#: Least words, and most repeated words per hundred, of the base rule.
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
#: Most good documents of a stratum that may be lost, and the chance of more.
RISK, DELTA = 0.02, 0.05
#: Candidate cutoffs of each signal, in thousandths.
CUTOFFS = {
    "symbols": (50, 100, 200, 400, 800),
    "dup_lines": (100, 200, 300, 400, 600),
    "repeats": (50, 80, 110, 140, 170),
    "word_chars": (7000, 8000, 10000, 15000, 25000),
}
STRATUM_NULL = "(null)"


def _repeat_words(w):
    """Words covered by five-word windows that occur twice or more."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    digests = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    # Equal windows have equal digests, so distinct digests prove that there
    # is no repeat; only then is the exact comparison of windows skipped.
    grams = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("g"), i.alias("i"))))
    exact = F.element_at(F.transform(F.array(grams), lambda a: F.size(F.array_distinct(F.flatten(F.transform(
        F.filter(a, lambda x, j: F.coalesce(x["g"] == F.get(a, j - 1)["g"], F.lit(False))
                 | F.coalesce(x["g"] == F.get(a, j + 1)["g"], F.lit(False))),
        lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1))))))), 1)
    has = F.element_at(F.transform(F.array(digests), lambda d: F.size(F.array_distinct(d)) < F.size(d)), 1)
    return F.when(F.size(w) <= WINDOW, 0).when(has, exact).otherwise(0).cast("long")


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the counts, the base verdict and the signals."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit(STRATUM_NULL)).alias("stratum"),
                    whole_text(text_col).alias("_t"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    d = d.withColumn("_w", words(F.col("_t")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Counts come out of a generator: a filter on them is not pushed below, where they would be counted again.
    d = d.select("doc_id", "stratum", *[f"_k_{c}" for c in keep], F.inline(F.array(F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words")))))
    n = F.greatest("n_words", F.lit(1))
    per_mille = lambda a, b: F.floor(F.col(a) * 1000 / b).cast("long")
    return d.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
        "symbols": per_mille("n_symbols", n), "dup_lines": per_mille("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        "repeats": per_mille("n_repeat_words", n), "word_chars_pm": per_mille("word_chars", n)})


_SIGNAL = {"word_chars": "word_chars_pm"}


def _tail(n, k, p: float):
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    ratio = F.lit(p / (1 - p))
    first = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.exp(n * F.log1p(F.lit(-p))).alias("s"))
    step = lambda a, i: F.struct(
        (a["t"] + F.log((n - i + 1) / i * ratio)).alias("t"),
        (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i * ratio))).alias("s"))
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
                       first, step, lambda a: F.least(a["s"], F.lit(1.0)))


def thresholds(sig: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cutoffs=CUTOFFS) -> DataFrame:
    """(stratum, one cutoff column per signal; null: no cutoff)."""
    lab = labels.select(F.col("doc_id"), F.col("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max(F.col("quality").cast("int")).alias("good"))
    held = sig.where("not base_failed").join(lab, "doc_id").select("stratum", "good", *[_SIGNAL.get(c, c) for c in cutoffs])
    # One pass counts every candidate: a handful of sums per stratum.
    sums = [F.sum(F.when((F.col("good") == g) & (F.col(_SIGNAL.get(c, c)) > t), 1).otherwise(0)).alias(f"{c}_{t}_{g}")
            for c, ts in cutoffs.items() for t in ts for g in (0, 1)]
    per = held.groupBy("stratum").agg(F.sum("good").cast("long").alias("n"), *sums)
    per = saved(per, "rule-counts")
    tests = F.lit(max(1, per.count()) * sum(map(len, cutoffs.values())))
    out = per
    for c, ts in cutoffs.items():
        cand = F.array(*[F.struct((F.col(f"{c}_{t}_0") - F.col(f"{c}_{t}_1")).alias("gain"), F.lit(t).alias("cutoff"),
                                  F.col(f"{c}_{t}_1").alias("k")) for t in ts])
        fine = F.filter(cand, lambda x: (x["gain"] > 0) & (
            _tail(F.col("n"), x["k"], risk / len(cutoffs)) <= F.lit(delta) / tests))
        out = out.withColumn(f"cut_{c}", F.array_max(fine)["cutoff"])
    return out.select("stratum", "n", *[f"cut_{c}" for c in cutoffs])


def _cutoffs(sig: DataFrame, labels: DataFrame, risk: float, delta: float, cutoffs) -> DataFrame:
    return saved(thresholds(sig, labels, risk, delta, cutoffs), "rule-cutoffs").drop("n")


def _kept(sig: DataFrame, cuts: DataFrame, cutoffs) -> DataFrame:
    """``sig`` with the verdict in ``kept``."""
    over = [F.coalesce(F.col(_SIGNAL.get(c, c)) > F.col(f"cut_{c}"), F.lit(False)) for c in cutoffs]
    bad = functools.reduce(lambda x, y: x | y, over)
    return sig.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~bad)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                risk: float = RISK, delta: float = DELTA, cutoffs=CUTOFFS) -> DataFrame:
    """The counts of every document, base_failed and kept."""
    sig = saved(signals(docs, id_col, text_col, stratum_col), "rule-signals")
    return _kept(sig, _cutoffs(sig, labels, risk, delta, cutoffs), cutoffs).select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                   risk: float = RISK, delta: float = DELTA, cutoffs=CUTOFFS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Signals are counted
    twice, for the cutoffs (of labelled rows only, where the labels' ids can be broadcast) and for
    the verdicts, so no copy of the texts is written."""
    ids = labels.select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    labelled = docs.join(F.broadcast(ids), id_col, "left_semi") if ids.count() * 8 <= BROADCAST_BYTES else docs
    cuts = _cutoffs(signals(labelled, id_col, text_col, stratum_col), labels, risk, delta, cutoffs)
    sig = signals(docs, id_col, text_col, stratum_col, tuple(docs.columns))
    return _kept(sig, cuts, cutoffs).where("kept").select([F.col(f"_k_{c}").alias(c) for c in docs.columns])
