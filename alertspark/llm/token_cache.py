"""Token counts through a digest cache.

Each text is addressed by the SHA-256 of its normalised content, each tokenizer
by the SHA-256 of its file. Counts live in an append-only table keyed by both
digests: stored counts are joined, only distinct missing texts are encoded,
and their counts are appended.

Normalisation must not change the count. The tokenizer files keep white space
and case, so it is the identity on texts, with null as the empty text.

Defined results: null and empty texts count 0 tokens of 0 bytes; repeated rows
each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertspark.session import new_table_path

from .common import exists, whole_text

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
#: Texts go to the tokenizer in lists of about this many characters.
ENCODE_CHARS = 4_000_000


def _encoder(model: bytes, kind: str):
    if kind == "model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model.decode())
    t.no_padding()
    t.no_truncation()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        if part and chars + len(t) > ENCODE_CHARS:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


def _count(model: bytes, kind: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or _encoder(model, kind)
            n = [x for part in _pieces(b.column("text").to_pylist()) for x in encode(part)]
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())],
                ["digest", "tokenizer", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, n_tokens) for every row of ``docs``.

    ``cache_path``: folder of the cache on shared storage; a fresh one if not
    given. The tokenizer file is read by the driver and travels with the tasks.
    One writer at a time; texts counted twice after a broken run do no harm,
    as reading the cache keeps one count per digest.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_table_path(spark, "token-cache")
    with open(model_path, "rb") as f:
        model = f.read()
    kind = "model" if model_path.endswith(".model") else "json"
    tokenizer = hashlib.sha256(model).hexdigest()

    def stored() -> DataFrame:
        if not exists(spark, cache_path):
            return spark.createDataFrame([], "digest string, n_tokens long")
        c = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
        return c.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    keyed = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).select(
        "doc_id", "text", F.sha2(F.col("text"), 256).alias("digest"))
    # Copies fall together before the shuffle, so a text held by a third of
    # all rows moves once per task; the anti-join reuses that shuffle.
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(stored(), "digest", "left_anti")
    misses.mapInArrow(_count(model, kind, tokenizer), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(
        stored(), "digest", "left").select("doc_id", "digest", "n_bytes", "n_tokens")
