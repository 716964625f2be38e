"""Historical knowledge base.

The KB is a table ``(id, key, value, embedding)``. Writes are whole-table
``overwrite`` (refresh / clear) or ``append``; validation failures reject the
whole batch, as in the reference store. Text embedding is a Spark ML feature
chain (tokenise → hashed term frequencies → IDF → L2 normalise) fitted on the
KB keys, so KB and query vectors share one vocabulary weighting.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import py_strip
from ..schemas import KB

EMBED_DIM = 1024
#: Terms of a fitted vocabulary, which the driver holds.
MAX_TERMS = 1 << 18


class KBValidationError(ValueError):
    pass


def _blank(c: Column) -> Column:
    return c.isNull() | (py_strip(c) == "")


def validate_records(records: DataFrame) -> DataFrame:
    """S6 checks per record: id and key must be non-blank, value may be blank
    but not null. Adds ``reasons`` (array) and trimmed id/key/value."""
    reasons = F.array_compact(F.array(
        F.when(_blank(F.col("id")), F.lit("id must be a non-empty string")),
        F.when(_blank(F.col("key")), F.lit("key must be a non-empty string")),
        F.when(F.col("value").isNull(), F.lit("value must be a string"))))
    return records.select(py_strip(F.col("id")).alias("id"), py_strip(F.col("key")).alias("key"),
                          py_strip(F.col("value")).alias("value"), reasons.alias("reasons"))


def add_records(records: DataFrame, path: str) -> int:
    """Validate, trim and append. One bad record fails the batch (nothing is
    written); an empty batch is a no-op. Returns the number of records added."""
    v = validate_records(records).cache()
    stats = v.agg(F.count("*").alias("n"), F.count_if(F.size("reasons") > 0).alias("bad")).first()
    try:
        if stats["n"] == 0:
            return 0
        if stats["bad"] > 0:
            raise KBValidationError(f"{stats['bad']} invalid record(s); batch rejected")
        out = v.drop("reasons").withColumn("embedding", F.lit(None).cast("array<float>"))
        out.write.mode("append").parquet(path)
        return int(stats["n"])
    finally:
        v.unpersist()


def bulk_load(patterns: DataFrame, path: str, clear_existing: bool = True, order_col: str = "ordinal") -> None:
    """Ids ``pattern_<n>`` by input position (1-based ``order_col``); full
    refresh when ``clear_existing`` else append; no trimming on this path."""
    out = patterns.select(F.concat(F.lit("pattern_"), F.col(order_col).cast("string")).alias("id"),
                          "key", "value", F.lit(None).cast("array<float>").alias("embedding"))
    out.write.mode("overwrite" if clear_existing else "append").parquet(path)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KB).parquet(path)


def full_scan(kb: DataFrame) -> DataFrame:
    """Every record as (id, key, value)."""
    return kb.select("id", "key", "value")


def lookup(kb: DataFrame, record_id: str) -> DataFrame:
    """Point lookup; blank id → no row; missing value → ``""``."""
    rid = (record_id or "").strip()
    if not rid:
        return kb.limit(0).select("id", "key", "value")
    return kb.filter(F.col("id") == rid).select("id", "key", F.coalesce("value", F.lit("")).alias("value"))


def clear(spark: SparkSession, path: str) -> None:
    """Delete all records (overwrite with an empty table of the same schema)."""
    spark.createDataFrame([], KB).write.mode("overwrite").parquet(path)


def kb_count(kb: DataFrame) -> DataFrame:
    """Record count."""
    return kb.agg(F.count("*").cast("bigint").alias("kb_count"))


# --------------------------------------------------------------------------- F16

def fit_text_embedder(kb: DataFrame, text_col: str = "key", dim: int | None = EMBED_DIM):
    """F16: fit the IDF weights on the KB texts; returns a transform function
    ``(df, text_col) → df + embedding ARRAY<FLOAT>`` (unit L2 norm). Terms are hashed
    to ``dim`` numbers; with ``dim=None`` each term of the KB has a number of its own
    (up to MAX_TERMS, the most common ones), and terms the KB lacks count for none."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    if dim is None:
        tf = CountVectorizer(inputCol="_tok", outputCol="_tf", vocabSize=MAX_TERMS).fit(tok.transform(kb))
    else:
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    idf_model = IDF(inputCol="_tf", outputCol="_tfidf").fit(tf.transform(tok.transform(kb)))
    norm = Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)

    def embed(df: DataFrame, col: str = text_col) -> DataFrame:
        t = RegexTokenizer(inputCol=col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
        out = norm.transform(idf_model.transform(tf.transform(t.transform(df))))
        return out.withColumn("embedding", vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_tfidf", "_vec")

    return embed
