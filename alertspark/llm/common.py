"""Small helpers shared by the operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertspark.session import new_table_path

#: The white space of the word rule: space and the control codes 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own switch to drop a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs a re-read instead of a recomputation. The shuffle files of
    the write go with its end: nothing reads them again. ``settings`` hold for the write."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    during = {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k) for k in during}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``saved`` gave and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "saved_path", None):
            spark = t.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def whole_text(col: Column | str) -> Column:
    """The text as a string; null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(col: Column) -> Column:
    return F.array_remove(F.split(col, r"[\x20\x09-\x0D]+"), "")


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system Spark itself uses."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Most bytes a side may have to be broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, come to at most
    BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
