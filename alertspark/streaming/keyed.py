"""Keyed state as Spark tables: a bucketed snapshot plus the changes since.

Rows of a batch are appended as its delta; what is stored of a key is the ``merge`` of its
rows, in any order. Every so many deltas the buckets they touch are written anew, in a
place of their own, and a manifest that lists the buckets' places commits them. The
number of buckets doubles as rows grow, so a bucket's size stays and a batch that asks for its
own keys reads those keys' buckets and some deltas, however long the history.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import child_names, delete_path, path_exists

MANIFEST = "bucket long, path string, rows long"


class KeyedTable:
    """``merge`` maps rows to one state per key (or key and more columns) in the same schema and must be
    associative. Batch ids ascend; a batch that is run again overwrites its own delta and reads
    only those before it. One query writes; a reader's version stays until the second compaction after it.

    The driver holds the places of the buckets that are read: at most one for each asked key."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str,
                 merge: Callable[[DataFrame], DataFrame], target_rows: int = 1 << 17, compact_every: int = 16):
        self.spark, self.path, self.key, self.merge = spark, path.rstrip("/"), key, merge
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.target_rows, self.compact_every = target_rows, compact_every

    # ---- what is there

    def _versions(self) -> list[tuple[int, int]]:
        """(last batch in it, bits of the bucket number) of every committed snapshot, oldest first."""
        names = child_names(self.spark, f"{self.path}/manifest")
        found = [tuple(int(x) for x in n.split("-")) for n in names if path_exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        return sorted(found)

    def _manifest(self, version: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version[0]}-{version[1]}")

    def _deltas(self, after: int, before: int) -> list[int]:
        return sorted(b for b in map(int, child_names(self.spark, f"{self.path}/delta")) if after < b < before)

    def _bucket(self, bits: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(1 << bits))

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _delta_rows(self, batches: list[int]) -> DataFrame:
        return self._rows([f"{self.path}/delta/{b}" for b in batches])

    # ---- use

    def read(self, before: int, keys: DataFrame | None = None) -> DataFrame:
        """The state after all batches before ``before``, of the keys in ``keys`` or of all."""
        versions = [v for v in self._versions() if v[0] < before]
        after, places = -1, []
        if versions:
            after, bits = versions[-1]
            m = self._manifest(versions[-1])
            if keys is not None:
                m = m.join(keys.select(self._bucket(bits).alias("bucket")).distinct(), "bucket", "left_semi")
            places = [r.path for r in m.select("path").collect()]
        rows = self._rows(places).unionByName(self._delta_rows(self._deltas(after, before)))
        if keys is not None:
            asked = keys.select(F.col(self.key).alias("_asked")).distinct()
            rows = rows.join(asked, F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi")
        return self.merge(rows)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/delta/{batch_id}")

    def discard(self, batch_id: int) -> None:
        """Take back a batch that was not finished."""
        delete_path(self.spark, f"{self.path}/delta/{batch_id}")

    def compact(self, before: int) -> bool:
        """Once there are enough deltas of batches before ``before``: merge them into the buckets they touch."""
        versions = [v for v in self._versions() if v[0] < before]
        after, bits = versions[-1] if versions else (-1, 0)
        batches = self._deltas(after, before)
        if len(batches) < self.compact_every:
            return False
        delta = self._delta_rows(batches)
        old = self._manifest(versions[-1]) if versions else self.spark.createDataFrame([], MANIFEST)
        rows = (old.agg(F.sum("rows")).first()[0] or 0) + delta.count()
        wanted = max(bits, math.ceil(math.log2(rows / self.target_rows))) if rows > self.target_rows else bits
        touched, kept = old, old.limit(0)
        if wanted == bits:
            hit = delta.select(self._bucket(bits).alias("bucket")).distinct()
            touched, kept = old.join(hit, "bucket", "left_semi"), old.join(hit, "bucket", "left_anti")
        # Else all buckets are dealt anew: a doubling, so its cost for each row added stays.
        places = [r.path for r in touched.select("path").collect()]
        out, last = f"{self.path}/snapshot/{batches[-1]}", batches[-1]
        (self.merge(self._rows(places).unionByName(delta)).withColumn("bucket", self._bucket(wanted))
         .repartition("bucket").sortWithinPartitions("bucket", self.key)
         .write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket").parquet(out))
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])).parquet(out)
        listed = written.groupBy("bucket").agg(F.count("*").alias("rows")).select(
            "bucket", F.concat(F.lit(f"{out}/bucket="), F.col("bucket").cast("string")).alias("path"), "rows")
        listed.unionByName(kept).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{last}-{wanted}")
        self._clean(versions)
        return True

    def _clean(self, earlier: list[tuple[int, int]]) -> None:
        """Delete what only versions before the last one of ``earlier`` use."""
        for version, following in zip(earlier[:-1], earlier[1:]):
            gone = self._manifest(version).join(self._manifest(following).select("path"), "path", "left_anti")
            for r in gone.select("path").collect():
                delete_path(self.spark, r.path)
            delete_path(self.spark, f"{self.path}/manifest/{version[0]}-{version[1]}")
        if earlier:
            for b in self._deltas(-1, earlier[-1][0] + 1):
                delete_path(self.spark, f"{self.path}/delta/{b}")


def summed(keys: list[str], measures: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that adds up: {measure: type}. Rows that add up to nothing go."""
    def merge(rows: DataFrame) -> DataFrame:
        g = rows.groupBy(*keys).agg(*[F.sum(m).cast(t).alias(m) for m, t in measures.items()])
        some = F.lit(False)
        for m in measures:
            some = some | (F.col(m) != 0)
        return g.where(some)
    return merge
