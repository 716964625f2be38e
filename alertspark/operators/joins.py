"""Join helpers shared by the operators.

* ``broadcast_if_bounded`` — a side gets a broadcast hint only if its estimated
  bytes are under a limit; otherwise the plan keeps a shuffle join and AQE may
  still convert it at runtime from measured sizes.
* ``cidr_join`` — range join "address inside network" as an equi-join on the
  /16 bucket plus a range filter, so it scales to large network lists without
  a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes, by the optimizer's estimate, of a side that gets a broadcast hint.
BROADCAST_MAX_BYTES = 64 << 20


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; exact for what is cached or read from files
    without filters, and never below the files' size for unknown plans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_bounded(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df


def cidr_join(df: DataFrame, num: Column, networks: DataFrame, how: str = "inner",
              lo: str = "net_lo", hi: str = "net_hi") -> DataFrame:
    """Rows of ``df`` whose BIGINT address ``num`` lies in [lo, hi] of a network.

    Each network is expanded to the /16 buckets it covers (at most 65,536 for a
    /0, one for anything /16 or longer); the join is then an equi-join on the
    bucket followed by the exact range test.
    """
    nets = networks.withColumn(
        "_bucket", F.explode(F.sequence(F.shiftright(F.col(lo), 16), F.shiftright(F.col(hi), 16))))
    left = df.withColumn("_bucket", F.shiftright(num, 16)).withColumn("_num", num)
    cond = (left["_bucket"] == nets["_bucket"]) & left["_num"].between(nets[lo], nets[hi])
    out = left.join(nets, cond, how)
    return out.drop(nets["_bucket"]).drop(left["_bucket"]).drop("_num")
