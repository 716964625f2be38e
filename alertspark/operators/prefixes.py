"""J10 for networks in networks, IPv4 and IPv6, as a join by equality.

A network ``a/n`` is a 128-bit key: two BIGINTs with the address's first ``n`` bits, the
rest zero, beside its family and ``n``. ``x/m`` lies in ``a/n`` if both are of one family,
``n <= m`` and the first ``n`` bits are equal. So each row on the left is cut to every length that
occurs among the networks (at most 33 + 129 of them), and the join is an equi-join on
(family, length, key): neither a range test nor a nested loop, whatever the number of networks.

The networks are broadcast if their bytes are bounded. Otherwise both sides are shuffled and each
network is copied to ``SALTS`` salts, so that an address or a short prefix with a large share of the rows
is read by as many tasks.

Defined results: null, blank and invalid texts (leading zeros, lengths out of range, masks) lie in
nothing and contain nothing; a missing length is the full one; bits behind the length are ignored on both
sides; an IPv6 scope is ignored without a length and invalid before one; IPv4-mapped addresses
are IPv6; repeated rows on either side give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import ipv4_num, ipv6_groups_sql
from .joins import BROADCAST_MAX_BYTES, size_in_bytes

SALTS = 16
_PARTS = ("_family", "_length", "_hi", "_lo")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _mask(n: int) -> tuple[int, int]:
    """The first ``n`` of 128 bits, as two BIGINTs."""
    full = ((1 << n) - 1) << (128 - n)
    return _signed(full >> 64), _signed(full & ((1 << 64) - 1))


def _half(groups: Column, first: int) -> Column:
    parts = [F.shiftleft(groups[first + i].cast("bigint"), 48 - 16 * i) for i in range(4)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def with_prefix(df: DataFrame, col: str) -> DataFrame:
    """The rows of ``df`` whose text is an address or network, with its family (4, 6), length and
    bits. Each text is parsed once: parts come out of generators, which no filter passes."""
    text = df.withColumn("_addr", F.substring_index(col, "/", 1)) \
        .withColumn("_given", F.when(F.col(col).contains("/"), F.substring(col, F.length("_addr") + 2, 64)))
    parsed = text.withColumn("_p", F.explode(F.array(F.struct(
        ipv4_num(F.col("_addr")).alias("v4"), F.expr(ipv6_groups_sql("_addr")).alias("v6"),
        F.when(F.col("_given").rlike("^(0|[1-9][0-9]{0,2})$"), F.col("_given").try_cast("int")).alias("given"),
        (F.col("_given").isNotNull() & F.col("_addr").contains("%")).alias("scoped")))))
    v4, v6, given = F.col("_p.v4"), F.col("_p.v6"), F.col("_p.given")
    family = F.when(v4.isNotNull(), 4).when(v6.isNotNull(), 6)
    most = F.when(v4.isNotNull(), 32).otherwise(128)
    length = F.when(F.col("_given").isNull(), most).otherwise(given)
    hi = F.when(v4.isNotNull(), F.shiftleft(v4, 32)).otherwise(_half(v6, 0))
    lo = F.when(v4.isNotNull(), F.lit(0).cast("bigint")).otherwise(_half(v6, 4))
    ok = family.isNotNull() & (length <= most) & ~F.col("_p.scoped")
    whole = F.struct(*[value.alias(name) for name, value in zip(_PARTS, (family, length, hi, lo))])
    return parsed.withColumn("_n", F.explode(F.when(ok, F.array(whole)))) \
        .withColumns({name: F.col(f"_n.{name}") for name in _PARTS}).drop("_addr", "_given", "_p", "_n")


def prefix_join(df: DataFrame, col: str, networks: DataFrame, network: str = "network",
                max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Rows of ``df`` beside each row of ``networks`` that contains the address or network in
    ``col``. Column names of the two sides must differ, and none begin with ``_``."""
    nets = with_prefix(networks, network)
    lengths = sorted((r[0], r[1]) for r in nets.select("_family", "_length").distinct().collect())
    cuts = [F.struct(F.lit(f).alias("f"), F.lit(n).alias("n"), F.lit(_mask(n)[0]).alias("hi"),
                     F.lit(_mask(n)[1]).alias("lo")) for f, n in lengths]
    if not cuts:
        cuts = [F.struct(F.lit(0).alias("f"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))]
    used = F.filter(F.array(*cuts), lambda c: (c["f"] == F.col("_family")) & (c["n"] <= F.col("_length")))
    rows = with_prefix(df, col).withColumn("_cut", F.explode(used)) \
        .withColumns({"_length": F.col("_cut.n"), "_hi": F.col("_hi").bitwiseAND(F.col("_cut.hi")),
                      "_lo": F.col("_lo").bitwiseAND(F.col("_cut.lo"))}).drop("_cut")
    own = F.get(F.filter(F.array(*cuts), lambda c: (c["f"] == F.col("_family")) & (c["n"] == F.col("_length"))), F.lit(0))
    nets = nets.withColumn("_own", own).withColumns(
        {"_hi": F.col("_hi").bitwiseAND(F.col("_own.hi")), "_lo": F.col("_lo").bitwiseAND(F.col("_own.lo"))}).drop("_own")
    keys = list(_PARTS)
    if size_in_bytes(nets) <= max_bytes:
        nets = F.broadcast(nets)
    else:
        # By the row's values, not at random: a task that runs again deals its rows the same way.
        values = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(SALTS)).cast("int"))
        nets = nets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys.append("_salt")
    return rows.join(nets, keys).drop(*keys)
