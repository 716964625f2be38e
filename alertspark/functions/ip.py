"""IP parsing and classification (F1, F2, J10 helpers).

Everything is a native expression (no Python in the row path): IPv4 is
validated by regex and turned into a BIGINT by octet arithmetic; IPv6 is
expanded into its eight 16-bit groups (``::``, embedded IPv4 tail and scope
id handled) and tested against the fixed private/exception prefixes. Large
expressions are generated as SQL text, so building them costs one JVM call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (IPV4_PRIVATE_EXCEPTIONS, IPV4_PRIVATE_NETWORKS, IPV6_PRIVATE_EXCEPTIONS,
                         IPV6_PRIVATE_NETWORKS, RFC1918_NETWORKS)

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
CIDR_RE = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(/([0-9]|[12][0-9]|3[0-2]))?$"


def ip_to_num(addr: str) -> int:
    a, b, c, d = (int(x) for x in addr.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def net_bounds(addr: str, prefix: int) -> tuple[int, int]:
    base = ip_to_num(addr) & ((0xFFFFFFFF << (32 - prefix)) & 0xFFFFFFFF)
    return base, base + (1 << (32 - prefix)) - 1


def _octets_num(addr: Column) -> Column:
    parts = F.split(addr, r"\.")
    return (F.try_element_at(parts, F.lit(1)).try_cast("bigint") * 16777216
            + F.try_element_at(parts, F.lit(2)).try_cast("bigint") * 65536
            + F.try_element_at(parts, F.lit(3)).try_cast("bigint") * 256
            + F.try_element_at(parts, F.lit(4)).try_cast("bigint"))


def ipv4_num(ip: Column) -> Column:
    """Strict IPv4 text → BIGINT, else null (leading zeros, prefixes, junk → null)."""
    return F.when(ip.rlike(IPV4_RE), _octets_num(ip))


def cidr_bounds(ip: Column) -> tuple[Column, Column]:
    """``a.b.c.d`` or ``a.b.c.d/n`` (INET text) → inclusive numeric [lo, hi] of its network."""
    ok = ip.rlike(CIDR_RE)
    addr = F.split(ip, "/").getItem(0)
    plen = F.coalesce(F.try_element_at(F.split(ip, "/"), F.lit(2)).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - plen).try_cast("bigint")
    num = _octets_num(addr)
    lo = F.when(ok, num - F.pmod(num, size))
    hi = F.when(ok, num - F.pmod(num, size) + size - 1)
    return lo, hi


def in_networks(num: Column, networks) -> Column:
    """``num`` (BIGINT) inside any of the fixed (addr, prefix) networks."""
    cond = F.lit(False)
    for addr, prefix in networks:
        lo, hi = net_bounds(addr, prefix)
        cond = cond | num.between(lo, hi)
    return cond


def ipv4_is_private(num: Column) -> Column:
    return in_networks(num, IPV4_PRIVATE_NETWORKS) & ~in_networks(num, IPV4_PRIVATE_EXCEPTIONS)


def classify_ip(ip: str, role: str) -> Column:
    """F1 for a named column as one native expression: ``Internal <role>``,
    ``External <role>`` or ``unknown_<role>``.

    Python 3.13 ``ipaddress`` tests private first, so the ``localhost_`` and
    ``link_local_`` labels are unreachable (loopback and link-local ranges are
    private). For several columns prefer ``classify_cols``, which parses each
    address once into a helper column.
    """
    v6 = ipv6_groups_sql(ip)
    num = ipv4_num_sql(ip)
    v4 = classify_sql_expr_inline(num, role)
    return F.expr(f"CASE WHEN ({num}) IS NULL AND ({v6}) IS NOT NULL "
                  f"THEN concat({ipv6_class_sql('(' + v6 + ')')}, ' {role}') ELSE {v4} END")


def classify_ipv4(ip: Column, role: str, num: Column | None = None) -> Column:
    """F1 without the IPv6 branch: pure native expression (no Python)."""
    num = ipv4_num(ip) if num is None else num
    return (F.when(num.isNull(), F.lit(f"unknown_{role}"))
            .when(ipv4_is_private(num), F.lit(f"Internal {role}"))
            .otherwise(F.lit(f"External {role}")))


def cidr_bounds_sql(col: str) -> tuple[str, str]:
    """SQL text of ``cidr_bounds`` for a named column."""
    addr = f"split(`{col}`, '/')[0]"
    num = " + ".join(f"try_cast(try_element_at(split({addr}, '\\\\.'), {i}) AS BIGINT) * {m}"
                     for i, m in ((1, 16777216), (2, 65536), (3, 256), (4, 1)))
    size = f"shiftleft(1L, 32 - coalesce(try_cast(try_element_at(split(`{col}`, '/'), 2) AS INT), 32))"
    ok = f"`{col}` RLIKE '{CIDR_RE}'"
    lo = f"CASE WHEN {ok} THEN ({num}) - pmod({num}, {size}) END"
    hi = f"CASE WHEN {ok} THEN ({num}) - pmod({num}, {size}) + {size} - 1 END"
    return lo, hi


def direction_expr(col: str) -> Column:
    """F2 for a named column as one SQL expression (prefer ``with_direction``,
    which parses the address once)."""
    lo, hi = cidr_bounds_sql(col)
    cond = " OR ".join(f"(({lo}) >= {nlo} AND ({hi}) <= {nhi})"
                       for nlo, nhi in (net_bounds(a, p) for a, p in RFC1918_NETWORKS))
    return F.expr(f"CASE WHEN coalesce({cond}, false) THEN 'Inbound' ELSE 'Outbound' END")


def network_bounds_sql(col: str) -> str:
    """SQL text: INET text ``a.b.c.d[/n]`` → named_struct(lo, hi) of its
    network (NULL when not valid). Intermediate values are lambda-bound, so
    the address is split and converted once per row."""
    c = f"`{col}`"
    num = " + ".join(f"try_cast(try_element_at(split(pa[0], '\\\\.'), {i}) AS BIGINT) * {m}"
                     for i, m in ((1, 16777216), (2, 65536), (3, 256), (4, 1)))
    size = "shiftleft(1L, 32 - coalesce(try_cast(try_element_at(pa, 2) AS INT), 32))"
    inner = _let(f"named_struct('n', {num}, 's', {size})", "ns",
                 "named_struct('lo', ns.n - pmod(ns.n, ns.s), 'hi', ns.n - pmod(ns.n, ns.s) + ns.s - 1)")
    return f"CASE WHEN {c} RLIKE '{CIDR_RE}' THEN " + _let(f"split({c}, '/')", "pa", inner) + " END"


def with_network_bounds(df, col: str, lo: str, hi: str):
    """Add the numeric [lo, hi] of an INET text column."""
    df = df.select("*", F.expr(network_bounds_sql(col)).alias("_nb"))
    return df.select("*", F.col("_nb.lo").alias(lo), F.col("_nb.hi").alias(hi)).drop("_nb")


def direction_sql(col: str) -> str:
    """SQL text of F2 for a named column."""
    cond = " OR ".join(f"(b.lo >= {nlo} AND b.hi <= {nhi})"
                       for nlo, nhi in (net_bounds(a, p) for a, p in RFC1918_NETWORKS))
    return ("CASE WHEN coalesce(" + _let(network_bounds_sql(col), "b", cond) + ", false) "
            "THEN 'Inbound' ELSE 'Outbound' END")


def with_direction(df, col: str = "dest_ip", out: str = "direction"):
    """F2 on a DataFrame: ``Inbound`` when the destination network lies inside
    RFC 1918, else ``Outbound`` (null and unparsable → Outbound)."""
    return df.select("*", F.expr(direction_sql(col)).alias(out))


def direction(dest_ip: Column) -> Column:
    """``Inbound`` when the destination network lies inside RFC 1918, else ``Outbound``."""
    lo, hi = cidr_bounds(dest_ip)
    cond = F.lit(False)
    for addr, prefix in RFC1918_NETWORKS:
        nlo, nhi = net_bounds(addr, prefix)
        cond = cond | ((lo >= nlo) & (hi <= nhi))
    return F.when(F.coalesce(cond, F.lit(False)), "Inbound").otherwise("Outbound")


def with_ip_nums(df, cols=("src_ip", "dest_ip")):
    """Add ``<col>_num`` (parsed IPv4 as BIGINT) once per address column.

    The parsed value is referenced by several range tests; keeping it in its
    own column lets the optimizer keep one evaluation per row instead of
    inlining the parse into every test.
    """
    for c in cols:
        df = df.withColumn(f"{c}_num", ipv4_num(F.col(c)))
    return df


def _ranges_sql(num: str, networks) -> str:
    return "(" + " OR ".join(f"{num} BETWEEN {lo} AND {hi}"
                             for lo, hi in (net_bounds(a, p) for a, p in networks)) + ")"


def ipv4_num_sql(col: str) -> str:
    """SQL text of ``ipv4_num`` for a named column."""
    parts = " + ".join(f"try_cast(try_element_at(split(`{col}`, '\\\\.'), {i}) AS BIGINT) * {m}"
                       for i, m in ((1, 16777216), (2, 65536), (3, 256), (4, 1)))
    return f"CASE WHEN `{col}` RLIKE '{IPV4_RE}' THEN {parts} END"


def classify_sql_expr_inline(num: str, role: str) -> str:
    n = f"({num})"
    return (f"CASE WHEN {n} IS NULL THEN 'unknown_{role}' "
            f"WHEN {_ranges_sql(n, IPV4_PRIVATE_NETWORKS)} AND NOT {_ranges_sql(n, IPV4_PRIVATE_EXCEPTIONS)} "
            f"THEN 'Internal {role}' ELSE 'External {role}' END")


def classify_sql_expr(col: str, num_col: str, role: str) -> str:
    """SQL text of the IPv4 part of F1 over a parsed-number column."""
    return (f"CASE WHEN `{num_col}` IS NULL THEN 'unknown_{role}' "
            f"WHEN {_ranges_sql('`' + num_col + '`', IPV4_PRIVATE_NETWORKS)} AND NOT "
            f"{_ranges_sql('`' + num_col + '`', IPV4_PRIVATE_EXCEPTIONS)} THEN 'Internal {role}' "
            f"ELSE 'External {role}' END")


def classify_cols(df, role_cols=(("src_ip", "source", "source_type"), ("dest_ip", "destination", "destination_type")),
                  ipv6: bool = True):
    """F1 on a DataFrame: parse each address once, then classify.

    The expressions are generated as SQL text (one JVM call per column) and the
    parsed number is a separate projected column, referenced by every range
    test, so the generated code stays small."""
    nums = [F.expr(ipv4_num_sql(c)).alias(f"{c}_num") for c, _, _ in role_cols]
    if ipv6:
        nums += [F.expr(ipv6_groups_sql(c)).alias(f"{c}_v6") for c, _, _ in role_cols]
    df = df.select("*", *nums)
    outs = []
    for c, role, out in role_cols:
        v4 = classify_sql_expr(c, f"{c}_num", role)
        if ipv6:
            v6 = ipv6_class_sql(f"`{c}_v6`")
            expr = (f"CASE WHEN `{c}_num` IS NULL AND `{c}_v6` IS NOT NULL THEN concat({v6}, ' {role}') "
                    f"ELSE {v4} END")
        else:
            expr = v4
        outs.append(F.expr(expr).alias(out))
    helper = [f"{c}_num" for c, _, _ in role_cols] + ([f"{c}_v6" for c, _, _ in role_cols] if ipv6 else [])
    return df.select("*", *outs).drop(*helper)


# --------------------------------------------------------------------------- IPv6 (native)

_G = "[0-9A-Fa-f]{1,4}"
IPV6_FULL_RE = rf"^({_G}:){{7}}{_G}$"
IPV6_COMP_RE = rf"^(({_G}:){{0,6}}{_G})?::(({_G}:){{0,6}}{_G})?$"


def _v6_groups(net: str) -> list[int]:
    """Eight 16-bit groups of a literal IPv6 network address (driver-side constant)."""
    left, _, right = net.partition("::")
    lg = [int(x, 16) for x in left.split(":") if x] if left else []
    rg = [int(x, 16) for x in right.split(":") if x] if right else []
    return lg + [0] * (8 - len(lg) - len(rg)) + rg


def _v6_in_sql(arr: str, net: str, prefix: int) -> str:
    """SQL: the 8-group int array ``arr`` lies inside ``net/prefix``."""
    groups = _v6_groups(net)
    conds = []
    for i in range(8):
        bits = max(0, min(16, prefix - 16 * i))
        if bits == 0:
            break
        mask = (0xFFFF << (16 - bits)) & 0xFFFF
        g = f"{arr}[{i}]"
        conds.append(f"{g} = {groups[i] & mask}" if mask == 0xFFFF else f"({g} & {mask}) = {groups[i] & mask}")
    return "(" + " AND ".join(conds) + ")"


def _let(value: str, var: str, body: str) -> str:
    """SQL ``let``: bind ``value`` to the lambda variable ``var`` inside ``body``
    (evaluated once per row; no projection needed)."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def ipv6_groups_sql(col: str) -> str:
    """SQL text: IPv6 text (optional ``%scope``, optional embedded IPv4 tail) →
    ARRAY<INT> of its eight 16-bit groups, NULL when not a valid IPv6 literal.

    Intermediate values are bound with lambda variables, so each is computed
    once per row and the expression stays linear in size; IPv4 rows stop at
    the first test (no ``:``)."""
    c = f"`{col}`"
    tnum = " + ".join(f"try_cast(try_element_at(split(t6, '\\\\.'), {i}) AS BIGINT) * {m}"
                      for i, m in ((1, 16777216), (2, 65536), (3, 256), (4, 1)))
    groups = ("CASE WHEN w6 RLIKE '" + IPV6_FULL_RE + "' THEN split(w6, ':') "
              "WHEN w6 RLIKE '" + IPV6_COMP_RE + "' AND size(p6.l) + size(p6.r) <= 7 "
              "THEN concat(p6.l, array_repeat('0', 8 - size(p6.l) - size(p6.r)), p6.r) END")
    sides = ("named_struct('l', CASE WHEN split(w6, '::')[0] = '' THEN array() ELSE split(split(w6, '::')[0], ':') END, "
             "'r', CASE WHEN coalesce(try_element_at(split(w6, '::'), 2), '') = '' THEN array() "
             "ELSE split(try_element_at(split(w6, '::'), 2), ':') END)")
    with_tail = (f"CASE WHEN t6 NOT LIKE '%.%' THEN v6 WHEN t6 RLIKE '{IPV4_RE}' THEN "
                 f"{_let(tnum, 'n6', 'concat(substring(v6, 1, length(v6) - length(t6)), lower(hex(shiftright(n6, 16))), ' + chr(39) + ':' + chr(39) + ', lower(hex(n6 & 65535)))')} END")
    body = _let("regexp_extract(v6, '([^:]*)$', 1)", "t6",
                _let(with_tail, "w6", _let(sides, "p6", f"transform({groups}, g -> CAST(conv(g, 16, 10) AS INT))")))
    return (f"CASE WHEN {c} LIKE '%:%' AND {c} NOT LIKE '%/%' THEN "
            + _let(f"regexp_replace({c}, '%[^%/]+$', '')", "v6", body) + " END")


def ipv6_class_sql(arr: str) -> str:
    """SQL text: ``Internal`` / ``External`` for a parsed IPv6 group array (NULL → NULL).

    IPv4-mapped addresses follow the embedded IPv4 rules (Python 3.13)."""
    mapped = f"({arr}[0] = 0 AND {arr}[1] = 0 AND {arr}[2] = 0 AND {arr}[3] = 0 AND {arr}[4] = 0 AND {arr}[5] = 65535)"
    v4num = f"(CAST({arr}[6] AS BIGINT) * 65536 + {arr}[7])"
    v4priv = (f"({_ranges_sql(v4num, IPV4_PRIVATE_NETWORKS)} AND NOT {_ranges_sql(v4num, IPV4_PRIVATE_EXCEPTIONS)})")
    priv = " OR ".join(_v6_in_sql(arr, n, p) for n, p in IPV6_PRIVATE_NETWORKS)
    exc = " OR ".join(_v6_in_sql(arr, n, p) for n, p in IPV6_PRIVATE_EXCEPTIONS)
    return (f"CASE WHEN {arr} IS NULL THEN NULL WHEN {mapped} THEN "
            f"CASE WHEN {v4priv} THEN 'Internal' ELSE 'External' END "
            f"WHEN ({priv}) AND NOT ({exc}) THEN 'Internal' ELSE 'External' END")
