"""Port, volume, window and threshold normalisation.

All functions return native Column expressions (higher-order functions over
arrays, CASE ladders), so they run inside whole-stage codegen with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_QUERY_LENGTH, PORT_SERVICES, UNKNOWN_SERVICE
from .ip import classify_ip

def _port_map() -> Column:
    return F.create_map(*[x for p, s in PORT_SERVICES.items() for x in (F.lit(p), F.lit(s))])


def port_services(ports: Column) -> Column:
    """ports → service names; unmapped → ``unknown service``; null/negative
    elements dropped (they are not digit strings); order and duplicates kept."""
    port_map = _port_map()
    kept = F.filter(F.coalesce(ports, F.array().cast("array<int>")),
                    lambda p: p.isNotNull() & (p >= 0))
    return F.transform(kept, lambda p: F.coalesce(F.element_at(port_map, p), F.lit(UNKNOWN_SERVICE)))


def event_volume(n: Column) -> Column:
    """null → unknown; < 20 low; < 100 medium; else high."""
    return (F.when(n.isNull(), "unknown event volume")
            .when(n < 20, "low event volume")
            .when(n < 100, "medium event volume")
            .otherwise("high event volume"))


def _or_default(c: Column, default: str) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace (Spark ``trim`` only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def build_query(rule_name: Column, src_ip: str, dest_ip: str, protocol: Column,
                ports: Column, event_count: Column,
                source_type: Column | None = None, destination_type: Column | None = None) -> Column:
    """deterministic retrieval sentence, stripped and cut to 500 characters.

    ``src_ip`` / ``dest_ip`` are column names; pass ``source_type`` /
    ``destination_type`` precomputed (F1 via ``classify_cols``) to avoid
    classifying the same address twice."""
    services = F.array_join(port_services(ports), ", ")
    st = source_type if source_type is not None else classify_ip(src_ip, "source")
    dt = destination_type if destination_type is not None else classify_ip(dest_ip, "destination")
    text = F.concat(
        F.lit("Security behavior: "), _or_default(rule_name, "Unknown Rule"),
        F.lit(". Source type: "), st,
        F.lit(". Destination type: "), dt,
        F.lit(". Protocol: "), _or_default(protocol, "Unknown protocol"),
        F.lit(". Target services: "), F.when(services == "", F.lit("unknown")).otherwise(services),
        F.lit(". Event volume: "), event_volume(event_count), F.lit("."))
    return F.substring(py_strip(text), 1, MAX_QUERY_LENGTH)


# Units for window text and volume thresholds (our choice: decimal GB).
_WINDOW_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_VOLUME_UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}


def window_seconds(tw: Column) -> Column:
    """``30s``/``60s``/``2m``/``15m`` → seconds (BIGINT); other text → null."""
    num = F.regexp_extract(tw, r"^\s*([0-9]+)\s*([smhd])\s*$", 1)
    unit = F.regexp_extract(tw, r"^\s*([0-9]+)\s*([smhd])\s*$", 2)
    mult = None
    for u, m in _WINDOW_UNITS.items():
        mult = F.when(unit == u, F.lit(m)) if mult is None else mult.when(unit == u, F.lit(m))
    return F.when(num != "", num.cast("bigint") * mult)


def threshold_value(text: Column) -> Column:
    """``>20`` / ``>10`` / ``>1GB`` → numeric bound (DOUBLE)."""
    pat = r"^\s*(>=|>|<=|<|=)?\s*([0-9]+(\.[0-9]+)?)\s*([KMGT]?B)?\s*$"
    num = F.regexp_extract(text, pat, 2)
    unit = F.regexp_extract(text, pat, 4)
    mult = None
    for u, m in _VOLUME_UNITS.items():
        mult = F.when(unit == u, F.lit(float(m))) if mult is None else mult.when(unit == u, F.lit(float(m)))
    return F.when(num != "", num.cast("double") * mult)


def threshold_op(text: Column) -> Column:
    op = F.regexp_extract(text, r"^\s*(>=|>|<=|<|=)", 1)
    return F.when(op == "", F.lit("=")).otherwise(op)


def confidence_band(c: Column) -> Column:
    """≥85 strong; ≥65 supported; ≥50 ambiguous; else weak."""
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(c >= 85, "strong").when(c >= 65, "supported")
            .when(c >= 50, "ambiguous").otherwise("weak"))


# FIXED VALUES — payload patterns named by the sqli / xss playbooks
# (``SQL comment`` taken as ``--`` or ``/*``; the script tag for xss).
SQLI_PATTERNS = ["UNION SELECT", "OR 1=1", "INFORMATION_SCHEMA", "--", "/*"]
XSS_PATTERN = "<script"
SQLI_REGEX = r"(?i)(union\s+select|or\s+1\s*=\s*1|information_schema|--|/\*)"
XSS_REGEX = r"(?i)<script"
