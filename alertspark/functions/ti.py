"""Threat-intelligence JSON handling (P6 defaulting, P7 shape unification).

TI stays a JSON string at the edges (as stored); fields are pulled with
``get_json_object`` and defaulted per field, so no UDF and no schema inference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TI_ABUSE_MALICIOUS, TI_DEFAULTS, TI_VT_MALICIOUS


def _j(col: Column, path: str) -> Column:
    return F.get_json_object(col, path)


def _int(col: Column, *paths: str, default: int = 0) -> Column:
    return F.coalesce(*[_j(col, p).try_cast("int") for p in paths], F.lit(default))


def _bool(col: Column, path: str, default: bool = False) -> Column:
    return F.coalesce(_j(col, path).try_cast("boolean"), F.lit(default))


def _str(col: Column, path: str, default) -> Column:
    return F.coalesce(_j(col, path), F.lit(default).cast("string"))


def ti_canonical(ti: Column) -> Column:
    """Canonical TI document with every field defaulted (as a JSON string)."""
    fields = []
    for provider, defaults in TI_DEFAULTS.items():
        inner = []
        for name, default in defaults.items():
            path = f"$.{provider}.{name}"
            if isinstance(default, bool):
                v = _bool(ti, path, default)
            elif isinstance(default, int):
                v = _int(ti, path, default=default)
            else:
                v = _str(ti, path, default)
            inner.append(v.alias(name))
        fields.append(F.struct(*inner).alias(provider))
    return F.to_json(F.struct(*fields))


def ti_flat(ti: Column) -> list[Column]:
    """Canonical and legacy shapes → flat typed columns (defaults applied)."""
    return [
        _int(ti, "$.abuseipdb.abuseConfidenceScore", "$.abuseipdb.score").alias("abuse_score"),
        _int(ti, "$.abuseipdb.totalReports").alias("abuse_reports"),
        _bool(ti, "$.abuseipdb.isTor").alias("is_tor"),
        _bool(ti, "$.abuseipdb.isWhitelisted").alias("is_whitelisted"),
        _int(ti, "$.virustotal.malicious").alias("vt_malicious"),
        _int(ti, "$.virustotal.suspicious").alias("vt_suspicious"),
        _int(ti, "$.alienvault.pulse_count", "$.otx.pulse_count").alias("pulse_count"),
    ]


def ti_malicious(abuse_score: Column, vt_malicious: Column) -> Column:
    """Our scorer's TI flag (cut-offs are ours, see constants)."""
    return (abuse_score >= TI_ABUSE_MALICIOUS) | (vt_malicious >= TI_VT_MALICIOUS)
