"""Organisational reference data → typed dimension DataFrames.

The source is a JSON-lines file with rows ``{reference_type, data}`` (two rows:
``playbooks`` and ``network_info``). Spark parses it with explicit
``from_json`` schemas and explodes it into four small dimensions: playbooks,
assets, segmentation rules and approved endpoints.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PORT_SERVICES
from ..functions.ip import cidr_bounds

DEFAULT_REFERENCE = os.path.join(os.path.dirname(__file__), "..", "data", "security_reference.jsonl")
REFERENCE_TYPES = ("playbooks", "network_info")

# FIXED VALUES — service names that appear in segmentation rules, mapped to ports
# (the port map of the query builder, inverted, plus RPC's endpoint mapper).
SERVICE_PORTS = {**{name.upper(): port for port, name in PORT_SERVICES.items()}, "RPC": 135}

_PLAYBOOKS = "map<string, struct<severity: string, match: string, actions: array<string>>>"
_NETWORK = ("struct<assets: map<string, struct<name: string, type: string, criticality: string, "
            "external_ingress: boolean, zone: string, owner: string>>, "
            "segmentation: array<struct<src: string, dst: string, protocols: array<string>, "
            "allowed: boolean, exception: string>>, "
            "approved_destinations: map<string, map<string, struct<approved: boolean, purpose: string, "
            "allowed_protocols: array<string>, allowed_ports: array<string>, owner: string>>>>")


def read_reference_raw(spark: SparkSession, path: str | None = None) -> DataFrame:
    raw = spark.read.text(path or os.path.abspath(DEFAULT_REFERENCE))
    return raw.select(F.from_json("value", "reference_type string, data string").alias("r")) \
        .select("r.reference_type", "r.data")


def reference_violations(raw: DataFrame) -> DataFrame:
    """Domain (``reference_type`` in the two known kinds) and uniqueness violations."""
    t = F.col("reference_type")
    bad_domain = raw.filter(~t.isin(*REFERENCE_TYPES) | t.isNull()) \
        .select(t, F.lit("unknown reference_type").alias("violation"))
    dup = raw.groupBy(t).count().filter(F.col("count") > 1) \
        .select(t, F.lit("duplicate reference_type").alias("violation"))
    return bad_domain.unionByName(dup)


def _of_type(raw: DataFrame, kind: str) -> DataFrame:
    return raw.filter(F.col("reference_type") == kind)


def playbooks(raw: DataFrame) -> DataFrame:
    p = _of_type(raw, "playbooks").select(F.explode(F.from_json("data", _PLAYBOOKS)).alias("name", "pb"))
    return p.select("name", "pb.severity", F.col("pb.match").alias("match_json"), "pb.actions")


def _network(raw: DataFrame) -> DataFrame:
    return _of_type(raw, "network_info").select(F.from_json("data", _NETWORK).alias("n"))


def assets(raw: DataFrame) -> DataFrame:
    a = _network(raw).select(F.explode("n.assets").alias("ip", "a"))
    return a.select("ip", "a.name", "a.type", "a.criticality", "a.external_ingress", "a.zone", "a.owner")


def _paren_ip(c):
    v = F.regexp_extract(c, r"\(([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\)", 1)
    return F.when(v != "", v)


def segmentation(raw: DataFrame) -> DataFrame:
    """Rules with parsed source range, destination, ports and exception host.

    ``172.16.x.x`` → 172.16.0.0/16; ``DMZ (10.0.0.10)`` → that host; a protocol
    ``PostgreSQL (5432)`` → 5432, a bare service name through SERVICE_PORTS.
    """
    s = _network(raw).select(F.posexplode("n.segmentation").alias("rule_idx", "r"))
    src = F.col("r.src")
    n_wild = F.size(F.split(src, r"\.x", -1)) - 1
    wild_net = F.concat(F.regexp_replace(src, "x", "0"), F.lit("/"), (F.lit(32) - n_wild * 8).cast("string"))
    src_net = F.coalesce(_paren_ip(src), F.when(n_wild > 0, wild_net), src)
    lo, hi = cidr_bounds(src_net)
    port_map = F.create_map(*[x for k, v in SERVICE_PORTS.items() for x in (F.lit(k), F.lit(v))])
    ports = F.transform(F.col("r.protocols"), lambda p: F.coalesce(
        F.regexp_extract(p, r"\(([0-9]+)\)", 1).try_cast("int"),
        F.element_at(port_map, F.upper(F.trim(p)))))
    return s.select(
        F.col("rule_idx").cast("int").alias("rule_idx"), F.col("r.src").alias("src"),
        F.col("r.dst").alias("dst"), F.col("r.protocols").alias("protocols"),
        F.col("r.allowed").alias("allowed"), F.col("r.exception").alias("exception"),
        lo.alias("src_lo"), hi.alias("src_hi"), F.filter(ports, lambda p: p.isNotNull()).alias("ports"),
        _paren_ip(F.col("r.exception")).alias("exception_ip"))


def approved_endpoints(raw: DataFrame) -> DataFrame:
    lab = _network(raw).select(F.explode("n.approved_destinations").alias("label", "m"))
    e = lab.select("label", F.explode("m").alias("ip", "e"))
    return e.select("label", "ip", "e.approved", "e.purpose", "e.allowed_protocols",
                    "e.allowed_ports", "e.owner")


_CACHE: dict = {}


def load_reference(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """The four dimensions. Loaded once per session and path and cached, so
    joins know their bytes."""
    key = (spark.sparkContext.applicationId, os.path.abspath(path or DEFAULT_REFERENCE))
    if key in _CACHE:
        return _CACHE[key]
    raw = read_reference_raw(spark, path)
    dims = {"playbooks": playbooks(raw), "assets": assets(raw),
            "segmentation": segmentation(raw), "approved": approved_endpoints(raw)}
    for name, df in dims.items():
        df = df.cache()
        df.count()  # from now on its size is known
        dims[name] = df
    _CACHE[key] = dims
    return dims


def reference_documents(path: str | None = None) -> dict[str, str]:
    """The two reference documents as JSON text (J2 attaches them as literals)."""
    out = {}
    with open(path or DEFAULT_REFERENCE) as fh:
        for line in fh:
            if line.strip():
                row = json.loads(line)
                out[row["reference_type"]] = json.dumps(row["data"], sort_keys=True)
    return out
