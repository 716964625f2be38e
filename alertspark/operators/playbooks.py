"""Playbook rules compiled from the reference document.

A playbook's ``match`` document becomes one column predicate; a playbook that
is added to the document is matched without a change of code. Every key of the
document is one condition, and all must hold:

* a measure (``MEASURES``): a threshold such as ``>20`` or ``>1GB``, by F12;
* ``window``: the alert's window is no longer than this one, by F11;
* ``ports``: some destination port is in the list;
* ``src`` / ``dst``: ``external`` or ``internal`` address class, by F1;
* ``patterns`` / ``input``: phrases, any of which a log's text contains;
* ``destination``: ``unapproved...`` means no approved endpoint (J9);
* a text column (``TEXTS``): one value or a list of values.

An unknown key is an error that names it: a condition is never left out. The
rules are few (one predicate each, so they are read to the driver), the alerts
are never joined with them: a match is a projection.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import threshold_op, threshold_value, window_seconds

#: Measure of a match document -> column of the prepared alerts.
MEASURES = {"failed_logins": "failed_logins", "volume": "total_bytes", "probed_ports": "probed_ports", "event_count": "event_count",
            "denied": "deny_count"}
TEXTS = ("protocol", "severity", "log_source", "rule_name", "direction")
# FIXED VALUES — phrases of the document that stand for more than their own words.
PHRASES = {"sql comment": r"--|/\*", "malicious script payload": "<script"}


def threshold(c: Column, text: str) -> Column:
    """Whether the column passes a threshold text (F12, folded to constants); a text that
    is none never passes."""
    op, bound = threshold_op(F.lit(str(text))), threshold_value(F.lit(str(text)))
    return F.when(op == ">", c > bound).when(op == ">=", c >= bound).when(op == "<", c < bound).when(op == "<=", c <= bound).otherwise(c == bound)


def phrase_regex(phrases: list[str]) -> str:
    """One pattern for the phrases: blanks stand for any white space, and may be left out about ``=``."""
    one = lambda p: PHRASES.get(p.lower()) or r"\s+".join(re.sub("=", r"\\s*=\\s*", re.escape(w)) for w in p.split())
    return "(?i)(" + "|".join(map(one, phrases)) + ")"


def _condition(key: str, value, name: str) -> Column:
    many = value if isinstance(value, list) else [value]
    if key in MEASURES:
        return functools.reduce(lambda a, b: a & b, [threshold(F.col(MEASURES[key]), v) for v in many])
    if key == "window":
        return F.col("window_seconds") <= window_seconds(F.lit(value))
    if key == "ports":
        return F.arrays_overlap(F.coalesce(F.col("destination_ports"), F.array().cast("array<int>")), F.array(*[F.lit(int(p)) for p in many]))
    if key in ("src", "dst"):
        return F.col("source_type" if key == "src" else "destination_type").startswith(str(value).capitalize() + " ")
    if key in ("patterns", "input"):
        pattern = phrase_regex(many)
        return F.exists("log_texts", lambda t: t.rlike(pattern))
    if key == "destination":
        if not str(value).startswith("unapproved"):
            raise ValueError(f"playbook {name}: destination {value!r} is not known")
        return ~F.col("approved_endpoint")
    if key in TEXTS:
        return F.col(key).isin(*many)
    raise ValueError(f"playbook {name}: match key {key!r} is not known")


def compile_rule(name: str, match_json: str | None) -> Column:
    """The predicate of one playbook; null counts as false, an empty document matches nothing."""
    match = json.loads(match_json or "{}")
    if not match:
        return F.lit(False)
    return F.coalesce(functools.reduce(lambda a, b: a & b, [_condition(k, v, name) for k, v in match.items()]), F.lit(False))


def matched_names(playbooks: DataFrame) -> Column:
    """The names of the playbooks that a prepared alert matches, in the document's order."""
    rules = playbooks.select("name", "match_json").collect()
    hits = [F.when(compile_rule(r["name"], r["match_json"]), F.lit(r["name"])) for r in rules]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def with_rule_inputs(alerts: DataFrame) -> DataFrame:
    """``failed_logins``, ``probed_ports`` and ``window_seconds``, from the log measures."""
    ports = F.coalesce(F.col("destination_ports"), F.array().cast("array<int>"))
    return alerts.withColumns({
        "failed_logins": F.when(F.col("failed_log_count") > 0, F.coalesce(F.col("event_count"), F.lit(0))).otherwise(0).cast("int"),
        "probed_ports": F.size(F.array_distinct(F.concat(F.filter(ports, lambda p: p.isNotNull()), F.col("log_ports")))).cast("int"),
        "window_seconds": window_seconds(F.col("time_window"))})
