"""Secret scan over an incremental blob ledger.

Every version of every path is content-addressed: its blob id is the SHA-256 of
the whole text. An append-only ledger on shared storage holds, per blob, the
rule versions it was scanned with and what they found. A run scans only the
(blob, rule version) pairs the ledger does not hold, appends one row per blob,
and joins the findings back to every row that holds the blob.

A rule's matches are leftmost and non-overlapping. Positions come from the
pieces between the matches: the ledger keeps the lengths of gap and match in
order, and a running sum per blob and rule gives start and end in code points.
All of it is DataFrame functions.

Defined results: a null text is the empty blob and has no findings; repeated
rows each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertspark.session import new_table_path

from .common import exists, whole_text


@dataclass(frozen=True)
class Rule:
    """``value_group`` must have ``min_value`` characters for a match to count;
    a match that fails still uses up its characters."""

    kind: str
    version: int
    pattern: str
    value_group: int = 0
    min_value: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
           r"([A-Za-z0-9+/_.=-]+)")

#: The rules every result is made of, in the order ties are listed.
BASE_RULES = (
    Rule("assign", 1, _ASSIGN, 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
#: Kinds of secret the base rules have no shape for.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

# A key goes with its body: through the END line of the same name, if no other
# BEGIN or END comes before it; else (cut off) through its header fields and the lines, or long
# words, of base64 that follow. Line ends may be written out as \n.
_LINE = r"(?:\r\n?|\n|\\r\\n|\\n)[\x20\t>]*+"
_FIELDS = rf"(?:{_LINE}[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+|\s++(?:Proc-Type|DEK-Info):\s*+\S++|(?:{_LINE})(?=\s|\\))*+"
_BASE64 = rf"(?:{_LINE}[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t]*+(?:[\r\n\\\"']|\z))|[\s\"'\\,]*+[A-Za-z0-9+/]{{16,}}+={{0,2}})"
_PRIVATE_KEY = (r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END \1-----"
                rf"|{_FIELDS}{_BASE64}++)?+")
#: The rules of redaction; the ledger's listing keeps the header alone as private_key.
REDACT_RULES = tuple(Rule("private_key", 2, _PRIVATE_KEY) if r.kind == "private_key" else r for r in RULES)

LEDGER_SCHEMA = ("blob string, scanned array<string>, "
                 "found array<struct<rule:string,ord:int,gap:int,len:int,ok:boolean>>")


def _found(text, rule: Rule, todo):
    """The matches of one rule as gaps and lengths; none where the pair is known."""
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))
    rows = F.transform(F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda x, i: F.struct(
        F.lit(rule.key).alias("rule"), i.alias("ord"), F.length(F.get(gaps, i)).alias("gap"),
        F.length(x["hit"]).alias("len"), (F.length(x["value"]) >= rule.min_value).alias("ok")))
    none = F.array().cast("array<struct<rule:string,ord:int,gap:int,len:int,ok:boolean>>")
    return F.when(F.array_contains(todo, rule.key) & text.rlike(rule.pattern), rows).otherwise(none)


def _tight(rule: Rule) -> Rule:
    """A single class repeated to a least length finds the same spans as the
    open form with the short ones dropped, and leaves no failing matches."""
    if rule.value_group == 0 and rule.pattern == "[0-9a-f]+":
        return Rule(rule.kind, rule.version, f"[0-9a-f]{{{rule.min_value},}}", 0, rule.min_value)
    return rule


def read_ledger(spark, ledger_path: str) -> DataFrame:
    if not exists(spark, ledger_path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)


def scan_new(versions: DataFrame, ledger_path: str, rules=RULES, text_col: str = "text") -> None:
    """Scan the unseen (blob, rule version) pairs and append them to the ledger.

    Safe to run again after a failure: the append is one commit, and a pair
    that two runs both scanned reads as one.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, ledger_path).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("known"))
    text = whole_text(text_col)
    # Copies of a blob fall together before the shuffle.
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    keys = F.array(*[F.lit(r.key) for r in rules])
    todo = blobs.join(known, "blob", "left").select(
        "blob", "text", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))).alias("todo")
    ).where(F.size("todo") > 0)
    found = F.concat(*[_found(F.col("text"), _tight(r), F.col("todo")) for r in rules])
    todo.select("blob", F.col("todo").alias("scanned"), found.alias("found")).write.mode("append").parquet(ledger_path)


def blob_findings(spark, ledger_path: str, rules=RULES) -> DataFrame:
    """(blob, kind, start, end): the findings of the given rule versions."""
    current = [r.key for r in rules]
    rows = read_ledger(spark, ledger_path).where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).select(
        "blob", "f.*").where(F.col("rule").isin(current)).dropDuplicates(["blob", "rule", "ord"])
    so_far = Window.partitionBy("blob", "rule").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far)
    return rows.select("blob", F.substring_index("rule", "@", 1).alias("kind"), (end - F.col("len")).alias("start"),
                       end.alias("end"), "ok").where("ok").drop("ok")


def scan_versions(versions: DataFrame, ledger_path: str | None = None, rules=RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob, findings) for every row: findings is the array of
    (start, rank, kind, end) sorted by start, then by the order of the rules."""
    spark = versions.sparkSession
    ledger_path = ledger_path or new_table_path(spark, "secret-ledger")
    scan_new(versions, ledger_path, rules, text_col)
    rank = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    per_blob = blob_findings(spark, ledger_path, rules).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("findings"))
    paths = versions.select(F.col(id_col), F.sha2(whole_text(text_col), 256).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(per_blob, "blob", "left").select(id_col, "blob", F.coalesce("findings", none).alias("findings"))


def span_list(findings):
    """``kind:start:end`` of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redacted(text, findings, mask: str = "[SECRET]"):
    """``text`` with every found span replaced; overlapping spans become one."""
    merged = F.aggregate(
        findings, F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, f: F.when(
            (F.size(acc) > 0) & (f["start"] <= F.element_at(acc, -1)["e"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1),
                     F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"),
                                      F.greatest(F.element_at(acc, -1)["e"], f["end"]).alias("e"))))
        ).otherwise(F.concat(acc, F.array(F.struct(f["start"].alias("s"), f["end"].alias("e"))))))
    # One lambda variable holds the merged spans, so they are made once.
    return F.element_at(F.transform(F.array(merged), lambda m: F.when(F.size(m) == 0, text).otherwise(F.concat(
        F.array_join(F.transform(m, lambda x, i: F.concat(
            F.substring(text, (F.coalesce(F.get(m, i - 1)["e"], F.lit(0)) + 1).cast("int"),
                        (x["s"] - F.coalesce(F.get(m, i - 1)["e"], F.lit(0))).cast("int")), F.lit(mask))), ""),
        F.substring(text, (F.element_at(m, -1)["e"] + 1).cast("int"), F.length(text))))), 1)


def redact_documents(docs: DataFrame, ledger_path: str | None = None, rules=REDACT_RULES, text_col: str = "text",
                     length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every secret masked; their other columns stay,
    but for the length of a changed text. Null texts stay null."""
    spark = docs.sparkSession
    ledger_path = ledger_path or new_table_path(spark, "secret-ledger")
    scan_new(docs, ledger_path, rules, text_col)
    spans = blob_findings(spark, ledger_path, rules).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_findings")).withColumnRenamed("blob", "_blob")
    d = docs.withColumn("_blob", F.sha2(whole_text(text_col), 256)).join(spans, "_blob", "left")
    clean = F.when(F.col("_findings").isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("_findings")))
    d = d.withColumn("_clean", clean)
    out = {text_col: F.col("_clean")}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out[length_col] = F.when(F.col("_findings").isNull(), F.col(length_col)).otherwise(F.length("_clean").cast(kind))
    return d.select([out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
