"""The pipeline, stage by stage, against brute force on small tables."""

import re
from collections import defaultdict

import corpus_pipeline
from alertspark.llm import partenum, risk_rules, secrets, sp_scan
from alertspark.llm.queries import tokenizer_path
from test_operators import counts_of, groups_of, spans_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # Few labels here: the base rule alone decides.
    kept = {r.doc_id for r in out["quality_rules"]}
    assert kept == {d for d, r in rows.items() if not counts_of(r.text or "")[-1]}
    group = {}
    for x in groups_of([(d, rows[d].text) for d in sorted(kept)]):
        d, _, c = map(int, re.findall(r"\d+", x))
        group[d] = c
    single = {r.doc_id for r in out["near_duplicates"]}
    assert single == set(group.values())
    items = [re.sub(r"[\W_]+", " ", r.text.lower()).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in out["decontamination"]}
    leaky = {d for d in single if any(i in re.sub(r"[\W_]+", " ", rows[d].text.lower()) for i in items)}
    assert clean == single - leaky and leaky
    masked = {r.doc_id: r for r in out["secret_scan"]}
    assert masked.keys() == clean
    for d, r in masked.items():
        spans = spans_of(rows[d].text)
        assert (r.text != rows[d].text) == bool(spans) and not spans_of(r.text) and r.n_chars == len(r.text)
    parts = defaultdict(dict)
    for r in sp_scan.decode(docs, tokenizer_path()).collect():
        parts[r.doc_id][r.chunk] = r.text
    assert {d: "".join(p[k] for k in sorted(p)) for d, p in parts.items()} == {d: r.text for d, r in masked.items()}


def test_stages_take_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        kept = risk_rules.keep_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        one = partenum.one_of_each(kept)
        assert one.columns == docs.columns
        for name, stage in corpus_pipeline.STAGES[2:]:
            one = stage(spark, one, SF)
        one.count()
    rows = [(r.doc_id, r.text) for r in partenum.one_of_each(edge_docs).collect()]
    assert sorted(d for d, _ in rows if d is not None) == [1, 3, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15, 16]
    assert sum(d is None for d, _ in rows) == 2  # rows without an id stay


def test_redaction_of_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "token=0123456789abcdef0123 tail"), (2, None)], "doc_id int, text string")
    assert [r.text for r in secrets.redact_documents(docs).orderBy("doc_id").collect()] == ["[SECRET] tail", None]
