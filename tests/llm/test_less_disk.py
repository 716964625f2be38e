"""What op3 and the pipeline's first stages leave and move on disk, with the results they keep."""

import os
import random

import numpy as np

from alertspark.llm import partenum, risk_rules, suffix_dedup
from alertspark.session import shared_dir
from test_operators import removed


def tables(spark):
    d = shared_dir(spark).removeprefix("file://")
    return {f"{d}/{x}" for x in os.listdir(d) if os.path.isdir(f"{d}/{x}/")}


def repeats(n):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(110) for _ in range(3)]
    return [text(rnd.randint(5, 40)) + passages[i % 3][i % 5:] + text(20) + passages[(i + 1) % 3][:450 + i] for i in range(n)] + [None, "", "ab" * 700]


def test_tables_of_the_suffix_sort_go(spark):
    docs = spark.createDataFrame(list(enumerate(repeats(6))), "doc_id long, text string")
    before = tables(spark)
    out = suffix_dedup.repeated_strings(docs)
    # The result is read from one table; the others are not waited for.
    assert {os.path.basename(x).rsplit("-", 1)[0] for x in tables(spark) - before} == {"suffix-gone"}
    assert out.count() == 9


def test_neighbours_meet_across_runs_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 2)
    texts = repeats(8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.repeated_strings(docs).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_blocks_of_signatures_are_packed():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(0, 1 << 48, (500, 2))
    blocks = dict(partenum._blocks(rows, 7))
    assert sum(map(len, blocks.values())) == 500 * 12
    back = np.concatenate([partenum._unpacked(x) for x in blocks.values()])
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, rows.tolist()))


def test_quality_rules_write_no_copy_of_the_texts(spark, edge_docs):
    for labels in ([(1, 1, 0)], []):
        labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        before = tables(spark)
        kept = risk_rules.keep_documents(edge_docs, labels).collect()
        for path in tables(spark) - before:
            assert not any(t == "string" and c != "stratum" for c, t in spark.read.parquet(path).dtypes), path
        base = {str(r.doc_id) for r in risk_rules.apply_rules(edge_docs, labels).where("kept").collect()}
        assert {str(r.doc_id) for r in kept} == base
