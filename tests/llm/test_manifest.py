"""op11 against a tree built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from alertspark.llm import merkle

SF = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(nodes, at, swap=None):
    """(root, siblings) of the node ``at``, ``swap`` in its place."""
    nodes, siblings = list(nodes), []
    if swap is not None:
        nodes[at] = swap
    while len(nodes) > 1:
        run = nodes[at // 16 * 16:at // 16 * 16 + 16]
        siblings += run[:at % 16] + run[at % 16 + 1:]
        nodes = [sha(nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], siblings


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        x = [r["doc_id"], r["source"], r["lang"], r["n_chars"]]
        leaf, changed = sha(map(field, [*x, r["text"]])), sha(map(field, [*x, lower(r["text"])]))
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, changed if tampered else leaf, r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in groups[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [x[2] for x in groups[s]]
        for i, x in enumerate(groups[s]):
            root, above = climb(subroots, k)
            _, below = climb(leaves, i)
            got = climb(subroots, k, climb(leaves, i, x[3])[0])[0]
            out.append((x[4], x[2], subroots[k], root, sha(below + above), got, got == root))
    return sorted(out, key=str)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in merkle.manifest(df).collect()), key=str)


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest_matches_a_plain_tree(spark, edge_docs, no_docs, monkeypatch, levels):
    # One level to a block: every tree needs rounds.
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    one_source = corpus.unionByName(corpus.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "n_chars")).selectExpr(
        "doc_id", "text", "lang", "if(doc_id % 3 = 0, 'hot', source) AS source", "n_chars")
    for docs in (edge_docs, one_source):
        assert got(docs) == brute([r.asDict() for r in docs.collect()])
    assert merkle.manifest(no_docs).count() == 0


def test_every_tampered_text_with_capitals_is_found(spark):
    docs = spark.createDataFrame([(i, "Text" if i % 2 else "text", "en", "s", 4) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.manifest(docs).collect():
        touched = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2 == 1
        assert r.verified == (not touched)
        assert r.n_copied == 3


def test_many_sources_of_one_leaf(spark):
    docs = spark.createDataFrame([(i, "A", None, f"s{i:04d}", 1) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(docs) == brute([r.asDict() for r in docs.collect()])


def test_ways_pack_and_unpack():
    levels = merkle.levels_of([sha([str(i)]) for i in range(300)], 300)
    for i in (0, 15, 16, 299):
        way = merkle.way_up(levels, i)
        assert merkle.unpack(merkle.pack(way)) == way
        assert merkle.folded(levels[0][i], way) == levels[-1][0]
