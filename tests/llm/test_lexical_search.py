"""Ranked search against plain scoring of all documents."""

import collections
import math
import random
import re

import pytest

from lodestar.llm import lexical_search


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical_search.search(d, q, k).collect()), key=str)


def some(seed, n, most, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(words)] + ["commonword" + "x" * 30, "commonword" + "y" * 30]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights)[0] + rng.choice([" ", ", ", "-", "_", " É "]) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("postings, read, size", [(1 << 20, 8, 4 << 20), (300, 1, 4 << 20), (40, 2, 200)])
def test_equals_plain(spark, monkeypatch, postings, read, size):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "FIRST_READ", read)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", size)
    docs, items = list(enumerate(some(1, 500, 60))), list(enumerate(some(2, 25, 15)))
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # many equal scores
    assert run(spark, docs, items, 7) == plain(docs, items, 7)


def test_reading_ends_early():
    """Few documents are scored where few have high impacts."""
    import numpy as np

    n, rng = 20_000, np.random.default_rng(3)
    tfs = np.minimum(rng.zipf(1.6, (n, 2)), 10_000).ravel()
    block = lexical_search.Block(np.arange(n), np.full(n, 50), np.full(n, 2), np.tile([0, 1], n), tfs, n, 50 * n, 2)
    query, best = lexical_search.Query(np.array([0, 1]), np.array([1, 2]), np.array([500, 700])), lexical_search.Best(10)
    scored = block.search(query, best)
    every = block.scores(np.arange(n), query)
    want = np.lexsort((np.arange(n), -every))[:10]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == every[want].tolist()
    assert 10 <= scored < n // 10
    assert block.search(query, best) <= scored  # what is known ends it earlier


def test_edges(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (2, "ALPHA beta gamma " * 2000), (1, None), (3, ""), (4, "?! ..."), (6, "é" * 5000 + " alpha"), (7, "other")]
    items = [(1, "Alpha alpha beta"), (1, "Alpha alpha beta"), (1, "gamma"), (2, None), (3, "..."), (4, "nowhere"), (5, "é" * 5000), (None, "other")]
    assert run(spark, docs, items) == plain(docs, [x for x in items if x[1]], 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    wide = spark.createDataFrame([(1, "alpha", 3, "x")], "doc_id long, text string, score int, query string")
    found = lexical_search.search(wide.union(spark.createDataFrame([(2, "beta", 3, "x")], wide.schema)), wide.select(wide.doc_id.alias("item_id"), "text", "score"))
    assert [(r.item_id, r["rank"], r.doc_id) for r in found.collect()] == [(1, 1, 1)]
