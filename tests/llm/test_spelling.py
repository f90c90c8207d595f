"""Spelling variants against a plain version."""

import collections
import random
import re
import zlib
from pathlib import Path

import pytest

from lodestar.llm import spelling

DIR = "/root/testdata/sf0.001"


def counts(rows, drop):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if drop and doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % drop == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, min_length=5, min_count=3, drop=None):
    n = {w: k for w, k in counts(rows, drop).items() if len(w) >= min_length and k >= min_count}
    keys = collections.defaultdict(set)
    for w in n:  # words that are one edit apart share a word with a hole, or one is the other with a letter less
        keys[w].add(w)
        for i in range(len(w)):
            keys[w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in keys.values():
        for a in group:
            near[a] |= {b for b in group if b != a and b not in near[a] and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def run(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in spelling.spelling_variants(docs, **settings).collect()}


def some_words(seed, n, letters, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("letters, longest, group", [("ab", 9, 2000), ("abcé", 7, 4), ("abcdefgh", 6, 30), ("a", 12, 2)])
def test_equals_plain(spark, monkeypatch, letters, longest, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 50)
    monkeypatch.setattr(spelling, "BLOCK_PAIRS", 300)
    rng = random.Random(7)
    words = some_words(3, 400, letters, longest)
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    for least in (1, 5):
        assert run(spark, rows, min_length=least, min_count=1) == plain(rows, least, 1)


def test_a_common_beginning_is_divided(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 20)
    rng = random.Random(1)
    words = ["commonbegin" + "".join(rng.choice("abcd") for _ in range(5)) for _ in range(300)] + ["".join(rng.choice("abcd") for _ in range(5)) + "commonending" for _ in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[::2])), (3, " ".join(words[::2] * 3))]
    got = spelling.groups(spark.createDataFrame([(w, 3) for w in set(words)], "word string, n long")).groupBy("key").count().toPandas()
    assert got["count"].max() <= 20
    assert run(spark, rows, min_count=1) == plain(rows, 5, 1)


def test_edges(spark):
    long = "x" * 3000
    rows = [(None, None), (1, ""), (2, "12 34 ..."), (3, "Hello hello HELLO hallo hallo hallo hallo hallo hallo"), (None, "hello hullo"), (3, "Hello hello HELLO"), (4, f"{long} {long}y {long} {long}y " * 3), (5, "×÷Étés ×÷Étés ×÷Étés Ābcdef")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, drop_one_in=3) == plain(rows, drop=3)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    clash = spark.createDataFrame([(1, "trees trees trees", 5, "w")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in spelling.spelling_variants(clash).collect()] == [("trees", None, "trees", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, ratio=1)


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
def test_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.op13_spelling_variants(spark, DIR).collect()} == plain(rows, drop=97)
