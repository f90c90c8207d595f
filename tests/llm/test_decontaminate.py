"""The benchmark's index: compact, exact, with the same result beyond its bound."""

import pickle
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import decontaminate
from lodestar.llm.text import ALNUM, Words


def _plain(docs, items, n):
    import re

    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = {}
    for d, t in docs:
        w, hit, of = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    of |= found
        out[d] = (len(w), len(hit), sorted(of))
    return out


def test_scan_against_plain_version(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "delta9", "ß", "x"])
    items = [(i if i else None, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.choice([0, 2, 3, 4, 5, 9])))) for i in range(30)] + [(7, None), (8, "alpha beta alpha beta alpha beta alpha beta")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 6, 40])))) for i in range(80)] + [(100, None), (101, "x " * 20000), (102, "x " * 20000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = _plain(docs, items, 4)
    for bound in ({}, {"max_windows": 0}, {"max_bytes": 10}):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(d, b, 4, **bound).collect()}
        assert got == want


def test_repeated_and_null_texts_beyond_the_bound(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, "alpha beta gamma" if i % 2 else None) for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha beta")], "item_id long, text string")
    got = decontaminate.scan(docs, bench, max_windows=0).groupBy("n_words", "n_hit").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(3, 2): 150, (0, 0): 150}


def test_index_is_compact():
    """A broadcast of many windows takes the bytes that the bound counts with."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 2000)) for _ in range(100)]
    items = pa.table({"item": [str(i) for i in range(100)], "__text": texts})
    index = decontaminate.Index(items, 10)
    n = sum(len(x[0]) for x in index.windows.values())
    assert n == 100 * 1991 and len(pickle.dumps(index)) < n * decontaminate._WINDOW_BYTES + sum(map(len, texts)) + 10_000
    data = texts[5].encode()
    words_of = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM, lower=True)
    hits = decontaminate.find_hits(words_of, index)
    assert len(hits) == 1991 and all(h[3] == {"5"} for h in hits)


def test_hits_are_verified_word_by_word(monkeypatch):
    """Windows whose hashes are equal but whose words are not are no hits."""
    monkeypatch.setattr(Words, "windows", lambda self, k: (np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :]), np.zeros((self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :]).sum(), np.uint64)))
    index = decontaminate.Index(pa.table({"item": ["1", "2"], "__text": ["a b c", "d e f"]}), 3)
    data = b"x a b c y d e z"
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM, lower=True)
    assert decontaminate.find_hits(words, index) == [(0, 1, 3, {"1"})]


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y z w", "w", 5, [1], 2.0)], "doc_id long, text string, n_words string, n_hit int, items array<int>, spans double")
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.dtypes == docs.dtypes and tuple(out.first()) == (1, "x  gamma y z w", "w", 5, [1], 2.0)
    assert decontaminate.decontaminate(docs.withColumn("text", F.lit(None).cast("string")), bench).first()["text"] is None
