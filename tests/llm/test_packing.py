"""Retrieval packing: scores against a plain BM25, likeness of sequence mates, an even layout."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from lodestar.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_neighbours_against_plain_bm25():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint32) for _ in range(40)]
    idf, mean = rng.random(30), 11.0
    shard = packing.Shard(docs, idf, mean)
    for seed in range(40):
        scores = []
        for d in docs:
            tf = Counter(d.tolist())
            scores.append(sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in set(docs[seed].tolist()) if t in tf))
        got = shard.neighbours(seed).tolist()
        assert sorted(got) == list(range(40))
        assert all(scores[a] > scores[b] - 1e-9 for a, b in zip(got, got[1:]))
    shard.take(5)
    assert 5 not in shard.neighbours(3)


def _topics(n, rng):
    words = {t: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)] for t in range(40)}
    return [(i, " ".join(rng.choice(words[i % 40]) for _ in range(rng.randint(20, 90)))) for i in range(n)]


def _likeness(sequences, docs):
    """Mean share of the words of a document that another one of its sequence holds."""
    words = {i: set(t.split()) for i, t in docs}
    shares = [len(words[a] & words[b]) / len(words[a]) for s in sequences for a in s for b in s if a != b]
    return sum(shares) / max(1, len(shares))


def test_sequence_mates_are_alike(spark):
    """Documents of one sequence share far more than those of a random layout, and nearly what sequences of one topic share."""
    rng = random.Random(7)
    docs = _topics(1200, rng)
    mates = defaultdict(set)
    for r in packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), BPE).select("sequence_id", "doc_id").collect():
        mates[r["sequence_id"]].add(r["doc_id"])
    shuffled = [i for i, _ in docs]
    rng.shuffle(shuffled)
    size = math.ceil(sum(map(len, mates.values())) / len(mates))
    at_random = [shuffled[k : k + size] for k in range(0, len(shuffled), size)]
    found, chance = _likeness(mates.values(), docs), _likeness(at_random, docs)
    assert found > 5 * chance and found > 0.25


def test_long_documents_do_not_weigh_on_the_layout(spark):
    """What is laid out is shorter than a window, whatever the lengths of texts; ranges of equal counts have like bytes."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(rng.choice([5, 50, 500, 20000 if i % 100 == 0 else 5])))) for i in range(1500)]
    tokens = packing.tokenise(spark.createDataFrame(docs, "doc_id long, text string"), BPE, 1024).select("key", "key2", "tie", "n", "whole", "rest").toPandas()
    rest, whole = tokens["rest"].map(len) // 4, tokens["whole"].map(len) // 4
    assert rest.max() < 1024 < tokens["n"].max() and (whole % 1024 == 0).all() and (rest + whole == tokens["n"]).all()
    tokens["r"] = rest
    ordered = tokens.sort_values(["key", "key2", "tie"])["r"].to_numpy()
    parts = [p.sum() for p in np.array_split(ordered, 8)]
    assert max(parts) < 3 * sum(parts) / len(parts)
