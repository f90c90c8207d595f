"""Bytes that earlier documents hold too, against a plain version."""

import random

import numpy as np
import pytest

from lodestar.llm import earlier_copies


def plain(rows, length):
    """(id, kept, n_bytes, n_removed, n_spans) of each row."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, float("inf")), order(i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < order(i):
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, kept, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0))
    return sorted(out, key=str)


def run(spark, rows, length=50):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r[0], bytes(r[1]), *r[2:]) for r in earlier_copies.remove_earlier(docs, length).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans").collect()), key=str)


def texts(seed, n, letters, most):
    """Texts that copy pieces of each other."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = ""
        while len(text) < rng.randint(0, most):
            if out and rng.random() < 0.5:
                source = rng.choice(out)
                a = rng.randint(0, len(source))
                text += source[a : a + rng.randint(1, 160)]
            else:
                text += "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))
        out.append(text)
    return out


@pytest.mark.parametrize("letters, length, chunk, common", [("abcdefgh éß\n", 50, 1 << 20, 20_000), ("ab", 50, 900, 20_000), ("abcdefgh 你", 50, 700, 1), ("abc", 37, 500, 2), ("a", 50, 400, 3), ("abcdef", 79, 2000, 2)])
def test_equals_plain(spark, monkeypatch, letters, length, chunk, common):
    monkeypatch.setattr(earlier_copies, "CHUNK", chunk)
    monkeypatch.setattr(earlier_copies, "COMMON", common)
    monkeypatch.setattr(earlier_copies, "SLICE", 300)
    monkeypatch.setattr(earlier_copies, "LEAST_BUCKETS", 3)
    rows = list(enumerate(texts(5, 60, letters, 500)))
    random.Random(2).shuffle(rows)
    assert run(spark, rows, length) == plain(rows, length)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(earlier_copies, "CHUNK", 300)
    t = texts(9, 3, "abcdefghij ", 900)
    same = "one passage that is longer than fifty bytes and stands in several documents of this table"
    rows = [(None, same), (None, same), (7, same), (7, same), (7, "x" + same), (3, same[1:] + t[0]), (2, None), (1, ""), (4, "é" * 24 + "abc"), (9, "é" * 24 + "abc"), (-5, t[1]), (8, t[1] * 3), (6, "z" * 2000), (5, "z" * 3000), (10, "short"), (11, "short")]
    assert run(spark, rows) == plain(rows, 50)
    assert run(spark, [(1, "y" * 5000)]) == [(1, b"y" * 5000, 5000, 0, 0)]
    assert run(spark, []) == []
    clash = spark.createDataFrame([(1, same, 0, "k", 1.5), (2, same, 9, "l", 2.5)], "doc_id long, text string, n_bytes int, kept string, chunk double")
    got = earlier_copies.remove_earlier(clash)
    assert got.columns == ["doc_id", "text", "chunk", "kept", "n_bytes", "n_removed", "n_spans"]
    assert sorted((r.doc_id, r.chunk, len(r.kept), r.n_removed) for r in got.collect()) == [(1, 1.5, len(same), 0), (2, 2.5, 0, len(same))]
    with pytest.raises(ValueError):
        earlier_copies.remove_earlier(clash, length=20)


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(1, 20, "abcdef", 300))], "doc_id long, text string")
    plan = earlier_copies.remove_earlier(docs)
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    placed = [line for line in shown if "Exchange hashpartitioning(__chunk" in line]
    assert len(placed) == 3 and sum("ReusedExchange" not in line for line in placed) == 1


def test_runs_do_not_depend_on_the_order_of_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(earlier_copies, "CHUNK", 400)
    rows = [(i, t * (3 if i % 7 == 0 else 1)) for i, t in enumerate(texts(4, 40, "abcdef ", 500))]
    seen = []
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        c = earlier_copies.Contexts(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), 50, 8)
        seen.append((c.key.tolist(), c.context.tolist(), c.id.tolist()))
    assert seen[0][0] and all(s == seen[0] for s in seen)
