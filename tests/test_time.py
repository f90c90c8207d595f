"""As-of and interval joins, sketches, versions and differences against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import asof, difference, sketches
from lodestar.sources import buckets


@pytest.mark.parametrize("block", [1_000_000, 7, 1])
def test_as_of_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(asof, "BLOCK", block)
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    time = lambda: rng.choice([None] + list(range(-20, 60)))
    left = [(i, key(), time()) for i in range(120)]
    right = [(key(), time(), i, rng.choice([None, "x", "y"])) for i in range(60)]
    got = asof.as_of(spark.createDataFrame(left, "id int, k string, t int").withColumn("v", F.lit(9.5)), spark.createDataFrame(right, "k string, s long, v int, w string"), ["k"], F.col("t"), F.col("s"), ["v", "w"], F.col("v"))
    assert got.columns == ["id", "k", "t", "v", "w"]
    want = set()
    for i, k, t in left:
        before = [(s, v, w) for q, s, v, w in right if None not in (k, t, s) and q == k and s <= t]
        best = max(before, key=lambda r: r[:2]) if before else (None, None, None)
        want.add((i, k, t, *best[1:]))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(left) and set(rows) == want
    empty = spark.createDataFrame([], "k string, s long, v int, w string")
    assert {r["v"] for r in asof.as_of(spark.createDataFrame(left, "id int, k string, t int"), empty, ["k"], F.col("t"), F.col("s"), ["v"]).collect()} == {None}


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)

    def spans(n):
        out = []
        for i in range(n):
            begin = rng.randint(-1000, 1000)
            out.append((i, rng.choice(["a", "a", "b", None]), begin, rng.choice([None, begin, begin - 5, begin + 1, begin + rng.randint(1, 60), begin + rng.randint(1, 3000)])))
        return out

    left, right = spans(80), spans(90)
    p, q = spark.createDataFrame(left, "i int, k string, b long, e long"), spark.createDataFrame(right, "j int, k string, c long, d long")
    found = asof.overlapping(p, q, ["k"], ("b", "e"), ("c", "d"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = [tuple(r) for r in found.collect()]
    want = {(i, k, b, e, j, c, d) for i, k, b, e in left for j, m, c, d in right if k is not None and k == m and e is not None and d is not None and b < e and c < d and b < d and c < e}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_summaries_merge_to_any_span(spark):
    rows = spark.range(20_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 3).alias("kind"), ((F.col("id") * 7919) % 5003).alias("who"), ((F.col("id") * 31) % 1000).alias("x"))
    kept = sketches.summaries(rows, ["day", "kind"], "who", "x")
    for within in (None, F.col("day").between(2, 4)):
        exact = {r["kind"]: r for r in (rows if within is None else rows.filter(within)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.count_distinct("who").alias("d"), F.sort_array(F.collect_list("x")).alias("xs")).collect()}
        for r in sketches.estimates(sketches.merged(kept, ["kind"], within), (0.1, 0.5, 0.9)).collect():
            e = exact[r["kind"]]
            assert (r["n"], r["total"]) == (e["n"], e["total"]) and abs(r["distinct"] - e["d"]) <= sketches.HLL_ERROR * e["d"]
            for rank, q in zip((0.1, 0.5, 0.9), r["quantiles"], strict=True):
                below, upto = sum(x < q for x in e["xs"]) / e["n"], sum(x <= q for x in e["xs"]) / e["n"]
                assert below - sketches.KLL_ERROR <= rank <= upto + sketches.KLL_ERROR
    everything = {(r["day"], r["kind"], r["level"]): r["n"] for r in sketches.totals(rows, ["day", "kind"], "x").collect()}
    assert len(everything) == 30 + 10 + 3 + 1 and everything[None, None, 3] == 20_000
    assert len(sketches.totals(rows, ["day", "kind"], "x", "rollup").collect()) == 30 + 10 + 1
    assert sketches.estimates(sketches.merged(sketches.summaries(rows.limit(0), ["day"], "who", "x"), ["day"])).count() == 0


def test_differences_of_multisets(spark):
    rng = random.Random(5)
    some = lambda n: [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, [1], []])) for _ in range(n)]
    old, new = some(200), some(170)
    frame = lambda rows: spark.createDataFrame(rows, "x int, y string, z array<int>")
    count = lambda rows: collections.Counter(map(str, rows))
    a, b = count(old), count(new)
    change = difference.changes(frame(old), frame(new).select("z", "y", "x"))
    assert {str(tuple(r)[:3]): r["change"] for r in change.collect()} == {k: b[k] - a[k] for k in a | b if a[k] != b[k]}
    assert {str(tuple(r)[:3]): r["n"] for r in difference.common(frame(old), frame(new)).collect()} == dict(a & b)
    assert count(tuple(r) for r in difference.apply(frame(old), change).collect()) == b
    assert difference.changes(frame(old), frame(old)).count() == 0


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_refresh_rewrites_what_it_touches(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"))
    table = buckets.BucketedTable(spark, str(tmp_path), "key", 64)
    table.create(rows)
    before = _files(tmp_path)
    added = lambda stored, batch: stored.unionByName(batch).groupBy("key").agg(F.sum("n").alias("n"))
    batch = spark.createDataFrame([("k7", 1000), ("k7", 1), ("new", 5), (None, 9)], "key string, n long")
    touched = table.refresh(batch, added)
    want = {f"k{i}": i for i in range(5000)} | {"k7": 1008, "new": 5, None: 9}
    assert {r["key"]: r["n"] for r in table.read().collect()} == want and len(touched) <= 3
    after = _files(tmp_path)
    assert {k: after[k] for k in before} == before  # nothing that was there is written again
    assert {k.split("/")[2] for k in set(after) - set(before)} == {f"bucket={b}" for b in touched}
    assert {r["key"]: r["n"] for r in table.read(1).collect()} == {f"k{i}": i for i in range(5000)}
    plan = table.read().join(F.broadcast(batch), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan

    # a job that is lost leaves the version before, and the next one takes its place
    def lost(stored, batch):
        return stored.unionByName(batch).withColumn("n", F.when(F.col("key") == "k9", F.raise_error("lost")).otherwise(F.col("n")).cast("long"))

    again = spark.createDataFrame([("k9", 1), ("k10", 1)], "key string, n long")
    with pytest.raises(Exception, match="lost"):
        table.refresh(again, lost)
    assert table.versions() == [1, 2] and {r["key"]: r["n"] for r in table.read().collect()} == want
    table.refresh(again, added)
    want |= {"k9": 10, "k10": 11}
    assert {r["key"]: r["n"] for r in table.read().collect()} == want
    # a merge may remove keys, and old versions may be forgotten
    table.refresh(spark.createDataFrame([("k9", 0)], "key string, n long"), lambda stored, batch: stored.limit(0))
    del want["k9"]
    assert table.forget(1) > 0 and table.versions() == [4] and {r["key"]: r["n"] for r in table.read().collect()} == want
    assert table.refresh(batch.limit(0), added) == [] and table.versions() == [4]
    with pytest.raises(ValueError, match="no version"):
        table.read(1)
    with pytest.raises(ValueError, match="there already"):
        table.create(rows)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_refreshes_are_merges_of_whole_tables(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(buckets, "SENT_KEYS", sent)
    rng = random.Random(6)
    held = {i: rng.randint(0, 9) for i in range(300)}
    table = buckets.BucketedTable(spark, str(tmp_path), "key", 16)
    table.create(spark.createDataFrame(list(held.items()), "key long, n long"))
    for _ in range(3):
        batch = [(rng.randint(0, 400), rng.randint(1, 9)) for _ in range(30)]
        table.refresh(spark.createDataFrame(batch, "key long, n long"), lambda stored, new: stored.unionByName(new).groupBy("key").agg(F.sum("n").alias("n")))
        for k, n in batch:
            held[k] = held.get(k, 0) + n
        assert {r["key"]: r["n"] for r in table.read().collect()} == held
