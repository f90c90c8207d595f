"""Near duplicates on a whole table, with ids of other types, and in crowded regions."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import near_dup, queries

DIR = "/root/testdata/sf0.01"


def _sets(docs, k):
    from test_operators import _shingles

    return {i: _shingles(t, k) for i, t in docs}


def _smallest(docs, k, percent=80):
    """Smallest id that links reach, with all pairs that share a shingle compared."""
    sets = _sets(docs, k)
    having, low = {}, {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    common = {}
    for ids in having.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
def test_query_equals_all_pairs_on_a_larger_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op3_near_dedup"](spark, DIR).collect()}
    assert got == _smallest(docs, 4)


@pytest.mark.parametrize("kind, name", [("string", lambda i: f"{i:03d}"), ("date", None), ("double", float)])
def test_ids_of_other_types(spark, kind, name):
    import datetime

    name = name or (lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i))
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base, base + " more", "quite another text of some words", base, None, "", "x"]
    docs = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)] + [(None, base), (None, "alone here"), (None, "alone here")], f"doc_id {kind}, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, 5).collect()]
    first = name(0)
    want = [(name(i), first if i in (0, 1, 3) else name(i), i not in (1, 3)) for i in range(7)] + [(None, first, False), (None, None, True), (None, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = near_dup.drop_near_duplicates(docs, 5).collect()
    assert sum(r["text"] in (base, base + " more") for r in left) == 1 and sum(r["text"] == "alone here" for r in left) == 1
    assert len(left) == 6 and {r["text"] for r in left} >= {None, "", "x"}


def test_groups_without_ids_leave_one(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] * 5 + [" ".join(base[:100] + [f"x{k}"] + base[100:]) for k in range(4)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    assert near_dup.drop_near_duplicates(docs, 5).count() == 1


def test_blocks_of_a_region_are_dealt_out(spark):
    """A crowded region's blocks are grouped after a shuffle by region, block and asking block."""
    open_ = spark.range(2000).select(F.lit(1).cast("long").alias("region"), F.col("id").alias("node"), F.col("id").alias("component"), (F.col("id") == 0).alias("major"))
    sets = spark.range(2000).select(F.col("id").alias("node"), F.lit(2).cast("long").alias("n"), F.lit(np.arange(2, dtype=np.int64).tobytes()).alias("set"))
    members = near_dup.hot_keys(spark.createDataFrame([(1, 2000)], "region long, n long"), ["region"], 2000)
    found = near_dup._in_full(open_, sets, 80, members)
    plan = found._jdf.queryExecution().executedPlan().toString()
    flat = plan[: plan.index("FlatMapGroups") + 1], plan[plan.index("FlatMapGroups") :]
    assert "hashpartitioning(region" in flat[1] and "block" in flat[1].split("hashpartitioning(region", 1)[1].split(")")[0]
    nodes = {x for r in found.collect() for x in (r["a"], r["b"])}
    assert nodes == set(range(2000))


def test_further_members_are_asked_where_prefixes_are_longer():
    rows = np.array([[0, 1, 0x0001_0002_0003_0004 + k, k] for k in range(3)] + [[0, 1, 0x0001_0002_0007_0000, 9], [0, 1, 0x7FFF_0000_0000_0000, 10], [1, 1, 5, 11]], np.int64)
    assert list(near_dup._shared(rows)) == [0, 7, 7, 6, 4, 0]


def test_regions_of_many_parts_lose_no_link(spark):
    """Three families of near copies that share most shingles, over many partitions, equal all pairs."""
    rng = random.Random(3)
    base = [f"t{rng.randrange(400)}" for _ in range(220)]
    docs = []
    for family in range(3):
        own = base[:]
        for k in rng.sample(range(220), 6):
            own[k] = f"f{family}x{k}"
        for i in range(90):
            w = own[:]
            for k in rng.sample(range(220), rng.choice([1, 2, 4, 6])):
                w[k] = f"r{rng.randrange(10**6)}"
            docs.append((family * 1000 + i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 4).collect()}
    assert got == _smallest(docs, 4)
