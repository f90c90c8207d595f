"""Queries that no SQL expresses against plain versions; limits that decide; columns of the pipeline's stages."""

import collections
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.llm import quality_rules, queries, sharding, substring_dedup

DIR = "/root/testdata/sf0.001"
have_tables = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")


def _prose(n, rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_repeats_decide_beyond_the_base_rule(spark):
    """Planted repeats that the three-word rule lets pass are rejected by the suffix array's limits; small ones are not."""
    rng = random.Random(3)
    passage, many = _prose(60, rng), [_prose(9, rng) for _ in range(20)]
    texts = {
        "clean": _prose(400, rng),
        "a line twice": f"{(line := _prose(9, rng))}\n{_prose(120, rng)}\n{line}",
        "a paragraph twice": f"{passage} {_prose(150, rng)} {passage} {_prose(150, rng)}",
        "a paragraph twice in a long text": f"{passage} {_prose(900, rng)} {passage}",
        "many lines twice": " ".join(m + " " + _prose(13, rng) for m in many * 2),
    }
    docs = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r["name"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(docs).collect()}
    assert not any(base for base, _ in got.values())
    assert {k for k, (_, kept) in got.items() if kept} == {"clean", "a line twice", "a paragraph twice in a long text"}


@have_tables
def test_quality_query_against_plain_counts(spark):
    from test_operators import _repeat_stats

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_rules"](spark, DIR).collect()}
    assert set(got) == set(texts)
    rules = quality_rules.RepetitionRules()
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 400:
            continue
        repeat, covered, longest, _ = _repeat_stats(words)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), repeat)
        base = len(words) < 50 or 100 * repeat > 50 * len(words)
        assert r["base_failed"] == base
        assert r["kept"] == (not base and covered <= rules.max_covered * len(words) and not (longest > rules.max_longest and longest > rules.max_longest_part * len(words)))


@have_tables
def test_sharding_query(spark):
    """All documents once, sizes and sums of their texts, slots without gaps, shards of equal counts, under any settings."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    run = lambda: {r["doc_id"]: tuple(r) for r in queries.QUERIES["op2_sharding"](spark, DIR).collect()}
    got = run()
    assert set(got) == set(texts)
    for i, (_, size, crc, law, shard, _slot, grown) in got.items():
        raw = (texts[i] or "").encode()
        assert (size, crc, law, grown) == (len(raw) + 8, zlib.crc32(raw), "rows", None) and 0 <= shard < 24
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert run() == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_without_ids_and_repeated_rows_are_sharded_whole(spark):
    rows = [(i if i % 2 else None, f"text {i}") for i in range(1500)] + [(None, "same")] * 1200 + [(7, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    place = lambda d: sorted((tuple(r) for r in sharding.shuffle_shards(d, 5).collect()), key=str)
    got = place(docs.repartition(5))
    assert got == place(docs.repartition(2)) and len(got) == len(rows)
    for shard in range(5):
        assert sorted(r[3] for r in got if r[2] == shard) == list(range(600))


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    back = sharding.write_shards(docs, str(tmp_path / "shards"), 3, rows_per_file=50).withColumn("file", F.input_file_name()).collect()
    assert {r["doc_id"] for r in back} == set(range(500))
    by_file = collections.defaultdict(list)
    for r in back:
        by_file[r["file"]].append(r["slot"])
    assert all(s == sorted(s) for s in by_file.values())


def test_repeats_with_ids_of_other_types(spark):
    passage = "This passage of many plain words stands in several texts. It goes on for a second long sentence here."
    docs = spark.createDataFrame([("b", f"Second one. {passage}"), ("a", f"First one. {passage}"), (None, f"Third one. {passage}"), (None, f"Third one. {passage}")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "-", r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [("-", 2), ("-", 2), ("a", 0), ("b", 2)]


@have_tables
def test_stages_keep_columns_of_any_name(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    names = ["kept", "n_words", "n_removed", "n_sentences", "n_hit", "items", "spans", "base_failed", "__row", "__text", "__key", "component_id"]
    docs = spark.createDataFrame([(i, _prose(80, rng)) for i in range(6)], "doc_id long, text string")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).withColumn("n_chars", F.lit("mine"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.dtypes == docs.dtypes, name
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) == set(range(6)), name
        assert all(r[n] == f"{n}{i}" for i, r in rows.items() for n in names) and all(r["n_chars"] == "mine" for r in rows.values()), name


def test_short_texts_are_kept_by_the_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "a short text of seven words here"), (2, "again " * 30), (3, None), (4, "two words"), (5, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.quality_rules(spark, docs, DIR).collect()} == {1}
