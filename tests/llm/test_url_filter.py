"""The blocked Bloom filter by itself: no false negative, few false positives, which the join removes."""

from pyspark.sql import functions as F

from lodestar.llm import url_filter


def test_filter_passes_all_entries_and_few_others(spark):
    listed = spark.range(20000).select(F.concat(F.lit("host"), "id", F.lit("/p")).alias("key"))
    n_blocks = 20000 * url_filter.BITS_PER_ENTRY // 256
    blocks = url_filter.bloom_blocks(listed, n_blocks)
    assert url_filter.maybe_listed(listed, blocks, n_blocks).count() == 20000
    others = spark.range(200_000).select(F.concat(F.lit("other"), "id").alias("key"))
    passed = url_filter.maybe_listed(others, blocks, n_blocks)
    assert 0 < passed.count() < 2000  # one in a hundred at most, and some
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_masks_are_products_modulo_two_to_the_32(spark):
    low = [0, 1, 0xFFFFFFFF, 0x80000001, 123456789]
    rows = spark.createDataFrame([(x,) for x in low], "low long")
    for salt in url_filter.SALTS:
        got = [r[0] for r in rows.select(url_filter._times(F.col("low"), salt)).collect()]
        assert got == [x * salt % (1 << 32) for x in low]


def test_false_positives_are_removed(spark, monkeypatch):
    """With a filter that lets everything through the verdicts are the same."""
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"https://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.com", "example.com", "x.example.net", "org", "b.de") for p in ("/en/7a", "/de/8", "/es/", "/", ""))], "page_id int, url string")
    judged = lambda: sorted(tuple(r) for r in url_filter.filter_urls(pages, listed).collect())
    want = judged()
    monkeypatch.setattr(url_filter, "maybe_listed", lambda keys, blocks, n: keys)
    assert judged() == want
    monkeypatch.undo()
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 0)
    assert judged() == want


def test_one_url_on_most_pages(spark):
    listed = spark.createDataFrame([("example.com", "/" + "a" * n, "block") for n in range(200)], "host string, path string, verdict string")
    pages = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "http://www.example.com/aaa?q").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".org/"))).alias("url"))
    got = {(r[0], r[1]): r[2] for r in url_filter.filter_urls(pages, listed).groupBy("rule", "verdict").count().collect()}
    assert got == {("example.com/aaa", "block"): 2000, (None, "allow"): 1000}


def test_rows_without_a_candidate_are_not_shuffled(spark):
    listed = spark.range(50_000).select(F.concat(F.lit("site"), "id", F.lit(".dev")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(4000).select("id", F.concat(F.lit("https://www.site"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.col("id") + 10**6), F.lit(".dev/a/b")).alias("url"))
    keyed = pages.withColumn("keys", url_filter.url_keys(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), [1]))
    entries = listed.select(F.concat("host", "path").alias("key"))
    n_blocks = 50_000 * url_filter.BITS_PER_ENTRY // 256
    may, others = url_filter.rows_by_filter(keyed, F.col("keys"), url_filter.bloom_blocks(entries, n_blocks), n_blocks)
    assert "Exchange" not in others._jdf.queryExecution().executedPlan().toString()
    assert 80 <= may.count() < 200 and may.count() + others.count() == 4000 and may.filter("id % 50 = 0").count() == 80
    # the numbers tested where rows are read are those of the table of blocks
    exploded = keyed.select("id", F.explode("keys").alias("key"))
    assert {r["id"] for r in url_filter.maybe_listed(exploded, url_filter.bloom_blocks(entries, n_blocks), n_blocks).collect()} == {r["id"] for r in may.collect()}
    got = {(r["verdict"], r["rule"] is None): r["count"] for r in url_filter.filter_urls(pages, listed).groupBy("verdict", "rule").count().groupBy("verdict", F.col("rule").isNull().alias("none")).agg(F.sum("count").alias("count")).withColumn("rule", F.when(~F.col("none"), 1)).collect()}
    assert got == {("block", False): 80, ("allow", True): 3920}
