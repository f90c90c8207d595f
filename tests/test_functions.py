"""Functions and folds against small cases and plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scoring
from lodestar.functions import text as t
from lodestar.operators import ledger, resolution, taxonomy
from lodestar.operators.aggregate import trade_flow
from lodestar.plans.q_text import _loose
from lodestar.sources import readers, sinks
from lodestar.sources.storage import new_path


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", f(F.col("s")).alias("x"))
    return [r["x"] for r in sorted(df.collect())]


@pytest.mark.parametrize(
    "f, cases",
    [
        (t.tidy_name, {"KAFFEE HAUS GMBH": "Kaffee Haus GmbH", "BRISTOL COFFEE IMPORTERS LTD": "Bristol Coffee Importers Ltd", "SAINT-DENIS SARL": "Saint-Denis SARL", "Plain Name": "Plain Name", None: None}),
        (t.website, {"www.Shop.de/abc": "https://www.shop.de", "facebook.com/x": None, "no host": None, "": None, None: None}),
        (t.email_status, {"Info@Shop.de": "role", "a@gmail.com": "freemail", "einkauf@x.de": "role", "max.mustermann@x.de": "personal", "x1@x.de": "domain", "nothing": None, None: None}),
        (t.registrable, {"www.shop.example.co.uk": "example.co.uk", "a.b.example.com": "example.com", "localhost": "localhost"}),
        (t.phone, {"0049 (30) 1234567": "+49301234567", "1234567": None, "12345678": "12345678", "1" * 15: "1" * 15, "1" * 16: None, None: None}),
        (t.email_from_hex, {"422b2c242d02316c2127": "info@s.ce", "xyz": None, None: None}),
        (lambda c: F.array_join(t.emails(c), ","), {"mail max (at) host (dot) de or noreply@x.org": "max@host.de", "": "", "no": ""}),
        (lambda c: F.array_join(t.phones(c), ","), {"2024-01-31 or +49 30 1234567": "49301234567", "123": ""}),
        (t.html_text, {"<p>a<script>x</script> b&amp;c<!-- d --></p>": "a b&c", "": "", None: None}),
        (lambda c: t.short_title(c, 10), {"coffee; raw": "coffee", "coffee roasted beans": "coffee…", "": ""}),
    ],
)
def test_text_functions(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_chunks_cover_all_words(spark):
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))) for _ in range(20)]
    for text, got in zip(texts, values(spark, lambda c: t.chunks(c, 40), texts), strict=True):
        assert " ".join(got) == text and all(len(c) <= 40 for c in got)


def test_names_and_quotes(spark):
    page = " we at blue harbor trading import coffee from many countries since 1990 "
    rows = spark.createDataFrame([("Blue Harbor Ltd", "import coffee from many countries", page), ("Red Castle Valley", "we sell invented things nobody wrote", page), ("AG", "short", page)], "n string, q string, p string")
    got = rows.select(t.name_on_page(F.col("n"), F.col("p")), t.quote_on_page(F.col("q"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.product_fit(F.array(F.lit("090111")), F.array(F.lit("090112"))), scoring.product_fit(F.array(F.lit("090111")), F.array().cast("array<string>")),
        scoring.product_fit(F.lit(None).cast("array<string>"), F.array(F.lit("090112"))), scoring.final_score(F.lit(50), F.lit(None).cast("int"), F.lit(75), F.lit(100), F.lit(0)),
        scoring.label(F.lit(60), "list"), scoring.label(F.lit(70), "search"),
    ).first()
    assert tuple(row) == (75, 50, 50, 59, "Warm", "HOT")


def test_merge_confidence_and_order(spark):
    rows = spark.createDataFrame([("h", "a", 1, 60, None, ["1"]), ("h", "b", 2, 70, "x@y", ["2", "1"]), ("h", "c", 3, 55, "z@y", ["3"])], "hash string, source string, seq int, confidence int, email string, codes array<string>")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("name", "phone", "website")})
    r = resolution.merge_cross_source(rows).first()
    assert (r["confidence"], r["email"], r["codes"], r["sources"]) == (80, "x@y", ["1", "2", "3"], ["a", "b", "c"])


def test_consume_turns_down_what_cannot_be_paid(spark):
    ts = lambda k: dt.datetime(2024, 1, 1, 0, k)
    rows = spark.createDataFrame([(1, ts(0), 1, "search", 3, 0), (1, ts(1), 2, "search", 2, 0), (1, ts(2), 3, None, 0, 200), (1, ts(3), 4, "search", 2, 0), (1, ts(4), 5, "search", 1, 0)], "account long, ts timestamp, event_id long, meter string, n long, amount long")
    got = {r["event_id"]: (r["accepted"], r["from_quota"], r["cost"], r["balance"]) for r in ledger.consume(rows, {"search": 3}).collect()}
    assert got == {1: (True, 3, 0, 0), 2: (False, 0, 0, 0), 3: (True, 0, 0, 200), 4: (True, 0, 200, 0), 5: (False, 0, 0, 0)}


def test_stream_quota_equals_batch(spark):
    from lodestar.plans import registry

    d = "/root/testdata/sf0.001"
    batch = registry.QUERIES["quota_consume"](spark, d).select("event_id", "accepted", "balance").collect()
    stream = registry.QUERIES["stream_quota"](spark, d).select("event_id", "accepted", "balance").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))


def test_streams_of_many_files_out_of_order(spark, tmp_path):
    """More than 64 files, the latest events written first: no notice is lost, and quotas are taken in the order of ts."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from lodestar.plans import registry
    from lodestar.streaming import jobs

    events = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by([("ts", "ascending")])
    events = events.set_column(events.schema.get_field_index("user_id"), "user_id", pa.array([k % 5 for k in range(len(events))], pa.int64()))
    (tmp_path / "events.parquet").mkdir()
    for k in range(70):
        pq.write_table(events.slice(k * len(events) // 70, (k + 1) * len(events) // 70 - k * len(events) // 70), f := tmp_path / "events.parquet" / f"part-{k:02}.parquet")
        os.utime(f, (1_700_000_000 - 60 * k,) * 2)
    notices = [r["event_key"] for r in registry.QUERIES["stream_dedup"](spark, str(tmp_path)).collect()]
    assert len(notices) == len(set(notices)) == len(events)
    batch, stream = ([tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select("event_id", "accepted", "balance").collect()] for name in ("quota_consume", "stream_quota"))
    assert sorted(batch) == sorted(stream)
    # notices also come whole in several batches
    few = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events.parquet").schema).option("maxFilesPerTrigger", 30).parquet(f"{tmp_path}/events.parquet")
    twice = jobs.first_notices(few.withColumn("event_key", F.col("event_id")).unionByName(few.withColumn("event_key", F.col("event_id"))))
    assert sorted(r["event_key"] for r in jobs.run_available(twice.select("event_key"), "append").collect()) == sorted(events["event_id"].to_pylist())


@pytest.mark.parametrize("parts, named", [(["a", "b"], "part 'b'"), ([], "the service")])
def test_paged_source_with_more_than_it_shows(parts, named):
    from lodestar.sources import readers

    sizes = {None: 150, "a": 40, "b": 110}
    source = readers.paged_source("few", "k long", sizes.get, lambda part, page, per_page: [], 25, 100, parts)
    with pytest.raises(ValueError, match=named):
        source({}).reader(None).partitions()


def test_plan_expiry(spark):
    day = 86400
    rows = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 10 * day, 2), (1, "b", 20 * day, 3), (2, "a", 0, 4), (2, "a", 40 * day, 5)], "account long, plan string, ts long, event_id long")
    got = {r["account"]: (r["plan"], r["until"]) for r in ledger.plan_expiry(rows).collect()}
    assert got == {1: ("b", 50 * day), 2: ("a", 70 * day)}


def test_trade_flow_without_world(spark):
    rows = spark.createDataFrame([("DE", 0, 5, 9, 1), ("DE", 3, 5, 9, None), ("FR", None, None, None, None)], "partner string, fob long, cif long, other long, weight long")
    assert sorted(map(tuple, trade_flow(rows, "ALL").collect())) == [("DE", 8, 1, 8), ("FR", 0, 0, 8)]


def test_ranked_search(spark):
    nodes = spark.createDataFrame([("0901", 4, " coffee ", " drinks ", " coffee "), ("0902", 4, " tea ", " drinks ", " tea "), ("210111", 6, " coffee extracts ", " food ", " extracts ")], "code string, level int, own string, context string, head string")
    assert [r["code"] for r in taxonomy.ranked(nodes, "the coffee").collect()] == ["0901", "210111"]
    assert taxonomy.ranked(nodes, "the of").count() == 0
    assert taxonomy.expand("green tea", {"tea": ["camellia leaf"]}) == ["camellia", "leaf"]


def test_loose_json():
    assert _loose('<think>{"a": 1}</think> x ```json\n{"b": [1]}\n```') == '{"b": [1]}'
    assert _loose("no") is None and _loose(None) is None and _loose("{bad {}") == "{}"


def test_empty_export_and_counters(spark):
    path = new_path(spark, "test")
    rows = spark.createDataFrame([], "id long, name string")
    sinks.write_csv_export(rows, path, "n", ("id",), 5)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["# n", "id,name"]
    spark.dataSource.register(readers.paged_source("none", "a int", lambda p: 0, lambda *a: [], 10, 10))
    assert spark.read.format("none").load().count() == 0


def test_capitals_are_those_of_sql(spark):
    import duckdb

    letters = [chr(i) for i in range(32, 0x2C00) if chr(i) not in "ƛɤ\u1c89\u1c8a"]  # capitals of these are newer than Java 17
    said = [(x,) for x in ["Ungßkeit Ltd", "ŉ ﬁn", "", None, "abc"] + ["".join(letters[k : k + 500]) for k in range(0, len(letters), 500)]]
    got = [r[0] for r in spark.createDataFrame(said, "s string").select(t.capitals(F.col("s"))).collect()]
    want = [duckdb.execute("SELECT upper(?::VARCHAR)", [x]).fetchone()[0] for (x,) in said]
    far = [(a, b) for g, w in zip(got, want, strict=True) if g != w for a, b in zip(g, w) if a != b]
    assert got[:5] == want[:5] and not far


def test_addresses_open_a_text_once_and_equal_the_plain_patterns(spark):
    rng = random.Random(1)
    parts = ["a", "b", "@", ".", "-", " ", "at", "dot", "(at)", "[ at ]", "(dot)", ".com", "x", "\n", "&#64;", "[@]", "{at}", "A", "%", "co", "  ", " at ", " dot "]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(3, 25))),) for _ in range(5000)] + [(None,), ("",), ("a@b.com-x@y.de (at) z",)]
    s = F.col("s")
    found = spark.createDataFrame(rows, "s string").select("s", t.emails(s).alias("e"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(s") == 1
    opened = F.regexp_replace(F.regexp_replace(F.lower(s), t.AT_SIGN, "@"), t.DOT_SIGN, ".")
    spoken = F.filter(F.transform(F.regexp_extract_all(opened, F.lit(t.SPOKEN), 0), lambda e: F.regexp_replace(F.regexp_replace(e, r"\s+at\s+", "@"), r"\s+dot\s+", ".")), lambda e: e.rlike(f"^{t.EMAIL}$") & (F.length(F.substring_index(e, "@", 1)) <= 40))
    plain = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(opened, F.lit(f"({t.EMAIL})"), 1), spoken)))
    far = found.withColumn("p", F.filter(plain, lambda e: ~F.substring_index(e, "@", 1).isin(t.BLOCKED_LOCALS))).filter(~F.col("e").eqNullSafe(F.col("p")))
    assert far.limit(3).collect() == []
