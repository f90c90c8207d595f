"""Sources, sinks and streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import RATES
from ..sources import readers, sinks
from ..sources.storage import new_path
from ..streaming import jobs, timed
from .q_ledger import CONSUME_SQL
from .registry import query
from .views import Views, sql


@query("csv_export", sql("SELECT line FROM (SELECT '# confidential' line UNION ALL SELECT 'id,name,email,balance' UNION ALL (SELECT id || ',\"' || name || '\",' || coalesce('\"' || email || '\"', 'null') || ',' || balance FROM v_entity ORDER BY id LIMIT 500))"))
def csv_export(v: Views) -> DataFrame:
    """An export with its notice, as the lines of the file."""
    path = new_path(v.spark, "export")
    sinks.write_csv_export(v.entity.select("id", "name", "email", "balance"), path, "confidential", ("id",), 500)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("jsonl_roundtrip", sql("SELECT id, name, email, confidence FROM v_entity"))
def jsonl_roundtrip(v: Views) -> DataFrame:
    path = new_path(v.spark, "jsonl")
    sinks.write_jsonl(v.entity.select("id", "name", "email", "confidence"), path)
    return v.spark.read.schema("id long, name string, email string, confidence long").json(path)


@query("csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS \"CompanyNumber\", c_name AS \"CompanyName\", c_mktsegment AS \"Sector\" FROM customer")
def csv_scan(v: Views) -> DataFrame:
    """A register whose header has blanks before its names."""
    path = new_path(v.spark, "csv")
    v.table("customer").select(F.col("c_name").alias("CompanyName"), F.col("c_custkey").alias(" CompanyNumber"), F.col("c_mktsegment").alias(" Sector")).write.csv(path, header=True, quoteAll=True)
    return readers.csv_table(v.spark, path).select("CompanyNumber", "CompanyName", "Sector")


@query("flex_headers", "SELECT c_name AS name, CAST(c_custkey AS VARCHAR) number FROM customer")
def flex_headers(v: Views) -> DataFrame:
    """Columns found by what their headers contain."""
    rows = v.table("customer").select(F.col("c_custkey").cast("string").alias("Company No."), F.col("c_name").alias("Trading Name (full)"), F.col("c_mktsegment").alias("Other name"))
    return readers.canonical_headers(rows, {"name": ["name"], "number": ["no.", "number"]})


@query("xml_scan", "SELECT s_suppkey number, s_name name FROM supplier")
def xml_scan(v: Views) -> DataFrame:
    path = new_path(v.spark, "xml")
    v.table("supplier").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("name")).write.format("xml").option("rowTag", "ABR").option("rootTag", "records").save(path)
    return readers.xml_records(v.spark, path, "ABR", "number long, name string")


@query("taxonomy_json", sql("SELECT code, description FROM (SELECT code6 code, min(description) description FROM v_taxonomy GROUP BY 1)"))
def taxonomy_json(v: Views) -> DataFrame:
    """Codes kept as an array in one JSON document for each chapter, back as rows."""
    path = new_path(v.spark, "tree")
    codes = v.taxonomy.groupBy("chapter", F.col("code6").alias("code")).agg(F.min("description").alias("description"))
    codes.groupBy("chapter").agg(F.collect_list(F.struct("code", "description")).alias("nodes")).select("nodes").write.json(path)
    return readers.json_nodes(v.spark, path, "code: string, description: string", by_line=True).distinct()


@query("config_json", "SELECT product, keyword FROM (VALUES ('coffee', 'bean'), ('coffee', 'roast'), ('spice', 'pepper')) t(product, keyword)")
def config_json(v: Views) -> DataFrame:
    """Settings with nested lists: the keywords of products of priority 1 or 2."""
    path = new_path(v.spark, "config")
    text = '{"products": [{"id": "coffee", "priority": 1, "keywords": ["bean", "roast"]}, {"id": "spice", "priority": 2, "keywords": ["pepper"]}, {"id": "tea", "priority": 3, "keywords": ["leaf"]}]}'
    v.spark.createDataFrame([(text,)], "value string").write.text(path)
    rows = readers.json_nodes(v.spark, path, "id: string, priority: int, keywords: array<string>", "products")
    return rows.filter("priority <= 2").select(F.col("id").alias("product"), F.explode("keywords").alias("keyword"))


def _page(part: str | None, number: int, per_page: int) -> list[tuple]:
    size = 60 if part is None else int(part)
    return [(part or "all", k, f"Company {k}") for k in range(number * per_page, min(size, (number + 1) * per_page))]


@query("paged_scan", "SELECT 'all' part, i number, 'Company ' || i AS name FROM range(60) t(i)")
def paged_scan(v: Views) -> DataFrame:
    """A service with 60 records in pages of 25."""
    v.spark.dataSource.register(readers.paged_source("register_pages", "part string, number long, name string", lambda part: 60, _page, 25, 10_000))
    return v.spark.read.format("register_pages").load()


@query("partition_split_scan", "SELECT p AS part, i number, 'Company ' || i AS name FROM (VALUES ('30'), ('41'), ('52')) t(p), range(60) r(i) WHERE i < CAST(p AS INTEGER)")
def partition_split_scan(v: Views) -> DataFrame:
    """A service that shows 100 records at most, asked part by part as it has more."""
    v.spark.dataSource.register(readers.paged_source("register_parts", "part string, number long, name string", lambda part: 123 if part is None else int(part), _page, 25, 100, ["30", "41", "52"]))
    return v.spark.read.format("register_parts").load()


def _offset_fetch(endpoint: str, attempt: int, part: str, offset: int, limit: int, ordered: bool) -> list[tuple]:
    """A service with two endpoints, one of which is down, that takes no order for one part and fails now and then."""
    if endpoint == "down" or (offset % 40 == 20 and attempt < 2):
        raise OSError("no answer")
    if part == "b" and ordered:
        raise readers.BadRequest("no order here")
    return [(part, k, f"Firm {k}") for k in range(offset, min(offset + limit, 73 if part == "a" else 40))]


@query("offset_scan", "SELECT p AS part, i number, 'Firm ' || i AS name FROM (VALUES ('a', 73), ('b', 40)) t(p, n), range(73) r(i) WHERE i < n")
def offset_scan(v: Views) -> DataFrame:
    """A service read by offset until it ends, with failures, refusals of the order and a second endpoint."""
    v.spark.dataSource.register(readers.offset_source("city_register", "part string, number long, name string", _offset_fetch, 20, ["a", "b"], ["down", "up"], wait=0.0))
    return v.spark.read.format("city_register").load()


def _linked_fetch(endpoint: str, attempt: int, part: str, page: int) -> dict:
    if attempt == 0 and page == 1:
        raise OSError("no answer")
    n = 23 if part == "x" else 0
    items = [{"id": k, "address": {"city": f"City {k % 4}"} if k % 5 else None} for k in range(page * 10, min(n, page * 10 + 10))]
    return {"page": {"totalPages": -(-n // 10)}} | ({"_embedded": {"items": items}} if items else {})


@query("linked_scan", "SELECT i id, CASE WHEN i % 5 <> 0 THEN 'City ' || (i % 4) END city FROM range(23) t(i)")
def linked_scan(v: Views) -> DataFrame:
    """A service whose answers hold records and page counts under paths."""
    v.spark.dataSource.register(readers.linked_source("linked_register", "id long, city string", _linked_fetch, ["x", "empty"], fields=("id", "address.city"), wait=0.0))
    return v.spark.read.format("linked_register").load()


def _packed(rows: DataFrame, pack) -> DataFrame:
    """One archive for each task, of the rows that it has."""

    def work(batches):
        frames = list(batches)
        if frames:
            yield pd.DataFrame({"content": [pack(pd.concat(frames))]})

    return rows.mapInPandas(work, "content binary")


def _csv_archive(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.txt", "not a table")
        for k in range(2):
            z.writestr(f"part{k}.csv", rows.iloc[k::2].to_csv(index=False, header=["CompanyName", " CompanyNumber", " Sector"]))
    return out.getvalue()


@query("csv_zip_scan", "SELECT CAST(c_custkey AS VARCHAR) AS \"CompanyNumber\", c_name || ', \"x\"' AS \"CompanyName\", c_mktsegment AS \"Sector\" FROM customer")
def csv_zip_scan(v: Views) -> DataFrame:
    """A register as CSV files in archives."""
    rows = v.table("customer").select(F.concat("c_name", F.lit(', "x"')).alias("n"), F.col("c_custkey").cast("string").alias("k"), "c_mktsegment")
    return readers.zip_csv(_packed(rows, _csv_archive)).select("CompanyNumber", "CompanyName", "Sector")


def _xml_archive(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        items = "".join(f'<ABR><ABN status="{s}">{k}</ABN><Main><Name>{n}</Name></Main></ABR>' for k, n, s in rows.itertuples(index=False))
        z.writestr("all.xml", f"<Transfer><Info>x</Info>{items}</Transfer>")
    return out.getvalue()


@query("xml_zip_scan", "SELECT s_suppkey number, s_name name, CASE WHEN s_suppkey % 2 = 0 THEN 'ACT' ELSE 'CAN' END status FROM supplier")
def xml_zip_scan(v: Views) -> DataFrame:
    """A register as XML files in archives, with attributes and nested elements."""
    rows = v.table("supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, "ACT").otherwise("CAN").alias("s"))
    found = readers.zip_xml(_packed(rows, _xml_archive), "ABR", "ABN struct<_VALUE: long, _status: string>, Main struct<Name: string>")
    return found.select(F.col("ABN._VALUE").alias("number"), F.col("Main.Name").alias("name"), F.col("ABN._status").alias("status"))


def _workbook(rows: pd.DataFrame) -> bytes:
    """A workbook with a title row, a header in row 3, texts shared and inline, and a gap."""
    texts = ["Directory of members", "Company Name", "Country", "Phone No.", "E-mail"]
    cell = lambda ref, x: f'<c r="{ref}" t="s"><v>{x}</v></c>' if isinstance(x, int) else f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>' if x is not None else ""
    lines = [f'<row r="1">{cell("A1", 0)}</row>', '<row r="2"/>', "<row r=\"3\">" + "".join(cell(f"{c}3", i) for c, i in zip("ABDE", (1, 2, 3, 4), strict=True)) + "</row>"]
    for k, (name, country, phone) in enumerate(rows.itertuples(index=False), 4):
        lines.append(f'<row r="{k}">{cell(f"A{k}", name)}{cell(f"B{k}", country)}{cell(f"D{k}", phone)}<c r="E{k}"/></row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


@query("workbook_scan", "SELECT s_name name, n_name country, CASE WHEN s_suppkey % 3 <> 0 THEN 'T' || s_suppkey END phone, CAST(NULL AS VARCHAR) email FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def workbook_scan(v: Views) -> DataFrame:
    """Directories as workbooks whose header stands somewhere below the top."""
    rows = v.table("supplier").join(F.broadcast(v.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name", F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("T"), "s_suppkey")).alias("p"))
    return readers.workbook_rows(_packed(rows, _workbook), {"name": ["name"], "country": ["country"], "phone": ["phone"], "email": ["mail"]}, needed="name")


@query("report_file", sql("SELECT industry, count(*) n, count(*) FILTER (WHERE email IS NOT NULL) with_email FROM v_entity GROUP BY 1"))
def report_file(v: Views) -> DataFrame:
    """A report as one JSON file, read back."""
    path = new_path(v.spark, "report")
    by = v.entity.groupBy("industry").agg(F.count("*").alias("n"), F.count("email").alias("with_email"))
    sinks.write_report(by, path)
    return v.spark.read.schema("industry string, n long, with_email long").json(path, multiLine=True)


def _events(v: Views) -> DataFrame:
    return jobs.event_stream(v.spark, f"{v.sf_dir}/events.parquet")


@query("stream_dedup", "SELECT DISTINCT event_id || ':' || event_type event_key FROM events")
def stream_dedup(v: Views) -> DataFrame:
    """Notices of which every tenth comes twice, each once."""
    twice = _events(v).withColumn("event_key", F.concat_ws(":", "event_id", "event_type")).withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return jobs.run_available(jobs.first_notices(twice).select("event_key"), "append")


@query("stream_usage_counter", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type meter, count(*) used FROM events GROUP BY 1, 2")
def stream_usage_counter(v: Views) -> DataFrame:
    return jobs.run_available(jobs.usage_counters(_events(v)), "update", ("day", "meter"))


@query("stream_quota", CONSUME_SQL)
def stream_quota(v: Views) -> DataFrame:
    """Requests against quota and balance, as a stream with state."""
    meter = F.create_map(*[F.lit(x) for x in ("click", "search", "view", "profile", "error", "send")])[F.col("event_type")]
    rows = _events(v).filter("event_type <> 'signup'").select(F.col("user_id").alias("account"), "event_id", "ts", meter.alias("meter"), (F.lit(1) + F.col("event_id") % 3).alias("n"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    return jobs.run_quotas(rows, {"search": 12, "profile": 6, "send": 3}, RATES)


@query("stream_quota_timed", CONSUME_SQL)
def stream_quota_timed(v: Views) -> DataFrame:
    """The same with state and timers by account, in the order of event time."""
    meter = F.create_map(*[F.lit(x) for x in ("click", "search", "view", "profile", "error", "send")])[F.col("event_type")]
    rows = jobs.closed(_events(v), "2024-03-01").filter("event_type <> 'signup' or event_type is null").select(F.col("user_id").alias("account"), "event_id", "ts", meter.alias("meter"), (F.lit(1) + F.col("event_id") % 3).alias("n"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    return timed.run_in_order(rows, "account", timed.Quota({"search": 12, "profile": 6, "send": 3}, RATES), "event_id long, accepted boolean, balance long")


#: Of three events, the first makes an order, the second pays it (some the wrong price), the third is a failure or a repeated payment.
_NOTICE_SQL = """SELECT event_id // 3 order_id, event_id, epoch_us(ts) AS "at", CASE event_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'paid' ELSE CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'paid' END END kind, (event_id // 3 * 37) % 1000 + CASE WHEN event_id % 15 = 1 THEN 1 ELSE 0 END amount FROM events"""


def _notices(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "created").when((k % 3 == 2) & (k % 2 == 0), "failed").otherwise("paid")
    order = F.floor(k / 3).cast("long")
    return events.select(order.alias("order_id"), "event_id", "ts", kind.alias("kind"), ((order * 37) % 1000 + F.when(k % 15 == 1, 1).otherwise(0)).cast("long").alias("amount"))


@query("stream_orders_timed", f"""WITH n AS ({_NOTICE_SQL}) SELECT order_id, CASE WHEN x IS NULL THEN 'expired' ELSE x.kind END state, CASE WHEN x IS NULL THEN t + 420000000 ELSE x.t END AS "at" FROM (
    SELECT c.order_id, c."at" t, min({{'t': n."at", 'event_id': n.event_id, 'kind': n.kind}}) FILTER (WHERE n.kind IS NOT NULL) x FROM n c LEFT JOIN n ON n.order_id = c.order_id AND n.kind <> 'created' AND (n."at", n.event_id) > (c."at", c.event_id) AND n."at" <= c."at" + 420000000 AND (n.kind = 'failed' OR n.amount = c.amount)
    WHERE c.kind = 'created' GROUP BY c.order_id, c."at")""")
def stream_orders_timed(v: Views) -> DataFrame:
    """Orders that are paid, fail, or expire after seven minutes by a timer."""
    return timed.run_in_order(_notices(jobs.closed(_events(v), "2024-03-01")), "order_id", timed.Orders(420), "state string, at long")


@query("stream_order_payments", f"WITH n AS ({_NOTICE_SQL}) SELECT o.order_id, CAST(o.\"at\" AS BIGINT) ordered, count(p.\"at\") n_paid, coalesce(min(p.\"at\"), 0) first_paid FROM n o LEFT JOIN n p ON p.order_id = o.order_id AND p.kind = 'paid' AND p.amount = o.amount AND p.\"at\" BETWEEN o.\"at\" AND o.\"at\" + 420000000 WHERE o.kind = 'created' GROUP BY ALL")
def stream_order_payments(v: Views) -> DataFrame:
    """Orders and payment notices as two streams: each order with its payments within seven minutes, or without."""
    # the row that closes a stream has order -1, as the join drops rows without keys before they move the watermark
    rows = lambda: _notices(jobs.closed(_events(v), "2024-03-01")).withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("order_id", "amount")})
    orders = rows().filter("kind = 'created' or order_id = -1").select("order_id", F.col("amount").alias("price"), F.col("ts").alias("ordered_at"))
    payments = rows().filter("kind = 'paid' or order_id = -1").select(F.col("order_id").alias("paid_order"), "amount", F.col("ts").alias("paid_at"))
    found = jobs.run_available(timed.with_payments(orders, payments, "7 minutes").select("order_id", "ordered_at", "paid_at"), "append").filter("order_id >= 0")
    return found.groupBy("order_id", F.unix_micros("ordered_at").alias("ordered")).agg(F.count("paid_at").alias("n_paid"), F.coalesce(F.min(F.unix_micros("paid_at")), F.lit(0)).alias("first_paid"))


@query("stream_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS begin, event_type, count(*) n FROM events GROUP BY 1, 2")
def stream_tumbling(v: Views) -> DataFrame:
    return jobs.run_available(jobs.windowed(_events(v), "6 hours"), "update", ("begin", "event_type"))


@query("stream_sliding", "SELECT b AS begin, event_type, count(*) n FROM (SELECT event_type, unnest([s - s % 3600, s - s % 3600 - 3600]) b FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) s FROM events)) GROUP BY 1, 2")
def stream_sliding(v: Views) -> DataFrame:
    """Windows of two hours that begin every hour."""
    return jobs.run_available(jobs.windowed(_events(v), "2 hours", "1 hour"), "update", ("begin", "event_type"))


@query("stream_sessions", "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS begin, count(*) n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END fresh FROM events)) GROUP BY user_id, k")
def stream_sessions(v: Views) -> DataFrame:
    """Sessions as they end; a last row closes those that are open at the end of the table."""
    return jobs.run_available(jobs.sessions(jobs.closed(_events(v), "2024-03-01"), "6 hours"), "append")


@query("counter_upsert", sql("SELECT account, meter, isum(used) used FROM (SELECT account, event_type meter, count(*) used FROM v_event WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2 UNION ALL SELECT account, event_type, count(*) FROM v_event WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2) GROUP BY 1, 2"))
def counter_upsert(v: Views) -> DataFrame:
    """Counters of the first half of the month with those of the second added."""
    edge = F.expr("timestamp'2024-01-15 00:00:00'")
    count = lambda rows: rows.groupBy("account", F.col("event_type").alias("meter")).agg(F.count("*").alias("used"))
    return sinks.add_counters(count(v.event.filter(F.col("ts") < edge)), count(v.event.filter(F.col("ts") >= edge)), ("account", "meter"), "used")
