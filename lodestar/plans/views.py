"""The library's relations, derived from the star-schema tables, and the same derivations in SQL.

Companies that trade (entities) are customers, shipments are line items, the
product taxonomy comes from parts, accounts and their metered use from events.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dates that stand for "now".
AS_OF = "2001-11-05"
EVENTS_AS_OF = "2024-01-31"
#: Chapter of each part type's first word (fixed values).
CHAPTERS = {"ECONOMY": "01", "LARGE": "02", "MEDIUM": "03", "PROMO": "04", "SMALL": "05", "STANDARD": "06"}


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


class Views:
    """Relations over one folder of tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table; timestamps without a zone become timestamps in UTC."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"}
        return df.withColumns(zoneless) if zoneless else df

    @cached_property
    def entity(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        k = F.col("c_custkey")
        status = F.element_at(F.array(F.lit("role"), F.lit("domain"), F.lit("personal"), F.lit("freemail"), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
        return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(  # nations: 25 rows at any scale
            k.alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("industry"),
            F.when(k % 3 != 0, F.concat(F.lit("info"), k, F.lit("@firm"), k % 50, F.lit(".example.com"))).alias("email"),
            F.when(k % 3 != 0, status).alias("email_status"),
            F.when(k % 4 != 0, F.concat(F.lit("+49"), k + 30000000)).alias("phone"),
            F.when(k % 5 != 0, F.concat(F.lit("https://www.firm"), k % 50, F.lit(".example.com"))).alias("website"),
            (F.lit(40) + (k * 37) % 61).alias("confidence"), F.concat(F.lit("src"), k % 7).alias("source"), (F.lit(1) + k % 3).alias("n_sources"),
            (k % 2 == 0).alias("evidence"), (k % 11).alias("n_codes"), F.date_sub(F.to_date(F.lit(AS_OF)), (k % 400).cast("int")).alias("updated"),
            _cents("c_acctbal").alias("balance"),
        )

    @cached_property
    def supplier(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"), F.col("n_name").alias("supplier_country"), (F.col("n_regionkey") == 2).alias("is_home"))

    @cached_property
    def taxonomy(self) -> DataFrame:
        """A row for each part: its six-digit code and description."""
        chapter = F.create_map(*[F.lit(x) for pair in CHAPTERS.items() for x in pair])[F.split("p_type", " ")[0]]
        heading = F.concat(chapter, F.lpad(F.regexp_extract("p_brand", r"(\d+)$", 1), 2, "0"))
        return self.table("part").select(F.col("p_partkey").alias("part_id"), chapter.alias("chapter"), heading.alias("heading"), F.concat(heading, F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("code6"), F.col("p_name").alias("description"), "p_brand")

    def shipments(self, *columns: str) -> DataFrame:
        """A row for each line item with the columns asked for.

        Only what they need is joined: orders for entity_id, parts for the codes.
        Every line item has its order and its part, so a join changes no row, but
        Catalyst cannot know that and would shuffle all line items for each.
        Joins are by key, and Spark picks their form by measured sizes.
        """
        of_item = {
            "order_id": F.col("l_orderkey"), "line": F.col("l_linenumber"), "day": F.to_date("l_shipdate"), "supplier_id": F.col("l_suppkey"), "part_id": F.col("l_partkey"),
            "weight": F.col("l_quantity").cast("long"), "value": _cents("l_extendedprice"), "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"),
        }
        of_part = {"code6", "heading", "chapter"}
        keys = [k for k, needed in (("l_orderkey", "entity_id" in columns), ("l_partkey", bool(of_part & set(columns)))) if needed]
        rows = self.table("lineitem").select(*keys, *[of_item[c].alias(c) for c in columns if c in of_item])
        if "entity_id" in columns:
            rows = rows.join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity_id")), "l_orderkey")
        if of_part & set(columns):
            rows = rows.join(self.taxonomy.select(F.col("part_id").alias("l_partkey"), *[c for c in columns if c in of_part]), "l_partkey")
        return rows.select(*columns)

    @cached_property
    def event(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("account"), "event_type", _cents("value").alias("amount"), "props")

    @cached_property
    def saved(self) -> DataFrame:
        """Entities that accounts have saved, with the time of the first save."""
        e = self.event.filter("event_type = 'view'")
        return e.groupBy("account", (F.lit(1) + F.col("event_id") % 150).alias("entity_id")).agg(F.min("ts").alias("saved_at"))


#: The same relations for DuckDB.
VIEW_SQL = {
    "v_entity": """SELECT c_custkey id, c_name name, n_name country, n_regionkey region, c_mktsegment industry,
        CASE WHEN c_custkey % 3 <> 0 THEN 'info' || c_custkey || '@firm' || (c_custkey % 50) || '.example.com' END email,
        CASE WHEN c_custkey % 3 <> 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'role' WHEN 1 THEN 'domain' WHEN 2 THEN 'personal' WHEN 3 THEN 'freemail' END END email_status,
        CASE WHEN c_custkey % 4 <> 0 THEN '+49' || (c_custkey + 30000000) END phone,
        CASE WHEN c_custkey % 5 <> 0 THEN 'https://www.firm' || (c_custkey % 50) || '.example.com' END website,
        40 + (c_custkey * 37) % 61 confidence, 'src' || (c_custkey % 7) source, 1 + c_custkey % 3 n_sources, c_custkey % 2 = 0 evidence, c_custkey % 11 n_codes,
        DATE '2001-11-05' - CAST(c_custkey % 400 AS INTEGER) updated, CAST(round(c_acctbal * 100) AS BIGINT) balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_supplier": "SELECT s_suppkey supplier_id, s_name supplier, n_name supplier_country, n_regionkey = 2 is_home FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "v_taxonomy": """SELECT *, heading || lpad(CAST(p_size AS VARCHAR), 2, '0') code6 FROM (SELECT *, chapter || lpad(regexp_extract(p_brand, '(\\d+)$', 1), 2, '0') heading FROM (
        SELECT p_partkey part_id, p_name description, p_brand, p_size, CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN '01' WHEN 'LARGE' THEN '02' WHEN 'MEDIUM' THEN '03' WHEN 'PROMO' THEN '04' WHEN 'SMALL' THEN '05' WHEN 'STANDARD' THEN '06' END chapter FROM part))""",
    "v_shipment": """SELECT l_orderkey order_id, l_linenumber line, CAST(l_shipdate AS DATE) AS day, o_custkey entity_id, l_suppkey supplier_id, part_id, code6, heading, chapter,
        CAST(l_quantity AS BIGINT) weight, CAST(round(l_extendedprice * 100) AS BIGINT) AS value, l_returnflag flag, l_linestatus status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v_taxonomy ON l_partkey = part_id""",
    "v_event": "SELECT event_id, ts, user_id account, event_type, CAST(round(value * 100) AS BIGINT) amount, props FROM events",
    "v_saved": "SELECT account, 1 + event_id % 150 entity_id, min(ts) saved_at FROM v_event WHERE event_type = 'view' GROUP BY ALL",
}
_NEEDS = {"v_shipment": ["v_taxonomy"], "v_saved": ["v_event"]}


def _whole(text: str) -> str:
    """`isum(x)` is a sum of whole numbers as a BIGINT, which DuckDB's own is not."""
    return re.sub(r"\bisum\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"CAST(sum(\1) AS BIGINT)", text)


def sql(body: str, **more: str) -> str:
    """A query over the relations it names; further relations by keyword, in order."""
    texts = [body, *more.values()]
    names: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in names:
            names.append(name)

    for name in VIEW_SQL:
        if any(name in t for t in texts):
            add(name)
    body, more = _whole(body), {k: _whole(t) for k, t in more.items()}
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names] + [f"{n} AS ({t})" for n, t in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
