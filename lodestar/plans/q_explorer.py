"""Shipments: pages, groupings, trends, joins with entities and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregate as a
from ..operators import search as s
from .registry import query
from .views import AS_OF, Views, sql



def measures() -> dict:
    return {"n": F.count("*"), "value": F.sum("value"), "weight": F.sum("weight")}


_M = "count(*) n, isum(value) AS value, isum(weight) weight"


@query("shipments_page", sql("""SELECT order_id, line, CAST(day AS VARCHAR) AS day, value, name, supplier, code6, rn AS rank FROM (SELECT h.*, name, supplier, row_number() OVER (ORDER BY day DESC, value DESC, order_id, line, part_id, h.supplier_id, weight) rn
    FROM v_shipment h JOIN v_entity ON entity_id = id JOIN v_supplier p ON h.supplier_id = p.supplier_id WHERE code6 LIKE '02%' AND day >= DATE '2000-01-01') WHERE rn BETWEEN 26 AND 50"""))
def shipments_page(v: Views) -> DataFrame:
    """The second page of the shipments of a chapter, with the names of both sides."""
    found = v.shipments("order_id", "line", "day", "value", "entity_id", "supplier_id", "part_id", "code6", "weight").filter(F.col("code6").startswith("02") & (F.col("day") >= "2000-01-01"))
    top = s.page(found, [F.desc("day"), F.desc("value"), *map(F.asc, ("order_id", "line", "part_id", "supplier_id", "weight"))], 2, 25)
    named = F.broadcast(top).join(v.entity.select("id", "name"), F.col("entity_id") == F.col("id"))  # 25 rows
    return F.broadcast(named).join(v.supplier, "supplier_id").select("order_id", "line", F.col("day").cast("string").alias("day"), "value", "name", "supplier", "code6", "rank")


@query("shipments_by_buyer", sql(f"SELECT name, {_M} FROM v_shipment JOIN v_entity ON entity_id = id GROUP BY 1 ORDER BY value DESC, name LIMIT 100"))
def shipments_by_buyer(v: Views) -> DataFrame:
    """Sums are made by id before names are joined."""
    by = v.shipments("entity_id", "value", "weight").groupBy("entity_id").agg(*[m.alias(k) for k, m in measures().items()])
    named = by.join(v.entity.select("id", "name"), F.col("entity_id") == F.col("id"))
    return a.grouped(named, F.col("name"), "name", {k: F.sum(k) for k in ("n", "value", "weight")}, "value", 100)


@query("shipments_by_exporter", sql(f"SELECT supplier, {_M} FROM v_shipment JOIN v_supplier USING (supplier_id) GROUP BY 1 ORDER BY value DESC, supplier LIMIT 100"))
def shipments_by_exporter(v: Views) -> DataFrame:
    by = v.shipments("supplier_id", "value", "weight").groupBy("supplier_id").agg(*[m.alias(k) for k, m in measures().items()])
    return a.grouped(by.join(v.supplier, "supplier_id"), F.col("supplier"), "supplier", {k: F.sum(k) for k in ("n", "value", "weight")}, "value", 100)


@query("shipments_by_code", sql(f"SELECT code6, {_M} FROM v_shipment GROUP BY 1 ORDER BY value DESC, code6 LIMIT 100"))
def shipments_by_code(v: Views) -> DataFrame:
    return a.grouped(v.shipments("code6", "value", "weight"), F.col("code6"), "code6", measures(), "value", 100)


@query("shipments_by_month", sql(f"SELECT strftime(day, '%Y-%m') AS month, {_M} FROM v_shipment GROUP BY 1"))
def shipments_by_month(v: Views) -> DataFrame:
    return a.grouped(v.shipments("day", "value", "weight"), F.date_format("day", "yyyy-MM"), "month", measures())


@query("shipment_stats", sql("SELECT count(*) n, count(DISTINCT entity_id) entities, count(DISTINCT supplier_id) suppliers, isum(value) total, CAST(floor(sum(value) / count(*) + 0.5) AS BIGINT) mean, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) last_day FROM v_shipment"))
def shipment_stats(v: Views) -> DataFrame:
    return v.shipments("entity_id", "supplier_id", "value", "day").agg(
        F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("supplier_id").alias("suppliers"), F.sum("value").alias("total"),
        F.floor(F.sum("value") / F.count("*") + 0.5).alias("mean"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
    )


@query("monthly_trend", sql("SELECT strftime(day, '%Y-%m') AS month, count(*) n, isum(value) AS value FROM v_shipment WHERE heading = '0305' GROUP BY 1 ORDER BY month DESC LIMIT 24"))
def monthly_trend(v: Views) -> DataFrame:
    """The last 24 months of a heading."""
    return v.shipments("heading", "day", "value").filter("heading = '0305'").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).orderBy(F.desc("month")).limit(24)


@query("buyer_product_agg", sql("SELECT entity_id, heading, count(*) n, isum(weight) weight, isum(value) AS value, CAST(min(day) AS VARCHAR) first_seen, CAST(max(day) AS VARCHAR) last_seen FROM v_shipment GROUP BY 1, 2"))
def buyer_product_agg(v: Views) -> DataFrame:
    return v.shipments("entity_id", "heading", "weight", "value", "day").groupBy("entity_id", "heading").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("value").alias("value"), F.min("day").cast("string").alias("first_seen"), F.max("day").cast("string").alias("last_seen"))


@query("buyer_12m_yoy", sql("""SELECT entity_id, n_12m, value_12m, value_before, CASE WHEN value_before > 0 THEN CAST(floor(100.0 * (value_12m - value_before) / value_before + 0.5) AS BIGINT) END growth FROM (
    SELECT entity_id, count(*) FILTER (WHERE day >= DATE '2000-11-05') n_12m, coalesce(isum(CASE WHEN day >= DATE '2000-11-05' THEN value END), 0) value_12m, coalesce(isum(CASE WHEN day < DATE '2000-11-05' THEN value END), 0) value_before
    FROM v_shipment WHERE day >= DATE '1999-11-05' AND day < DATE '2001-11-05' GROUP BY 1)"""))
def buyer_12m_yoy(v: Views) -> DataFrame:
    """Each entity's last twelve months against the twelve before."""
    now = F.col("day") >= F.add_months(F.to_date(F.lit(AS_OF)), -12)
    both = v.shipments("entity_id", "day", "value").filter((F.col("day") >= F.add_months(F.to_date(F.lit(AS_OF)), -24)) & (F.col("day") < AS_OF))
    by = both.groupBy("entity_id").agg(F.count_if(now).alias("n_12m"), F.coalesce(F.sum(F.when(now, F.col("value"))), F.lit(0)).alias("value_12m"), F.coalesce(F.sum(F.when(~now, F.col("value"))), F.lit(0)).alias("value_before"))
    return by.withColumn("growth", F.when(F.col("value_before") > 0, F.floor((F.col("value_12m") - F.col("value_before")) * 100.0 / F.col("value_before") + 0.5)))


@query("trade_flow_by_partner", sql("""SELECT partner, value, weight, total FROM (SELECT partner, isum(val) AS value, isum(weight) weight FROM f WHERE partner <> 'ALL' GROUP BY 1),
    (SELECT coalesce(nullif(max(CASE WHEN partner = 'ALL' THEN val END), 0), isum(CASE WHEN partner <> 'ALL' THEN val END)) total FROM f)""",
    f="""SELECT partner, coalesce(nullif(fob, 0), nullif(cif, 0), other, 0) val, coalesce(weight, 0) weight FROM (
    SELECT supplier_country partner, CASE WHEN flag = 'A' THEN 0 ELSE value END fob, CASE WHEN flag = 'A' AND line % 2 = 0 THEN value + 100 END cif, value + 200 other, CASE WHEN flag <> 'R' THEN weight END weight FROM v_shipment JOIN v_supplier USING (supplier_id)
    UNION ALL SELECT 'ALL', isum(value), 0, 0, 0 FROM v_shipment)"""))
def trade_flow_by_partner(v: Views) -> DataFrame:
    """Value by partner country, where each shipment names its value in one of three fields."""
    c = F.col
    rows = v.shipments("supplier_id", "flag", "line", "value", "weight").join(v.supplier, "supplier_id").select(
        c("supplier_country").alias("partner"), F.when(c("flag") == "A", 0).otherwise(c("value")).alias("fob"), F.when((c("flag") == "A") & (c("line") % 2 == 0), c("value") + 100).alias("cif"),
        (c("value") + 200).alias("other"), F.when(c("flag") != "R", c("weight")).alias("weight"))
    world = v.shipments("value").agg(F.sum("value").alias("fob")).select(F.lit("ALL").alias("partner"), "fob", F.lit(0).cast("long").alias("cif"), F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("weight"))
    return a.trade_flow(rows.union(world), "ALL")


@query("code_counts_heading", sql("SELECT heading, count(DISTINCT entity_id) entities, count(*) n FROM v_shipment GROUP BY 1"))
def code_counts_heading(v: Views) -> DataFrame:
    """Entities and shipments by heading: counted by both first, so that a heading's distinct entities are rows."""
    by = v.shipments("heading", "entity_id").groupBy("heading", "entity_id").agg(F.count("*").alias("k"))
    return by.groupBy("heading").agg(F.count("*").alias("entities"), F.sum("k").alias("n"))


@query("code_counts_chapter", sql("SELECT left(heading, 2) chapter, max(n) largest_heading, isum(n) n, max(entities) entities FROM (SELECT heading, count(*) n, count(DISTINCT entity_id) entities FROM v_shipment GROUP BY 1) GROUP BY 1"))
def code_counts_chapter(v: Views) -> DataFrame:
    """Headings rolled up to chapters, by sum and by the largest."""
    by = v.shipments("heading", "entity_id").groupBy("heading").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))
    return by.groupBy(F.substring("heading", 1, 2).alias("chapter")).agg(F.max("n").alias("largest_heading"), F.sum("n").alias("n"), F.max("entities").alias("entities"))


@query("top_suppliers_home", sql("SELECT supplier, count(DISTINCT entity_id) entities, isum(value) AS value FROM v_shipment JOIN v_supplier USING (supplier_id) WHERE is_home GROUP BY 1 ORDER BY value DESC, supplier LIMIT 10"))
def top_suppliers_home(v: Views) -> DataFrame:
    home = v.supplier.filter("is_home")
    return v.shipments("supplier_id", "entity_id", "value").join(home, "supplier_id").groupBy("supplier").agg(F.count_distinct("entity_id").alias("entities"), F.sum("value").alias("value")).orderBy(F.desc("value"), "supplier").limit(10)


@query("competitor_to_saved", sql("""SELECT account, entity_id, CAST(max(day) AS VARCHAR) last_day, arg_max(supplier, lpad(CAST(day - DATE '1970-01-01' AS VARCHAR), 8, '0') || lpad(CAST(supplier_id AS VARCHAR), 12, '0')) supplier, count(*) n
    FROM v_saved JOIN v_shipment USING (entity_id) JOIN v_supplier USING (supplier_id) WHERE is_home AND day >= DATE '2001-11-05' - 365 GROUP BY 1, 2"""))
def competitor_to_saved(v: Views) -> DataFrame:
    """The last shipment of a home supplier to each saved entity, with the supplier that made it."""
    recent = v.shipments("day", "supplier_id", "entity_id").filter(F.col("day") >= F.date_sub(F.to_date(F.lit(AS_OF)), 365)).join(v.supplier.filter("is_home"), "supplier_id")
    by = recent.groupBy("entity_id").agg(F.max(F.struct("day", "supplier_id", "supplier")).alias("last"), F.count("*").alias("n"))
    return v.saved.select("account", "entity_id").join(by, "entity_id").select("account", "entity_id", F.col("last.day").cast("string").alias("last_day"), F.col("last.supplier").alias("supplier"), "n")


@query("saved_distinct", sql("SELECT account, count(DISTINCT entity_id) saved, count(DISTINCT country) countries FROM v_saved JOIN v_entity ON entity_id = id GROUP BY 1"))
def saved_distinct(v: Views) -> DataFrame:
    return v.saved.join(v.entity.select("id", "country"), F.col("entity_id") == F.col("id")).groupBy("account").agg(F.count_distinct("entity_id").alias("saved"), F.count_distinct("country").alias("countries"))


@query("unlock_left_join", sql("SELECT event_id, account, 1 + event_id % 400 entity_id, name FROM v_event LEFT JOIN v_entity ON id = 1 + event_id % 400 WHERE event_type = 'click'"))
def unlock_left_join(v: Views) -> DataFrame:
    """Unlocks with the name of the entity, null where it is gone."""
    unlocks = v.event.filter("event_type = 'click'").select("event_id", "account", (F.lit(1) + F.col("event_id") % 400).alias("entity_id"))
    return unlocks.join(v.entity.select("id", "name"), F.col("entity_id") == F.col("id"), "left").select("event_id", "account", "entity_id", "name")


@query("semi_in_subquery", sql("SELECT id, name FROM v_entity WHERE id IN (SELECT entity_id FROM v_shipment WHERE weight >= 50)"))
def semi_in_subquery(v: Views) -> DataFrame:
    heavy = v.shipments("entity_id", "weight").filter("weight >= 50").select("entity_id")
    return v.entity.join(heavy, F.col("id") == F.col("entity_id"), "left_semi").select("id", "name")


@query("recent_duplicate", sql("SELECT event_id, EXISTS (SELECT 1 FROM v_event b WHERE b.account = a.account AND b.event_type = a.event_type AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 14 DAY) repeated FROM v_event a"))
def recent_duplicate(v: Views) -> DataFrame:
    """Whether an account did the same within the 14 days before: one look back, no join."""
    before = F.lag("ts").over(W.partitionBy("account", "event_type").orderBy("ts", "event_id"))
    return v.event.select("event_id", F.coalesce(before >= F.col("ts") - F.expr("interval 14 days"), F.lit(False)).alias("repeated"))


@query("account_lookup_merge", sql("SELECT a.account, coalesce(b.plan, 'trial') plan, a.n FROM (SELECT account, count(*) n FROM v_event GROUP BY 1) a LEFT JOIN (SELECT id, CASE WHEN balance > 500000 THEN 'business' WHEN balance > 0 THEN 'growth' ELSE 'expired' END plan FROM v_entity WHERE email IS NOT NULL) b ON a.account = b.id"))
def account_lookup_merge(v: Views) -> DataFrame:
    """Accounts of one store with the plan that another store knows, `trial` where it knows none."""
    plan = F.when(F.col("balance") > 500000, "business").when(F.col("balance") > 0, "growth").otherwise("expired")
    billing = v.entity.filter("email is not null").select("id", plan.alias("plan"))
    used = v.event.groupBy("account").agg(F.count("*").alias("n"))
    return used.join(billing, F.col("account") == F.col("id"), "left").select("account", F.coalesce("plan", F.lit("trial")).alias("plan"), "n")


@query("code_display", sql("SELECT DISTINCT code6, regexp_replace(code6, '^(\\d{4})(\\d{2})$', '\\1.\\2') shown FROM v_taxonomy"))
def code_display(v: Views) -> DataFrame:
    return v.taxonomy.select("code6", F.regexp_replace("code6", r"^(\d{4})(\d{2})$", "$1.$2").alias("shown")).distinct()
