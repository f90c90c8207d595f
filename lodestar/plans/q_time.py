"""What holds at a time, and tables in versions: as-of and interval joins, sketches by day, refreshes, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, sketches
from ..operators import difference as diff
from ..sources.storage import materialise
from .registry import query
from .views import Views, sql


@query("asof_price", sql("""SELECT l.event_id, coalesce(r.event_id, -1) price_event, coalesce(r.amount, -1) price FROM (SELECT * FROM v_event WHERE event_type <> 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM v_event WHERE event_type = 'purchase') r ON l.account = r.account AND l.ts >= r.ts"""))
def asof_price(v: Views) -> DataFrame:
    """The price in force at each event: that of the account's last purchase."""
    events = v.event.withColumn("at", F.unix_micros("ts"))
    bought = events.filter("event_type = 'purchase'").select("account", "at", F.col("event_id").alias("price_event"), F.col("amount").alias("price"))
    found = asof.as_of(events.filter("event_type <> 'purchase'").select("account", "event_id", "at"), bought, ["account"], F.col("at"), F.col("at"), ["price_event", "price"])
    return found.select("event_id", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("price_event", "price")])


_SPAN_SQL = "SELECT account, event_id, epoch_us(ts) b, epoch_us(ts) + (event_id % {}) * 3600000000 e FROM v_event WHERE event_type = '{}'"


@query("interval_overlap", sql("SELECT x.event_id a_id, y.event_id b_id, CAST(least(x.e, y.e) - greatest(x.b, y.b) AS BIGINT) shared FROM x JOIN y ON x.account = y.account AND x.b < y.e AND y.b < x.e AND x.b < x.e AND y.b < y.e", x=_SPAN_SQL.format(5, "view"), y=_SPAN_SQL.format(300, "click")))
def interval_overlap(v: Views) -> DataFrame:
    """Pairs of spans of two kinds, of hours and of days, that overlap for an account."""
    span = lambda kind, hours, p: v.event.filter(F.col("event_type") == kind).select("account", F.col("event_id").alias(f"{p}_id"), F.unix_micros("ts").alias(f"{p}_b"), (F.unix_micros("ts") + (F.col("event_id") % hours) * 3_600_000_000).alias(f"{p}_e"))
    found = asof.overlapping(span("view", 5, "a"), span("click", 300, "b"), ["account"], ("a_b", "a_e"), ("b_b", "b_e"))
    return found.select("a_id", "b_id", (F.least("a_e", "b_e") - F.greatest("a_b", "b_b")).alias("shared"))


_OLD_SQL = "SELECT CASE WHEN id % 3 = 0 THEN NULL ELSE 'firm ' || id % 50 END AS name, industry, confidence // 20 band FROM v_entity"
_NEW_SQL = "SELECT CASE WHEN id % 3 = 0 OR id % 7 = 0 THEN NULL ELSE 'firm ' || id % 50 END AS name, industry, confidence // 20 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END band FROM v_entity WHERE id % 13 <> 0"


@query("version_changes", sql("""SELECT name, industry, band, change FROM (SELECT name, industry, band, CAST(sum(s) AS BIGINT) change FROM (SELECT *, -1 s FROM o UNION ALL SELECT *, 1 FROM w) GROUP BY 1, 2, 3) WHERE change <> 0""",
    o=_OLD_SQL, w=_NEW_SQL))
def version_changes(v: Views) -> DataFrame:
    """What changed between two versions of the companies, whose rows repeat and have nulls."""
    return diff.changes(*_two_versions(v))


@query("version_common", sql("SELECT name, industry, band, count(*) n FROM (SELECT * FROM o INTERSECT ALL SELECT * FROM w) GROUP BY 1, 2, 3",
    o=_OLD_SQL, w=_NEW_SQL))
def version_common(v: Views) -> DataFrame:
    """What two versions have in common, and how often."""
    return diff.common(*_two_versions(v)).withColumn("n", F.col("n").cast("long"))


def _two_versions(v: Views) -> tuple[DataFrame, DataFrame]:
    k, band = F.col("id"), F.floor(F.col("confidence") / 20)
    row = lambda gone, more: v.entity.select(k, F.when(~gone, F.concat(F.lit("firm "), k % 50)).alias("name"), "industry", (band + more).cast("long").alias("band"))
    old = row(k % 3 == 0, F.lit(0))
    new = row((k % 3 == 0) | (k % 7 == 0), F.when(k % 11 == 0, 1).otherwise(0)).filter("id % 13 <> 0")
    return old.drop("id"), new.drop("id")


@query("usage_totals", sql("SELECT coalesce(CAST(d AS VARCHAR), '') AS day, coalesce(event_type, '') event_type, CAST(GROUPING_ID(d, event_type) AS BIGINT) AS level, count(*) n, isum(amount) total FROM (SELECT *, CAST(ts AS DATE) d FROM v_event) GROUP BY CUBE (d, event_type)"))
def usage_totals(v: Views) -> DataFrame:
    """Events and amounts by day and kind, by either, and in all, in one pass."""
    rows = v.event.select(F.to_date("ts").cast("string").alias("day"), "event_type", "amount")
    return sketches.totals(rows, ["day", "event_type"], "amount").withColumns({c: F.coalesce(c, F.lit("")) for c in ("day", "event_type")})


@query("usage_spans", sql("""SELECT event_type, n, total, accounts, TRUE near_accounts, TRUE near_median FROM (SELECT event_type, count(*) n, isum(amount) total, count(DISTINCT account) accounts FROM v_event WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1)"""))
def usage_spans(v: Views) -> DataFrame:
    """A span of days from summaries that are kept by day: exact sums, and whether the estimates are within their errors of the exact values."""
    rows = v.event.select(F.to_date("ts").alias("day"), "event_type", "account", "amount")
    kept = materialise(sketches.summaries(rows, ["day", "event_type"], "account", "amount"))
    span = F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-19").cast("date"))
    told = sketches.estimates(sketches.merged(kept, ["event_type"], span)).withColumn("median", F.get("quantiles", F.lit(0)))
    inside = rows.filter(span).join(told.select("event_type", "median"), "event_type")
    exact = inside.groupBy("event_type").agg(F.count_distinct("account").alias("accounts"), (F.count_if(F.col("amount") < F.col("median")) / F.count("*")).alias("below"), (F.count_if(F.col("amount") <= F.col("median")) / F.count("*")).alias("upto"))
    near = F.abs(F.col("distinct") - F.col("accounts")) <= F.greatest(F.lit(1.0), F.col("accounts") * sketches.HLL_ERROR)
    middle = (F.col("below") <= 0.5 + sketches.KLL_ERROR) & (F.col("upto") >= 0.5 - sketches.KLL_ERROR)
    return told.join(exact, "event_type").select("event_type", "n", "total", "accounts", near.alias("near_accounts"), middle.alias("near_median"))
