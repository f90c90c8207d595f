"""Dashboards: conditional counts, daily series, revenue, funnels, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregate as a
from ..operators import search as s
from .q_search import RATED_SQL, rated
from .registry import query
from .views import EVENTS_AS_OF, Views, sql

_NOW = f"TIMESTAMP '{EVENTS_AS_OF} 00:00:00'"


def _ago(days: int):
    return F.expr(f"timestamp'{EVENTS_AS_OF} 00:00:00' - interval {days} days")


@query("kpi_conditional", sql(f"""SELECT count(*) total, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 1 DAY) last_day, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 7 DAY) last_week, count(DISTINCT account) accounts,
    count(DISTINCT account) FILTER (WHERE event_type = 'purchase') buyers, coalesce(isum(CASE WHEN event_type = 'purchase' THEN amount END), 0) revenue, coalesce(isum(CASE WHEN event_type = 'purchase' AND ts >= {_NOW} - INTERVAL 7 DAY THEN amount END), 0) revenue_week FROM v_event"""))
def kpi_conditional(v: Views) -> DataFrame:
    """One row of figures from one scan."""
    paid = F.col("event_type") == "purchase"
    money = lambda test: F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0))
    return v.event.agg(
        F.count("*").alias("total"), F.count_if(F.col("ts") >= _ago(1)).alias("last_day"), F.count_if(F.col("ts") >= _ago(7)).alias("last_week"), F.count_distinct("account").alias("accounts"),
        F.count_distinct(F.when(paid, F.col("account"))).alias("buyers"), money(paid).alias("revenue"), money(paid & (F.col("ts") >= _ago(7))).alias("revenue_week"),
    )


_SERIES = {"signups": "signup", "views": "view", "clicks": "click", "purchases": "purchase"}


@query("daily_series_30d", sql(f"""SELECT CAST(d.day AS VARCHAR) AS day, {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') {n}" for n, t in _SERIES.items())}
    FROM (SELECT DATE '{EVENTS_AS_OF}' - CAST(k AS INTEGER) AS day FROM range(30) r(k)) d LEFT JOIN v_event ON CAST(ts AS DATE) = d.day GROUP BY 1"""))
def daily_series_30d(v: Views) -> DataFrame:
    """Thirty days without gaps, four series side by side."""
    daily = v.event.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    joined = a.on_spine(a.daily_spine(v.spark, EVENTS_AS_OF, 30), {n: daily.filter(F.col("event_type") == t) for n, t in _SERIES.items()})
    return joined.withColumn("day", F.col("day").cast("string"))




def _payments(v: Views) -> DataFrame:
    return v.event.filter("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 3 == 0, "plan").otherwise("topup").alias("kind"), "amount", F.floor(F.col("amount") / 50).alias("fee"))


_PAYMENTS_SQL = "SELECT strftime(ts, '%Y-%m') AS month, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 = 0 THEN 'plan' ELSE 'topup' END kind, amount, CAST(floor(amount / 50) AS BIGINT) fee FROM v_event WHERE event_type = 'purchase'"


@query("revenue_month_kind", sql("SELECT month, kind, count(*) orders, isum(amount) amount, isum(fee) fee FROM p GROUP BY 1, 2", p=_PAYMENTS_SQL))
def revenue_month_kind(v: Views) -> DataFrame:
    return _payments(v).groupBy("month", "kind").agg(F.count("*").alias("orders"), F.sum("amount").alias("amount"), F.sum("fee").alias("fee"))


@query("revenue_pivot", sql("SELECT month, coalesce(isum(CASE WHEN kind = 'plan' THEN amount END), 0) plan, coalesce(isum(CASE WHEN kind = 'topup' THEN amount END), 0) topup, count(*) orders, isum(amount - fee) net FROM p GROUP BY 1", p=_PAYMENTS_SQL))
def revenue_pivot(v: Views) -> DataFrame:
    """Months by kind, with order and net totals."""
    wide = _payments(v).groupBy("month").pivot("kind", ["plan", "topup"]).agg(F.sum("amount").alias("amount"), F.count("amount").alias("n"), F.sum("fee").alias("fee"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return wide.select(
        "month", z(F.col("plan_amount")).alias("plan"), z(F.col("topup_amount")).alias("topup"), (z(F.col("plan_n")) + z(F.col("topup_n"))).alias("orders"),
        (z(F.col("plan_amount")) + z(F.col("topup_amount")) - z(F.col("plan_fee")) - z(F.col("topup_fee"))).alias("net"),
    )


@query("quality_histogram", sql("SELECT least(9, quality // 10) bucket, count(*) n FROM rated GROUP BY 1", rated=RATED_SQL))
def quality_histogram(v: Views) -> DataFrame:
    return rated(v).groupBy(a.histogram(F.col("quality"), 10, 9).alias("bucket")).agg(F.count("*").alias("n"))


@query("funnel", sql("""SELECT sent, opened, replied, CAST(floor(100.0 * opened / sent + 0.5) AS BIGINT) open_rate, CAST(floor(100.0 * replied / sent + 0.5) AS BIGINT) reply_rate FROM (
    SELECT isum(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END) sent, isum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) opened, isum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) replied FROM v_event)"""))
def funnel(v: Views) -> DataFrame:
    stage = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), 1).otherwise(0))
    counts = v.event.agg(stage("view", "click", "purchase").alias("sent"), stage("click", "purchase").alias("opened"), stage("purchase").alias("replied"))
    rate = lambda c: F.floor(F.col(c) * 100.0 / F.nullif("sent", F.lit(0)) + 0.5)
    return counts.select("*", rate("opened").alias("open_rate"), rate("replied").alias("reply_rate"))


@query("status_pipeline", sql("SELECT CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'other' END status, count(*) n, max(ts) FILTER (WHERE account < 50) IS NOT NULL AS has_small FROM v_event GROUP BY 1"))
def status_pipeline(v: Views) -> DataFrame:
    status = F.coalesce(F.create_map(*[F.lit(x) for x in ("signup", "pending", "click", "running", "purchase", "done", "error", "failed")])[F.col("event_type")], F.lit("other"))
    return v.event.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.bool_or(F.col("account") < 50).alias("has_small"))


@query("usage_daily", sql("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type meter, count(*) used, isum(amount) spent FROM v_event WHERE event_type <> 'purchase' GROUP BY 1, 2"))
def usage_daily(v: Views) -> DataFrame:
    return v.event.filter("event_type <> 'purchase'").groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("meter")).agg(F.count("*").alias("used"), F.sum("amount").alias("spent"))


@query("spend_by_meter", sql("SELECT regexp_replace(reason, '^usage:', '') meter, -isum(delta) spent FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'topup' ELSE 'usage:' || event_type END reason, CASE WHEN event_type = 'purchase' THEN amount ELSE -amount END delta FROM v_event) WHERE reason LIKE 'usage:%' GROUP BY 1"))
def spend_by_meter(v: Views) -> DataFrame:
    ledger = v.event.select(F.when(F.col("event_type") == "purchase", "topup").otherwise(F.concat(F.lit("usage:"), "event_type")).alias("reason"), F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(-F.col("amount")).alias("delta"))
    return ledger.filter(F.col("reason").startswith("usage:")).groupBy(F.regexp_replace("reason", "^usage:", "").alias("meter")).agg((-F.sum("delta")).alias("spent"))


@query("top_users", sql("SELECT account, count(*) n, isum(amount) amount FROM v_event GROUP BY 1 ORDER BY n DESC, account LIMIT 10"))
def top_users(v: Views) -> DataFrame:
    return v.event.groupBy("account").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).orderBy(F.desc("n"), "account").limit(10)


@query("users_with_subtotals", sql("""SELECT a.account, (SELECT count(*) FROM v_saved x WHERE x.account = a.account) saved, (SELECT count(*) FROM v_event x WHERE x.account = a.account AND x.event_type = 'error') errors,
    coalesce((SELECT isum(amount) FROM v_event x WHERE x.account = a.account AND x.event_type = 'purchase'), 0) paid FROM (SELECT DISTINCT account FROM v_event) a"""))
def users_with_subtotals(v: Views) -> DataFrame:
    """Correlated subtotals as aggregates made once and joined."""
    by = v.event.groupBy("account").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("amount"))), F.lit(0)).alias("paid"))
    return by.join(v.saved.groupBy("account").agg(F.count("*").alias("saved")), "account", "left").fillna(0, ["saved"])


@query("activity_feed", sql("""SELECT kind, ref, CAST(epoch_us(ts) AS BIGINT) happened FROM (
    SELECT CASE WHEN event_type = 'signup' THEN 'account' WHEN event_type = 'error' THEN 'alert' ELSE 'usage' END kind, event_id ref, ts FROM v_event
    UNION ALL SELECT 'order', o_orderkey, CAST(o_orderdate AS TIMESTAMP) FROM orders
    UNION ALL SELECT CASE WHEN abs(id % 3) < 1 THEN 'entity_new' ELSE 'entity_updated' END, id, CAST(updated AS TIMESTAMP) FROM v_entity) ORDER BY ts DESC, kind, ref LIMIT 40"""))
def activity_feed(v: Views) -> DataFrame:
    """The latest of several kinds of events: each kind gives its 40 latest before they are merged."""
    latest = lambda df: df.select("kind", F.col("ref").cast("long").alias("ref"), "ts").orderBy(F.desc("ts"), "kind", "ref").limit(40)
    kind = F.when(F.col("event_type") == "signup", "account").when(F.col("event_type") == "error", "alert").otherwise("usage")
    usage = v.event.select(kind.alias("kind"), F.col("event_id").alias("ref"), "ts")
    orders = v.table("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"), F.col("o_orderdate").alias("ts"))
    entities = v.entity.select(F.when(F.abs(F.col("id") % 3) < 1, "entity_new").otherwise("entity_updated").alias("kind"), F.col("id").alias("ref"), F.col("updated").cast("timestamp").alias("ts"))
    merged = latest(latest(usage).unionByName(latest(orders)).unionByName(latest(entities)))
    return merged.select("kind", "ref", F.unix_micros("ts").alias("happened"))


@query("audit_left_join", sql("SELECT event_id, account, name actor FROM v_event LEFT JOIN v_entity ON account = id AND email IS NOT NULL WHERE event_type = 'error'"))
def audit_left_join(v: Views) -> DataFrame:
    """Audit rows with the actor, null where none is known."""
    actors = v.entity.filter("email is not null").select("id", F.col("name").alias("actor"))
    return v.event.filter("event_type = 'error'").join(actors, F.col("account") == F.col("id"), "left").select("event_id", "account", "actor")


@query("focus_usage", sql("SELECT focus, count(*) n FROM (SELECT DISTINCT account, 'f' || unnest([account % 7, account % 11, account % 5]) focus FROM v_event) GROUP BY 1 ORDER BY n DESC, focus LIMIT 20"))
def focus_usage(v: Views) -> DataFrame:
    """Accounts by focus, from a list kept as JSON text."""
    c = F.col("account")
    stored = v.event.select("account").distinct().select("account", F.to_json(F.transform(F.array(c % 7, c % 11, c % 5), lambda x: F.concat(F.lit("f"), x))).alias("focus"))
    exploded = stored.select("account", F.explode(F.from_json("focus", "array<string>")).alias("focus")).distinct()
    return s.facet(exploded, "focus", 20)


@query("coverage_full_outer", sql("""SELECT coalesce(a.heading, b.heading) heading, coalesce(n, 0) shipments, coalesce(parts, 0) parts FROM (SELECT heading, count(*) n FROM v_shipment WHERE flag = 'R' AND weight > 45 AND value > 8000000 GROUP BY 1) a
    FULL JOIN (SELECT heading, count(*) parts FROM v_taxonomy WHERE part_id % 3 = 0 GROUP BY 1) b ON a.heading = b.heading"""))
def coverage_full_outer(v: Views) -> DataFrame:
    """Two aggregates of the same key, each with keys that the other lacks."""
    shipped = v.shipments("flag", "weight", "value", "heading").filter("flag = 'R' and weight > 45 and value > 8000000").groupBy("heading").agg(F.count("*").alias("shipments"))
    listed = v.taxonomy.filter("part_id % 3 = 0").groupBy("heading").agg(F.count("*").alias("parts"))
    return shipped.join(listed, "heading", "full").fillna(0, ["shipments", "parts"])


@query("bar_share", sql("SELECT country, n, CAST(floor(100.0 * n / max(n) OVER () + 0.5) AS BIGINT) share, CAST(sum(n) OVER () AS BIGINT) total FROM (SELECT country, count(*) n FROM v_entity GROUP BY 1)"))
def bar_share(v: Views) -> DataFrame:
    """Counts as a share of the largest; the window is over one row for each country."""
    by, whole = v.entity.groupBy("country").agg(F.count("*").alias("n")), W.partitionBy(F.lit(0))
    return by.select("country", "n", F.floor(F.col("n") * 100.0 / F.max("n").over(whole) + 0.5).alias("share"), F.sum("n").over(whole).alias("total"))


@query("lists_concat", sql("SELECT entity_id, string_agg(CAST(account AS VARCHAR), ',' ORDER BY account) accounts, count(*) n FROM v_saved GROUP BY 1"))
def lists_concat(v: Views) -> DataFrame:
    """For each entity the accounts that saved it."""
    return v.saved.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("account")).cast("array<string>"), ",").alias("accounts"), F.count("*").alias("n"))


@query("group_by_expr", sql("SELECT n_codes // 4 band, left(source, 4) source, CASE WHEN confidence >= 70 THEN 'high' ELSE 'low' END trust, count(*) n FROM v_entity GROUP BY 1, 2, 3"))
def group_by_expr(v: Views) -> DataFrame:
    return v.entity.groupBy(F.floor(F.col("n_codes") / 4).alias("band"), F.substring("source", 1, 4).alias("source"), F.when(F.col("confidence") >= 70, "high").otherwise("low").alias("trust")).agg(F.count("*").alias("n"))


@query("daily_counts", sql("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) n FROM v_event GROUP BY 1, 2"))
def daily_counts(v: Views) -> DataFrame:
    return v.event.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("array_size_stats", sql("SELECT isum(len(codes)) codes, count(*) FILTER (WHERE len(codes) > 1) several, count(*) entities FROM (SELECT entity_id, list(DISTINCT heading) codes FROM v_shipment GROUP BY 1)"))
def array_size_stats(v: Views) -> DataFrame:
    codes = v.shipments("entity_id", "heading").groupBy("entity_id").agg(F.collect_set("heading").alias("codes"))
    return codes.agg(F.sum(F.size("codes")).alias("codes"), F.count_if(F.size("codes") > 1).alias("several"), F.count("*").alias("entities"))


@query("run_counters", sql("SELECT source, count(*) \"read\", count(*) FILTER (WHERE confidence >= 80) new, count(*) FILTER (WHERE confidence BETWEEN 60 AND 79) merged, count(*) FILTER (WHERE confidence < 60) duplicate, count(*) FILTER (WHERE email IS NOT NULL) with_email FROM v_entity GROUP BY 1"))
def run_counters(v: Views) -> DataFrame:
    """What became of the rows of each source."""
    c = F.col("confidence")
    return a.counted_where(v.entity, {"read": F.lit(True), "new": c >= 80, "merged": c.between(60, 79), "duplicate": c < 60, "with_email": F.col("email").isNotNull()}, ["source"])


@query("distinct_countries", sql("SELECT industry, count(DISTINCT country) countries, count(DISTINCT source) sources FROM v_entity GROUP BY 1"))
def distinct_countries(v: Views) -> DataFrame:
    return v.entity.groupBy("industry").agg(F.count_distinct("country").alias("countries"), F.count_distinct("source").alias("sources"))


@query("quality_report", sql("""SELECT 'source' section, source AS key, count(*) n, CAST(floor(avg(quality) + 0.5) AS BIGINT) mean FROM rated GROUP BY 2 UNION ALL SELECT 'country', country, count(*), CAST(floor(avg(quality) + 0.5) AS BIGINT) FROM rated GROUP BY 2
    UNION ALL SELECT 'hidden', coalesce(hidden_reason, ''), count(*), CAST(floor(avg(quality) + 0.5) AS BIGINT) FROM rated GROUP BY 2 UNION ALL SELECT 'total', '', count(*), CAST(floor(avg(quality) + 0.5) AS BIGINT) FROM rated""", rated=RATED_SQL))
def quality_report(v: Views) -> DataFrame:
    """Sections of the report in one pass, by grouping sets."""
    rows = rated(v).select("quality", F.explode(F.array(*[F.struct(F.lit(k).alias("section"), c.alias("key")) for k, c in (
        ("source", F.col("source")), ("country", F.col("country")), ("hidden", F.coalesce("hidden_reason", F.lit(""))), ("total", F.lit("")))])).alias("g"))
    return rows.groupBy("g.section", "g.key").agg(F.count("*").alias("n"), F.floor(F.avg("quality") + 0.5).alias("mean"))


@query("days_left", sql(f"SELECT account, greatest(0, CAST(ceil(epoch(max(ts) + INTERVAL 30 DAY - {_NOW}) / 86400) AS BIGINT)) days_left FROM v_event WHERE event_type = 'purchase' GROUP BY 1"))
def days_left(v: Views) -> DataFrame:
    """Days until the plan bought last runs out."""
    left = F.unix_micros(F.max("ts") + F.expr("interval 30 days")) - F.unix_micros(F.expr(f"timestamp'{EVENTS_AS_OF} 00:00:00'"))
    return v.event.filter("event_type = 'purchase'").groupBy("account").agg(F.greatest(F.lit(0), F.ceil(left / 86400e6)).alias("days_left"))


@query("relative_time", sql(f"""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' WHEN s < 2592000 THEN (s // 86400) || ' d' ELSE 'long ago' END ago
    FROM (SELECT event_id, CAST(epoch({_NOW}) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) s FROM v_event)"""))
def relative_time(v: Views) -> DataFrame:
    s_ = F.unix_seconds(F.expr(f"timestamp'{EVENTS_AS_OF} 00:00:00'")) - F.unix_seconds("ts")
    unit = lambda n, u: F.concat(F.floor(s_ / n), F.lit(u))
    return v.event.select("event_id", F.when(s_ < 60, "just now").when(s_ < 3600, unit(60, " min")).when(s_ < 86400, unit(3600, " h")).when(s_ < 2592000, unit(86400, " d")).otherwise("long ago").alias("ago"))


@query("insight_text", sql("""SELECT id, array_to_string(list_filter([CASE WHEN quality >= 70 THEN 'well documented' END, CASE WHEN email IS NOT NULL AND phone IS NOT NULL THEN 'reachable by mail and phone' WHEN email IS NOT NULL THEN 'reachable by mail' WHEN phone IS NOT NULL THEN 'reachable by phone' END,
    CASE WHEN n_sources > 1 THEN 'seen in ' || n_sources || ' sources' END, CASE WHEN balance < 0 THEN 'in debt' END], lambda x: x IS NOT NULL), '; ') insight FROM rated""", rated=RATED_SQL))
def insight_text(v: Views) -> DataFrame:
    """Sentences that hold for an entity."""
    c = F.col
    parts = F.array(
        F.when(c("quality") >= 70, "well documented"),
        F.when(c("email").isNotNull() & c("phone").isNotNull(), "reachable by mail and phone").when(c("email").isNotNull(), "reachable by mail").when(c("phone").isNotNull(), "reachable by phone"),
        F.when(c("n_sources") > 1, F.concat(F.lit("seen in "), "n_sources", F.lit(" sources"))), F.when(c("balance") < 0, "in debt"),
    )
    return rated(v).select("id", F.array_join(F.array_compact(parts), "; ").alias("insight"))
