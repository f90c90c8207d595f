"""Accounts: quotas, balances, orders, alerts, messages, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ledger as g
from .registry import query
from .views import AS_OF, EVENTS_AS_OF, Views, sql

_NOW_S = f"CAST(epoch(TIMESTAMP '{EVENTS_AS_OF} 00:00:00') AS BIGINT)"


def _now_s():
    return F.unix_seconds(F.expr(f"timestamp'{EVENTS_AS_OF} 00:00:00'"))


def _deltas(v: Views) -> DataFrame:
    return v.event.withColumn("delta", F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(-F.floor(F.col("amount") / 10)))


@query("running_balance", sql("SELECT event_id, account, CAST(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE -CAST(floor(amount / 10) AS BIGINT) END) OVER (PARTITION BY account ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) balance FROM v_event"))
def running_balance(v: Views) -> DataFrame:
    return g.running_balance(_deltas(v)).select("event_id", "account", "balance")


_METERS = {"click": "search", "view": "profile", "error": "send"}
_USE_SQL = "SELECT event_id, account, ts, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'profile' WHEN 'error' THEN 'send' END meter, 1 + event_id % 3 n FROM v_event WHERE event_type IN ('click', 'view', 'error')"


def _use(v: Views) -> DataFrame:
    meter = F.create_map(*[F.lit(x) for pair in _METERS.items() for x in pair])[F.col("event_type")]
    return v.event.filter(F.col("event_type").isin(*_METERS)).select("event_id", "account", "ts", meter.alias("meter"), (F.lit(1) + F.col("event_id") % 3).alias("n"))


@query("quota_split", sql("""SELECT event_id, n, q from_quota, (n - q) * CASE meter WHEN 'search' THEN 100 WHEN 'profile' THEN 300 ELSE 200 END AS cost FROM (SELECT *, greatest(0, least(n, CASE meter WHEN 'search' THEN 12 WHEN 'profile' THEN 6 ELSE 3 END
    - CAST(coalesce(sum(n) OVER (PARTITION BY account, meter ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))) q FROM u)""", u=_USE_SQL))
def quota_split(v: Views) -> DataFrame:
    """Units from quota and cost of the rest, where all requests are granted."""
    of = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("meter")]
    return g.quota_split(_use(v), of({"search": 12, "profile": 6, "send": 3}), of({k: g.RATES[k] for k in ("search", "profile", "send")})).select("event_id", "n", "from_quota", "cost")


_PLAN_SQL = "CASE meter " + " ".join(f"WHEN '{m}' THEN CASE account % 5 " + " ".join(f"WHEN {i} THEN {'NULL' if p[2][j] is None else p[2][j]}" for i, p in enumerate(g.PLANS.values())) + " END" for j, m in enumerate(g.RATES)) + " END"


@query("plan_quota", sql(f"""SELECT event_id, q from_quota, CAST((n - q) * CASE meter WHEN 'search' THEN 100 WHEN 'profile' THEN 300 ELSE 200 END AS BIGINT) AS cost FROM (SELECT *, CASE WHEN lim IS NULL THEN n ELSE greatest(0, least(n, lim - CAST(coalesce(sum(n) OVER (PARTITION BY account, meter ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))) END q FROM (SELECT *, {_PLAN_SQL} lim FROM u))""", u=_USE_SQL))
def plan_quota(v: Views) -> DataFrame:
    """Units from the quota of each account's plan, some of which have no limit, and the cost of the rest."""
    plan = F.get(F.array(*map(F.lit, g.PLANS)), (F.col("account") % 5).cast("int"))
    rate = F.create_map(*[F.lit(x) for pair in g.RATES.items() for x in pair])[F.col("meter")]
    return g.quota_split(_use(v), g.plan_limit(plan, F.col("meter")), rate).select("event_id", "from_quota", "cost")


_LIMITS = {"search": 12, "profile": 6, "send": 3}
_COUNT_SQL = ", ".join(f"u_{m} + CASE WHEN ok AND meter = '{m}' THEN n ELSE 0 END" for m in _LIMITS)
#: Request by request: what the account has used of each meter, its balance, and what becomes of the next one.
CONSUME_SQL = f"""WITH RECURSIVE e AS (SELECT user_id account, event_id, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'profile' WHEN 'error' THEN 'send' END meter, 1 + event_id % 3 n, CAST(round(value * 100) AS BIGINT) amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events WHERE event_type <> 'signup'),
    w AS (SELECT user_id account, CAST(0 AS BIGINT) k, CAST(NULL AS BIGINT) event_id, true accepted, CAST(0 AS BIGINT) balance, {', '.join(f'CAST(0 AS BIGINT) u_{m}' for m in _LIMITS)} FROM events GROUP BY 1
      UNION ALL SELECT account, k, event_id, ok, CASE WHEN meter IS NULL THEN balance + amount WHEN ok THEN balance - cost ELSE balance END, {_COUNT_SQL} FROM (SELECT *, meter IS NULL OR cost <= balance ok FROM (
        SELECT e.*, w.balance, {', '.join(f'w.u_{m}' for m in _LIMITS)}, CAST((e.n - greatest(0, least(e.n, CASE e.meter {' '.join(f"WHEN '{m}' THEN {n} - w.u_{m}" for m, n in _LIMITS.items())} ELSE 0 END))) * CASE e.meter {' '.join(f"WHEN '{m}' THEN {g.RATES[m]}" for m in _LIMITS)} ELSE 0 END AS BIGINT) AS cost FROM w JOIN e ON e.account = w.account AND e.k = w.k + 1)))
    SELECT account, event_id, accepted, balance FROM w WHERE k > 0"""


@query("quota_consume", CONSUME_SQL)
def quota_consume(v: Views) -> DataFrame:
    """The same with requests turned down where the balance does not reach: a fold."""
    none = F.lit(None).cast("string")
    tops = v.event.filter("event_type = 'purchase'").select("account", "ts", "event_id", none.alias("meter"), F.lit(0).cast("long").alias("n"), "amount")
    uses = _use(v).select("account", "ts", "event_id", "meter", "n", F.lit(0).cast("long").alias("amount"))
    return g.consume(tops.unionByName(uses), _LIMITS).select("account", "event_id", "accepted", "balance")


_HOOKS_SQL = "SELECT event_id, account, ts, event_type, event_id || ':' || event_type event_key, 0 again FROM v_event UNION ALL SELECT event_id, account, ts + INTERVAL 5 MINUTE, event_type, event_id || ':' || event_type, 1 FROM v_event WHERE event_id % 10 = 0"


@query("orders_applied_once", sql("SELECT account, count(*) applied, isum(amount) amount FROM (SELECT h.*, amount, row_number() OVER (PARTITION BY event_key ORDER BY h.ts, again) rn FROM h JOIN v_event e USING (event_id)) WHERE rn = 1 AND event_type = 'purchase' GROUP BY 1", h=_HOOKS_SQL))
def orders_applied_once(v: Views) -> DataFrame:
    """Payments by account when every tenth notice comes twice."""
    again = v.event.filter("event_id % 10 = 0").withColumn("ts", F.col("ts") + F.expr("interval 5 minutes"))
    notices = v.event.withColumn("again", F.lit(0)).unionByName(again.withColumn("again", F.lit(1))).withColumn("event_key", F.concat_ws(":", "event_id", "event_type"))
    return g.once(notices, order=("ts", "again")).filter("not duplicate and event_type = 'purchase'").groupBy("account").agg(F.count("*").alias("applied"), F.sum("amount").alias("amount"))


@query("order_states", sql("""SELECT order_id, CASE WHEN paid IS NOT NULL AND (closed IS NULL OR paid < closed) THEN 'paid' WHEN closed IS NOT NULL THEN kind ELSE 'pending' END state, mismatches FROM (SELECT order_id, min(event_id) FILTER (WHERE kind = 'paid' AND amount = price) paid, min(event_id) FILTER (WHERE kind <> 'paid') closed,
    arg_min(kind, event_id) FILTER (WHERE kind <> 'paid') kind, count(*) FILTER (WHERE kind = 'paid' AND amount <> price) mismatches FROM n GROUP BY 1)""",
    n="SELECT event_id // 4 order_id, event_id, ts, 1000 price, CASE WHEN event_id % 13 = 0 THEN 999 ELSE 1000 END amount, CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'click' THEN 'paid' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'expired' ELSE 'paid' END kind FROM v_event"))
def order_states(v: Views) -> DataFrame:
    """Orders by what their notices make of them; event ids rise with time."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "expired").otherwise("paid")
    notices = v.event.select(F.floor(e / 4).alias("order_id"), "event_id", "ts", F.lit(1000).alias("price"), F.when(e % 13 == 0, 999).otherwise(1000).alias("amount"), kind.alias("kind"))
    return g.order_states(notices).select("order_id", "state", "mismatches")


@query("plan_expiry_fold", """WITH RECURSIVE e AS (SELECT user_id account, CASE WHEN CAST(round(value * 100) AS BIGINT) > 2000 THEN 'growth' ELSE 'hemat' END plan, CAST(floor(epoch(ts)) AS BIGINT) s, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) k, count(*) OVER (PARTITION BY user_id) n FROM events WHERE event_type = 'purchase'),
    w AS (SELECT account, k, n, plan, s + 2592000 AS until FROM e WHERE k = 1 UNION ALL SELECT e.account, e.k, e.n, e.plan, CASE WHEN w.plan = e.plan AND w.until > e.s THEN w.until ELSE e.s END + 2592000 FROM w JOIN e ON e.account = w.account AND e.k = w.k + 1)
    SELECT account, plan, until FROM w WHERE k = n""")
def plan_expiry_fold(v: Views) -> DataFrame:
    """Expiry after all renewals, a fold in order of time."""
    p = v.event.filter("event_type = 'purchase'").select("account", F.when(F.col("amount") > 2000, "growth").otherwise("hemat").alias("plan"), F.unix_seconds("ts").alias("ts"), "event_id")
    return g.plan_expiry(p)


@query("unlock_once", sql("SELECT account, count(*) charged FROM (SELECT account, event_id % 40 entity_id, event_type, row_number() OVER (PARTITION BY account, event_type, event_id % 40 ORDER BY ts, event_id) rn FROM v_event WHERE event_type IN ('view', 'click')) WHERE rn = 1 GROUP BY 1"))
def unlock_once(v: Views) -> DataFrame:
    """Only the first unlock of an entity is charged."""
    unlocks = v.event.filter("event_type in ('view', 'click')").select("account", "event_type", (F.col("event_id") % 40).alias("entity_id"), "ts", "event_id")
    return g.once(unlocks, ("account", "event_type", "entity_id")).filter("not duplicate").groupBy("account").agg(F.count("*").alias("charged"))


@query("pending_rate_limit", sql("SELECT event_id, pending, pending >= 5 refused FROM (SELECT event_id, count(*) OVER (PARTITION BY account ORDER BY CAST(floor(epoch(ts)) AS BIGINT) // 48 RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) pending FROM v_event)"))
def pending_rate_limit(v: Views) -> DataFrame:
    """Orders of its account in the hour before each order (events are spread over a month; their time runs 48 times faster here)."""
    hour = W.partitionBy("account").orderBy("s").rangeBetween(-3600, -1)
    rows = v.event.select("event_id", "account", F.floor(F.unix_seconds("ts") / 48).alias("s"))
    return rows.withColumn("pending", F.count("*").over(hour)).select("event_id", "pending", (F.col("pending") >= 5).alias("refused"))


@query("order_requests", """WITH RECURSIVE e AS (SELECT event_id, user_id account, event_type item, CAST(floor(epoch(ts)) AS BIGINT) // 200 s, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) // 200, event_id) k FROM events),
    w AS (SELECT account, k, event_id, 'created' outcome, event_id order_id, [{'s': s, 'id': event_id, 'item': item}] orders FROM e WHERE k = 1
      UNION ALL SELECT account, k, event_id, CASE WHEN len(same) > 0 THEN 'reused' WHEN len(live) >= 5 THEN 'refused' ELSE 'created' END, CASE WHEN len(same) > 0 THEN same[-1].id WHEN len(live) < 5 THEN event_id END, CASE WHEN len(same) > 0 OR len(live) >= 5 THEN live ELSE list_append(live, {'s': s, 'id': event_id, 'item': item}) END
      FROM (SELECT *, list_filter(live, lambda o: o.item = item AND o.s > s - 1800) same FROM (SELECT e.account, e.k, e.event_id, e.item, e.s, list_filter(w.orders, lambda o: o.s > e.s - 3600) live FROM w JOIN e ON e.account = w.account AND e.k = w.k + 1)))
    SELECT event_id, account, outcome, order_id FROM w""")
def order_requests(v: Views) -> DataFrame:
    """Requests for orders: the pending one again, refused, or a new one (time runs 200 times faster here)."""
    return g.order_requests(v.event.select("account", F.col("event_type").alias("item"), F.floor(F.unix_seconds("ts") / 200).alias("ts"), "event_id"))


@query("topup_validate", sql("SELECT event_id, CASE WHEN a < 10000 THEN 'too_small' WHEN a % 10000 <> 0 THEN 'not_a_multiple' WHEN a > 5000000 THEN 'too_large' END reason FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN amount * 2 ELSE (event_id % 700) * 10000 END a FROM v_event)"))
def topup_validate(v: Views) -> DataFrame:
    amount = F.when(F.col("event_id") % 2 == 0, F.col("amount") * 2).otherwise((F.col("event_id") % 700) * 10000)
    return v.event.select("event_id", g.topup_reason(amount).alias("reason"))


_ALERT_SQL = f"""SELECT account, 'activity' kind, 'act:' || entity_id || ':' || last_day AS dedup_key FROM sv JOIN (SELECT entity_id, max(day) last_day FROM v_shipment GROUP BY 1) USING (entity_id) WHERE last_day >= DATE '{AS_OF}' - 21
    UNION ALL SELECT account, 'new', 'nb:' || entity_id FROM fc JOIN (SELECT DISTINCT entity_id, heading FROM v_shipment) h USING (heading) JOIN (SELECT entity_id, min(day) first_day FROM v_shipment GROUP BY 1) n USING (entity_id) JOIN v_entity e ON e.id = entity_id WHERE first_day >= DATE '{AS_OF}' - 2400 AND (account % 3 = 0 OR region = account % 5)
    UNION ALL SELECT account, 'competitor', 'comp:' || entity_id || ':' || strftime(max(day), '%Y-%m') FROM sv JOIN v_shipment USING (entity_id) JOIN v_supplier USING (supplier_id) WHERE is_home AND day >= DATE '{AS_OF}' - 30 GROUP BY account, entity_id
    UNION ALL SELECT account, 'reminder', 'rem:' || entity_id || ':' || CAST(CAST(saved_at AS DATE) + 5 AS DATE) FROM sv WHERE CAST(saved_at AS DATE) + 5 <= DATE '{EVENTS_AS_OF}'"""


@query("alerts_all_rules", sql("SELECT DISTINCT account, kind, dedup_key FROM a", sv="SELECT * FROM v_saved WHERE account % 7 <> 0", fc="SELECT DISTINCT account, '0' || (1 + account % 6) || '11' heading FROM v_event WHERE account % 7 <> 0 UNION SELECT DISTINCT account, '0' || (1 + account % 4) || '23' FROM v_event WHERE account % 7 <> 0", a=_ALERT_SQL))
def alerts_all_rules(v: Views) -> DataFrame:
    """Alerts of four rules, each once: accounts follow two headings, some of them one region; every seventh has a plan without alerts.

    First shipments lie years back in these tables, so `new` looks back 2,400 days and not 45.
    """
    from ..operators.alerts import alerts

    k = F.col("account")
    accounts = v.event.select("account").distinct()
    allowed = accounts.select("account", F.when(k % 7 == 0, 0).otherwise(10).alias("alerts"))
    code = lambda n, tail: F.concat(F.lit("0"), 1 + k % n, F.lit(tail))
    followed = accounts.select("account", F.explode(F.array(code(6, "11"), code(4, "23"))).alias("heading"))
    wanted = accounts.filter(k % 3 != 0).select("account", (k % 5).alias("region"))
    return alerts(v.shipments("entity_id", "supplier_id", "day", "heading"), v.supplier, v.entity.select(F.col("id").alias("entity_id"), "region"), v.saved, allowed, followed, wanted, "region", AS_OF, EVENTS_AS_OF, new_days=2400)


@query("message_tracking", sql(f"""SELECT event_id, age > 120 AND h < 65 opened, age > 360 AND h < 25 AND age > 120 replied FROM (SELECT event_id, (event_id * 2654435761) % 100 h, {_NOW_S} - CAST(floor(epoch(ts)) AS BIGINT) age FROM v_event WHERE event_type = 'view')"""))
def message_tracking(v: Views) -> DataFrame:
    """Which messages count as opened and answered, by a hash of the id and the age."""
    h, age = F.pmod(F.col("event_id") * F.lit(2654435761), F.lit(100)), _now_s() - F.unix_seconds("ts")
    opened = (age > 120) & (h < 65)
    return v.event.filter("event_type = 'view'").select("event_id", opened.alias("opened"), (opened & (age > 360) & (h < 25)).alias("replied"))


@query("send_dedup_14d", """WITH RECURSIVE e AS (SELECT event_id, user_id account, event_type, CAST(floor(epoch(ts)) AS BIGINT) s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) k FROM events),
    w AS (SELECT event_id, account, event_type, k, s last, true accepted FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.account, e.event_type, e.k, CASE WHEN e.s - w.last >= 1209600 THEN e.s ELSE w.last END, e.s - w.last >= 1209600 FROM w JOIN e ON e.account = w.account AND e.event_type = w.event_type AND e.k = w.k + 1)
    SELECT event_id, account, accepted FROM w""")
def send_dedup_14d(v: Views) -> DataFrame:
    """Sends of one kind that are at least 14 days from the last one that went out."""
    rows = v.event.select("account", "event_type", F.unix_seconds("ts").alias("ts"), "event_id")
    return g.spaced(rows, ("account", "event_type"), 14 * 86400).select("event_id", "account", "accepted")


@query("replay_window", sql("SELECT event_id FROM (SELECT event_id, (event_id * 37) % 1500 - 700 lag FROM v_event) WHERE abs(lag) <= 600"))
def replay_window(v: Views) -> DataFrame:
    """Signed events that came within ten minutes of their time."""
    return v.event.filter(F.abs((F.col("event_id") * 37) % 1500 - 700) <= 600).select("event_id")


@query("effective_plan", sql(f"SELECT account, CASE WHEN max(s) + 10 * 86400 > {_NOW_S} THEN arg_max(plan, event_id) ELSE 'expired' END plan FROM (SELECT account, event_id, CAST(floor(epoch(ts)) AS BIGINT) s, CASE WHEN amount > 2000 THEN 'growth' ELSE 'hemat' END plan FROM v_event WHERE event_type = 'purchase') GROUP BY 1"))
def effective_plan(v: Views) -> DataFrame:
    p = v.event.filter("event_type = 'purchase'").groupBy("account").agg(F.max(F.unix_seconds("ts")).alias("s"), F.max_by(F.when(F.col("amount") > 2000, "growth").otherwise("hemat"), "event_id").alias("plan"))
    return p.select("account", F.when(F.col("s") + 10 * 86400 > _now_s(), F.col("plan")).otherwise("expired").alias("plan"))


@query("stale_revisit_queue", sql(f"SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY checked NULLS FIRST, confidence DESC, id) place FROM (SELECT *, CASE WHEN id % 4 <> 0 THEN updated END checked FROM v_entity) WHERE checked IS NULL OR (email IS NULL AND checked < DATE '{AS_OF}' - 30)) WHERE place <= 200"))
def stale_revisit_queue(v: Views) -> DataFrame:
    """The next 200 entities to look at again: never checked first, then the longest without a contact."""
    from ..operators.search import page

    rows = v.entity.withColumn("checked", F.when(F.col("id") % 4 != 0, F.col("updated")))
    due = rows.filter(F.col("checked").isNull() | (F.col("email").isNull() & (F.col("checked") < F.date_sub(F.to_date(F.lit(AS_OF)), 30))))
    return page(due, [F.asc_nulls_first("checked"), F.desc("confidence"), F.asc("id")], 1, 200).select("id", F.col("rank").alias("place"))


_JOB_SQL = """SELECT user_id * 10 + event_id % 4 job, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END state,
    CASE WHEN event_type = 'purchase' THEN CAST(round(value) AS BIGINT) END found, map([event_type, 'k'], [CAST(event_id AS VARCHAR), json_extract_string(props, '$.k')]) meta FROM events"""


def _job_log(v: Views) -> DataFrame:
    """Entries of jobs: state, results found, further facts by key."""
    states = F.create_map(*[F.lit(x) for x in ("signup", "pending", "click", "pending", "view", "running", "purchase", "done", "error", "failed")])
    e = v.table("events")
    facts = F.map_from_arrays(F.array("event_type", F.lit("k")), F.array(F.col("event_id").cast("string"), F.get_json_object("props", "$.k")))
    return e.select((F.col("user_id") * 10 + F.col("event_id") % 4).alias("job"), "ts", "event_id", states[F.col("event_type")].alias("state"), F.when(F.col("event_type") == "purchase", F.round("value").cast("long")).alias("found"), facts.alias("meta"))


@query("job_state", f"""SELECT job, state, result_count, created, array_to_string(list_sort(list_transform(map_entries(m), lambda x: x.key || '=' || x.value)), ',') meta FROM (SELECT job, arg_max(state, (ts, event_id)) state, arg_max(found, (ts, event_id)) FILTER (WHERE found IS NOT NULL) result_count, min((ts, event_id))[2] created FROM l GROUP BY 1)
    JOIN (SELECT job, map_from_entries(list((k, val))) m FROM (SELECT job, x.key k, arg_max(x.value, (ts, event_id)) val FROM (SELECT job, ts, event_id, unnest(map_entries(meta)) x FROM l) GROUP BY 1, 2) GROUP BY 1) USING (job)""".replace("FROM l", f"FROM ({_JOB_SQL})"))
def job_state(v: Views) -> DataFrame:
    """The state of each job from its log: the last change, the results, all facts merged."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return g.queue_state(_job_log(v)).select("job", "state", "result_count", F.col("created.event_id").alias("created"), entries.alias("meta"))


@query("job_claim", f"SELECT job, CAST((rn - 1) % 3 AS BIGINT) worker, CAST((rn - 1) // 3 AS BIGINT) round, rn place FROM (SELECT job, row_number() OVER (ORDER BY created) rn FROM (SELECT job, arg_max(state, (ts, event_id)) state, min((ts, event_id)) created FROM ({_JOB_SQL}) GROUP BY 1) WHERE state = 'pending') WHERE rn <= 20")
def job_claim(v: Views) -> DataFrame:
    """The next twenty pending jobs, the oldest first, drained by three workers in rounds."""
    return g.claim(g.queue_state(_job_log(v)), 3, 20).select("job", F.col("worker").cast("long").alias("worker"), "round", F.col("place").cast("long").alias("place"))


@query("status_transition", sql("SELECT account, entity_id, CASE WHEN EXISTS (SELECT 1 FROM v_event e WHERE e.account = x.account AND e.event_type = 'click' AND e.ts > x.saved_at) THEN 'contacted' ELSE 'new' END status FROM v_saved x"))
def status_transition(v: Views) -> DataFrame:
    """Saved entities move on when their account sends something later."""
    last = v.event.filter("event_type = 'click'").groupBy("account").agg(F.max("ts").alias("last"))
    return v.saved.join(last, "account", "left").select("account", "entity_id", F.when(F.col("last") > F.col("saved_at"), "contacted").otherwise("new").alias("status"))


@query("revisit_cooldown", sql(f"SELECT account, event_type, {_NOW_S} - max(CAST(floor(epoch(ts)) AS BIGINT)) >= CASE event_type WHEN 'click' THEN 10 * 86400 WHEN 'view' THEN 30 * 86400 ELSE 86400 END due FROM v_event GROUP BY 1, 2"))
def revisit_cooldown(v: Views) -> DataFrame:
    """Whether each pair's last visit is long enough ago."""
    wait = F.when(F.col("event_type") == "click", 10 * 86400).when(F.col("event_type") == "view", 30 * 86400).otherwise(86400)
    return v.event.groupBy("account", "event_type").agg(F.max(F.unix_seconds("ts")).alias("s")).select("account", "event_type", (_now_s() - F.col("s") >= wait).alias("due"))
