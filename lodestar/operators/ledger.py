"""Quotas, balances, orders, plans: folds over the events of one account.

Where rows of an account depend on all rows before, and not only through a sum,
the fold runs in one Python call for each account and batch, over Arrow columns;
sums over a window do the rest.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Price of a unit beyond the quota, by meter (fixed values).
RATES = {"search": 100, "profile": 300, "contact": 1000, "find_contact": 1000, "send": 200, "export": 100}
#: Plans: price, days, and units of each meter in the order of RATES; None is without limit (fixed values).
PLANS = {
    "trial": (0, 3, (100, 30, 5, 5, 10, 0)),
    "hemat": (14000, 30, (100, 30, 15, 10, 20, 0)),
    "growth": (99000, 30, (1000, 300, 150, 100, 300, 300)),
    "business": (299000, 30, (None, None, 600, 400, 2000, 3000)),
    "expired": (0, 0, (0, 0, 0, 0, 0, 0)),
}


def plan_limit(plan: Column, meter: Column) -> Column:
    """Units of a meter that a plan gives; null is without limit, and an unknown plan gives what an expired one does."""
    of = lambda limits: F.create_map(*[x for m, n in zip(RATES, limits, strict=True) for x in (F.lit(m), F.lit(n).cast("long"))])[meter]
    out = of(PLANS["expired"][2])
    for name, (_, _, limits) in PLANS.items():
        out = F.when(plan == name, of(limits)).otherwise(out)
    return out


def running_balance(rows: DataFrame, account: str = "account", delta: str = "delta", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The balance of an account after each row."""
    so_far = W.partitionBy(account).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("balance", F.sum(delta).over(so_far))


def quota_split(rows: DataFrame, limit: Column, rate: Column, key: tuple[str, ...] = ("account", "meter"), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Units taken from the quota and the cost of the others, where no request can be turned down."""
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    prior = F.coalesce(F.sum("n").over(before), F.lit(0))
    free = F.when(limit.isNull(), F.col("n")).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), limit - prior))).cast("long")
    return rows.withColumn("from_quota", free).withColumn("cost", ((F.col("n") - F.col("from_quota")) * rate).cast("long"))


def consume(rows: DataFrame, limits: Mapping[str, int | None], rates: Mapping[str, int] = RATES) -> DataFrame:
    """What becomes of each request: taken from quota and balance, or turned down.

    `rows` has account, ts, event_id, meter (null for a top-up), n and amount (of
    a top-up). A request that the balance cannot pay takes nothing. The fold
    needs the rows of an account in order: they are sorted by Spark and come in
    batches, so an account may be larger than a task's memory.
    """
    schema = "account long, event_id long, accepted boolean, from_quota long, cost long, balance long"
    laid = rows.repartition("account").sortWithinPartitions("account", "ts", "event_id")

    def fold(batches):
        account, balance, used = None, 0, {}
        for b in batches:
            out = []
            for acc, event, meter, n, amount in zip(b["account"], b["event_id"], b["meter"], b["n"], b["amount"], strict=True):
                if acc != account:
                    account, balance, used = acc, 0, {}
                if meter is None or meter != meter:
                    balance += int(amount)
                    out.append((acc, event, True, 0, 0, balance))
                    continue
                limit, so_far = limits[meter], used.get(meter, 0)
                free = n if limit is None else max(0, min(n, limit - so_far))
                cost = (n - free) * rates[meter]
                if cost > balance:
                    out.append((acc, event, False, 0, 0, balance))
                    continue
                used[meter], balance = so_far + n, balance - cost
                out.append((acc, event, True, free, cost, balance))
            if out:
                yield pd.DataFrame(out, columns=["account", "event_id", "accepted", "from_quota", "cost", "balance"])

    return laid.select("account", "event_id", "meter", "n", "amount").mapInPandas(fold, schema)


def once(events: DataFrame, key: tuple[str, ...] = ("event_key",), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first event of each key; later ones are duplicates."""
    rank = W.partitionBy(*key).orderBy(*order)
    return events.withColumn("duplicate", F.row_number().over(rank) > 1)


def order_states(payments: DataFrame) -> DataFrame:
    """(order_id, state, paid_at): paid once, by the first payment of the right amount.

    `payments` has order_id, price, kind (paid, expired, failed), amount, ts and event_id.
    """
    right = (F.col("kind") == "paid") & (F.col("amount") == F.col("price"))
    stamp = F.struct("ts", "event_id")
    by = payments.groupBy("order_id").agg(
        F.min(F.when(right, stamp)).alias("paid"), F.min(F.when(F.col("kind") != "paid", F.struct("ts", "event_id", "kind"))).alias("closed"),
        F.count_if((F.col("kind") == "paid") & (F.col("amount") != F.col("price"))).alias("mismatches"),
    )
    first = F.col("closed").isNull() | (F.struct("paid.ts", "paid.event_id") < F.struct("closed.ts", "closed.event_id"))
    state = F.when(F.col("paid").isNotNull() & first, "paid").when(F.col("closed").isNotNull(), F.col("closed.kind")).otherwise("pending")
    return by.select("order_id", state.alias("state"), F.when(state == "paid", F.col("paid.ts")).alias("paid_at"), "mismatches")


def plan_expiry(purchases: DataFrame, days: int = 30) -> DataFrame:
    """The expiry of each account's plan after all purchases: a purchase extends a running plan of its kind, else starts now.

    `purchases` has account, plan, ts (seconds) and event_id. As in `consume`,
    Spark sorts and the fold reads batches, so an account may have any number.
    """
    kind = purchases.schema["account"].dataType.simpleString()
    laid = purchases.repartition("account").sortWithinPartitions("account", "ts", "event_id").select("account", "plan", "ts")

    def fold(batches):
        last = None
        for b in batches:
            done = []
            for account, plan, ts in b.itertuples(index=False, name=None):
                if last is not None and last[0] != account:
                    done.append(last)
                    last = None
                begin = last[2] if last is not None and last[1] == plan and last[2] > ts else ts
                last = (account, plan, begin + days * 86400)
            yield pd.DataFrame(done, columns=["account", "plan", "until"])
        yield pd.DataFrame([last] if last is not None else [], columns=["account", "plan", "until"])

    return laid.mapInPandas(fold, f"account {kind}, plan string, until long")


def topup_reason(amount: Column) -> Column:
    """Why a top-up is refused; null if it is not."""
    return F.when(amount.isNull() | (amount != F.floor(amount)), "not_whole").when(amount < 10000, "too_small").when(amount % 10000 != 0, "not_a_multiple").when(amount > 5000000, "too_large")


def spaced(rows: DataFrame, key: tuple[str, ...], seconds: int) -> DataFrame:
    """Which rows are accepted if each accepted one blocks its key for some time; a refused row does not start the time anew.

    `rows` has event_id and ts (seconds). As in `consume`, Spark sorts and the fold reads batches.
    """
    names = list(key)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    laid = rows.repartition(*names).sortWithinPartitions(*names, "ts", "event_id").select(*names, "ts", "event_id")

    def fold(batches):
        last_key, last = None, 0
        for b in batches:
            accepted = np.zeros(len(b), bool)
            for i, (*k, ts, _) in enumerate(b.itertuples(index=False, name=None)):
                if k != last_key or ts - last >= seconds:
                    accepted[i], last_key, last = True, k, ts
            b["accepted"] = accepted
            yield b[[*names, "event_id", "accepted"]]

    return laid.mapInPandas(fold, f"{kinds}, event_id long, accepted boolean")


def order_requests(rows: DataFrame, reuse: int = 1800, span: int = 3600, most: int = 5) -> DataFrame:
    """(event_id, account, outcome, order_id): what becomes of each request for an order that stays unpaid.

    `rows` has account, item, ts (seconds) and event_id. A request for the item of
    an order of the last `reuse` seconds gets that order again (the last one);
    else it is refused while `most` orders of the last `span` seconds are there;
    else it makes an order of its own, named by its event_id. Only requests that
    make orders count later. An account's state is at most `most` orders, so an
    account may have any number of requests: Spark sorts, the fold reads batches.
    """
    laid = rows.repartition("account").sortWithinPartitions("account", "ts", "event_id").select("account", "ts", "event_id", "item")
    kind = rows.schema["account"].dataType.simpleString()

    def fold(batches):
        account, orders, first = None, [], True
        for b in batches:
            outcomes, ids = [], []
            for a, ts, event, item in b.itertuples(index=False, name=None):
                if first or a != account:
                    account, orders, first = a, [], False
                orders = [o for o in orders if o[0] > ts - span]
                same = [o[1] for o in orders if o[2] == item and o[0] > ts - reuse]
                outcome = "reused" if same else "refused" if len(orders) >= most else "created"
                if outcome == "created":
                    orders.append((ts, event, item))
                outcomes.append(outcome)
                ids.append(same[-1] if same else event if outcome == "created" else None)
            b["outcome"], b["order_id"] = outcomes, pd.array(ids, "Int64")
            yield b[["event_id", "account", "outcome", "order_id"]]

    return laid.mapInPandas(fold, f"event_id long, account {kind}, outcome string, order_id long")


def queue_state(log: DataFrame) -> DataFrame:
    """The state of each job from its log (job, ts, event_id, state, found, meta): a fold by partial aggregates.

    `created` is its first entry, `state` and `result_count` the last ones that
    are given, and `meta` has the last value of each key over all entries.
    """
    place = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))
    by = log.groupBy("job").agg(F.min(place).alias("created"), last("state").alias("state"), last("found").alias("result_count"))
    keys = log.select("job", "ts", "event_id", F.explode("meta").alias("key", "value")).groupBy("job", "key").agg(F.max_by("value", place).alias("value"))
    metas = keys.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    return by.join(metas, "job", "left")


def claim(jobs: DataFrame, workers: int, most: int) -> DataFrame:
    """(job, worker, round, place): the `most` oldest pending jobs in order, dealt to the workers in turn, each to one, one a round; nothing if none is pending."""
    from .search import page

    oldest = page(jobs.filter("state = 'pending'"), [F.col("created.ts").asc(), F.col("created.event_id").asc()], 1, most)
    return oldest.select("job", ((F.col("rank") - 1) % workers).alias("worker"), F.floor((F.col("rank") - 1) / workers).alias("round"), F.col("rank").alias("place"))
