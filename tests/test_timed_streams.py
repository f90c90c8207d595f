"""Streams with timers: batches in any order give what a fold over sorted rows gives."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.streaming import jobs, timed

BASE = 1_700_000_000


def _stream(spark, folder, rows, batches=4):
    """Rows in files that come one to a batch, each the rows of about one time span, shuffled; a last one that carries the watermark on."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r["sec"] + rng.randint(-300, 300))  # up to ten minutes out of order
    size = -(-len(rows) // batches)
    cut = [rows[i : i + size] for i in range(0, len(rows), size)]
    end = max(r["sec"] for r in rows) + 10**7
    cut += [[{"event_id": None, "key": -1, "sec": end}]]
    names = ["event_id", "key", "kind", "amount", "meter", "n", "plan"]
    for k, part in enumerate(cut):
        rng.shuffle(part)
        df = spark.createDataFrame([tuple(r.get(c) for c in [*names[:2], "sec", *names[2:]]) for r in part], "event_id long, key long, sec long, kind string, amount long, meter string, n long, plan string")
        df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.parquet(f"{folder}/{k:03d}")
    schema = spark.read.parquet(f"{folder}/000").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _folded(fold, rows):
    """The fold over sorted rows, by the class's own steps but without any stream."""
    out = []
    for key in sorted({r["key"] for r in rows}):
        kept = list(fold.start())
        for r in sorted((r for r in rows if r["key"] == key), key=lambda r: (r["sec"], r["event_id"])):
            at = r["sec"] * 1_000_000
            while (due := fold.due(kept)) is not None and due < at:
                out += [(key, *x) for x in fold.lapse(kept)]
            out += [(key, *x) for x in fold.step(kept, Row(at=at, event_id=r["event_id"], **{c: r.get(c) for c in ("kind", "amount", "meter", "n", "plan")}))]
        while fold.due(kept) is not None:
            out += [(key, *x) for x in fold.lapse(kept)]
    return sorted(out, key=str)


def test_orders_end_by_timers(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for order in range(60):
        at = BASE + rng.randint(0, 4000)
        rows.append({"event_id": order * 10, "key": order, "sec": at, "kind": "created", "amount": 100})
        for k in range(rng.randint(0, 3)):
            rows.append({"event_id": order * 10 + 1 + k, "key": order, "sec": at + rng.randint(-50, 900), "kind": rng.choice(["paid", "paid", "failed"]), "amount": rng.choice([100, 100, 99])})
    fold = timed.Orders(600)
    got = timed.run_in_order(_stream(spark, tmp_path, rows), "key", fold, "state string, at long", "15 minutes")
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == _folded(timed.Orders(600), rows) and {r[1] for r in found} == {"paid", "failed", "expired"}
    # by hand: each order ends once, by the first right notice in time or at its deadline
    for order, state, at in found:
        made = next(r["sec"] for r in rows if r["key"] == order and r["kind"] == "created")
        right = [(r["sec"], r["event_id"], r["kind"]) for r in rows if r["key"] == order and r["kind"] != "created" and (r["sec"], r["event_id"]) > (made, order * 10) and r["sec"] <= made + 600 and (r["kind"] == "failed" or r["amount"] == 100)]
        assert (state, at) == ((min(right)[2], min(right)[0] * 1_000_000) if right else ("expired", (made + 600) * 1_000_000))
    assert len({r[0] for r in found}) == len(found) == 60


@pytest.mark.parametrize("fold, out", [(timed.Quota({"search": 5, "send": 2}, {"search": 10, "send": 30}), "event_id long, accepted boolean, balance long"), (timed.Plans(1), "plan string, until long")])
def test_folds_in_the_order_of_time(spark, tmp_path, fold, out):
    rng = random.Random(3)
    rows = [{"event_id": i, "key": rng.randint(0, 8), "sec": BASE + rng.randint(0, 200_000), "meter": rng.choice(["search", "send", None]), "n": rng.randint(1, 3), "amount": rng.randint(1, 60), "plan": rng.choice(["growth", "trial"])} for i in range(300)]
    got = timed.run_in_order(_stream(spark, tmp_path, rows), "key", fold, out, "15 minutes")
    assert sorted(map(tuple, got.collect()), key=str) == _folded(fold, rows)


def test_orders_with_payments_of_a_second_stream(spark, tmp_path):
    rng = random.Random(4)
    orders = [{"event_id": i, "key": i, "sec": BASE + rng.randint(0, 5000), "amount": 10} for i in range(80)]
    paid = [{"event_id": 1000 + i, "key": i % 80, "sec": orders[i % 80]["sec"] + rng.randint(-60, 600), "amount": rng.choice([10, 10, 11])} for i in range(90)]
    o = _stream(spark, tmp_path / "o", orders).select(F.col("key").alias("order_id"), F.coalesce("amount", F.lit(0).cast("long")).alias("price"), F.col("ts").alias("ordered_at"))
    p = _stream(spark, tmp_path / "p", paid).select(F.col("key").alias("paid_order"), F.coalesce("amount", F.lit(0).cast("long")).alias("amount"), F.col("ts").alias("paid_at"))
    got = jobs.run_available(timed.with_payments(o, p, "5 minutes", "20 minutes").select("order_id", F.unix_seconds("ordered_at").alias("a"), F.unix_seconds("paid_at").alias("b")), "append").filter("order_id >= 0")
    want = []
    for r in orders:
        in_time = [q["sec"] for q in paid if q["key"] == r["key"] and q["amount"] == 10 and r["sec"] <= q["sec"] <= r["sec"] + 300]
        want += [(r["key"], r["sec"], b) for b in in_time] or [(r["key"], r["sec"], None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


class _Store:
    """A state store that counts what is written to it."""

    def __init__(self):
        self.values, self.written, self.timers = {}, 0, set()

    def getMapState(self, *_):
        return _Store()

    getValueState = getMapState

    def updateValue(self, key, value):
        self.values[key], self.written = value, self.written + 1

    def iterator(self):
        return iter(list(self.values.items()))

    def get(self):
        return self.values.get(None)

    def update(self, value):
        self.updateValue(None, value)

    def clear(self):
        self.values.clear()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_rows_of_a_bucket_are_kept_in_pieces(monkeypatch):
    monkeypatch.setattr(timed, "PIECE", 100)
    rng = random.Random(5)
    rows = [{"event_id": i, "key": rng.randint(0, 300), "sec": BASE + rng.randint(0, 5000), "kind": rng.choice(["created", "paid", "failed"]), "amount": rng.choice([1, 2])} for i in range(900)]
    fold, handle, out = timed.Orders(600), _Store(), []
    fold.out = ["key", "state", "at"]
    fold.init(handle)
    for part in (rows[::2], rows[1::2]):
        assert not list(fold.handleInputRows((7,), iter([Row(key=r["key"], at=r["sec"] * 1_000_000, event_id=r["event_id"], kind=r["kind"], amount=r["amount"]) for r in part]), None))
    assert fold.waiting.written == 10 and len(handle.timers) == 1
    for sec in (BASE + 2000, BASE + 2500, BASE + 10**6):
        due = {t for t in handle.timers if t <= sec * 1000}
        handle.timers -= due
        if due:
            out += map(tuple, fold.handleExpiredTimer((7,), type("Now", (), {"getCurrentWatermarkInMs": lambda _, s=sec: s * 1000})(), None))
    assert sorted(out, key=str) == _folded(timed.Orders(600), rows) and not handle.timers
    assert not fold.waiting.values and not fold.kept.values and not fold.woken.values
