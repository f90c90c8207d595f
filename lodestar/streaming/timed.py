"""Streams with state by key and timers: quotas, orders and plans in the order of event time, and orders joined with their payments.

A batch may bring rows in any order. Each key keeps the rows that the watermark has
not passed and a timer at the first of them, so rows are folded in the order of their
times however they came, as long as they are not later than the stream allows, and
what is due at a time happens then, though no later row of the key comes. State lives
in the state store, by buckets of keys: each call to the store takes a turn between the
worker and the JVM, so rows and states of a bucket are kept in pieces of up to ten
thousand. A batch reads and writes only buckets that have rows or a timer in it.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import run_available

#: Buckets of keys, and rows or states of a piece.
BUCKETS, PIECE = 4096, 10_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key in the order of (at, event_id), `at` in microseconds; rows without an event_id are passed over.

    A fold gives `FIELDS` (what it needs of a row) and three methods: `step` takes a row, `due` names the time of what
    happens by itself, if anything, `lapse` lets it happen. What is due happens before
    rows that are later, and after rows of the same time.
    """

    FIELDS: str
    out: list[str]

    def step(self, kept: list, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self, kept: list) -> int | None:
        return None

    def lapse(self, kept: list) -> Iterator[tuple]:
        return iter(())

    def start(self) -> list:
        raise NotImplementedError

    def done(self, kept: list) -> bool:
        """Whether nothing of the key needs to be kept."""
        return False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # pieces by number: (key, at, event_id, fields), and (key, kept state)
        self.waiting = handle.getMapState("waiting", "piece long", "rows binary")
        self.kept = handle.getMapState("kept", "piece long", "states binary")
        #: The time of the timer, if there is one, and the number of the next piece of waiting rows.
        self.woken = handle.getValueState("woken", "at long, piece long")
        self.names = [f.split()[0] for f in self.FIELDS.split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, piece = self.woken.get() or (None, 0)
        first, held = None, []
        for r in rows:
            if r.event_id is not None:
                held.append((r[self.out[0]], r.at, r.event_id, *(r[n] for n in self.names)))
                first = r.at if first is None else min(first, r.at)
                if len(held) == PIECE:
                    self.waiting.updateValue((piece,), (pickle.dumps(held),))
                    piece, held = piece + 1, []
        if held:
            self.waiting.updateValue((piece,), (pickle.dumps(held),))
            piece += 1
        if first is not None:
            self._wake(first, at, piece)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        states = dict(self._read(self.kept))
        ready: dict = {}
        later: dict = {}
        for k, at, event, *values in self._read(self.waiting):  # in the order in which they came
            (ready.setdefault(k, {}) if at <= now else later.setdefault(k, {}))[at, event] = values
        passed = [k for k, kept in states.items() if k not in ready and (due := self.due(kept)) is not None and due < now]
        answer = Row(*self.out)
        for k in [*ready, *passed]:
            kept = states.pop(k, None) or self.start()
            for (at, event), values in sorted(ready.pop(k, {}).items(), key=lambda x: x[0]):
                while (due := self.due(kept)) is not None and due < at:
                    for told in self.lapse(kept):
                        yield answer(k, *told)
                for told in self.step(kept, Row(at=at, event_id=event, **dict(zip(self.names, values, strict=True)))):
                    yield answer(k, *told)
            while (due := self.due(kept)) is not None and due < now:
                for told in self.lapse(kept):
                    yield answer(k, *told)
            if not self.done(kept):
                states[k] = kept
        piece = self._write(self.waiting, [(k, at, event, *values) for k, held in later.items() for (at, event), values in held.items()])
        self._write(self.kept, list(states.items()))
        ahead = [at for held in later.values() for at, _ in held] + [due for kept in states.values() if (due := self.due(kept)) is not None]
        self.woken.clear()
        if ahead:
            self._wake(min(ahead), None, piece)

    def _read(self, pieces) -> Iterator[tuple]:
        for _, (held,) in sorted(pieces.iterator(), key=lambda x: x[0][0]):
            yield from pickle.loads(held)

    def _write(self, pieces, rows: list[tuple]) -> int:
        """Replace what is kept; gives the number of pieces."""
        pieces.clear()
        for n, k in enumerate(range(0, len(rows), PIECE)):
            pieces.updateValue((n,), (pickle.dumps(rows[k : k + PIECE]),))
        return -(-len(rows) // PIECE)

    def _wake(self, at: int, known: int | None, piece: int) -> None:
        """A timer at the first millisecond after a time, unless an earlier one is set."""
        at = at // 1000 + 1
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            known = at
        self.woken.update((known, piece))

    def close(self) -> None:
        pass


class Quota(InOrder):
    """Requests against the quota of each meter and a balance; a row without a meter is a top-up.

    The kept state is the balance and what is used of each meter.
    """

    FIELDS = "meter string, n long, amount long"

    def __init__(self, limits: Mapping[str, int], rates: Mapping[str, int]):
        self.limits, self.rates = dict(limits), dict(rates)

    def start(self) -> list:
        return [0, {}]

    def step(self, kept: list, row: Row) -> Iterator[tuple]:
        balance, used = kept[0], dict(kept[1])
        if row.meter is None:
            kept[0] = balance + row.amount
            return iter([(row.event_id, True, kept[0])])
        free = max(0, min(row.n, self.limits[row.meter] - used.get(row.meter, 0)))
        cost = (row.n - free) * self.rates[row.meter]
        if accepted := cost <= balance:
            kept[0], kept[1] = balance - cost, used | {row.meter: used.get(row.meter, 0) + row.n}
        return iter([(row.event_id, accepted, kept[0])])


class Orders(InOrder):
    """An order waits `seconds` for a payment of its price or a notice that it failed, and then expires.

    A payment of another amount, a notice before the order and one after it has ended
    change nothing. An order is forgotten when its time is over.
    """

    FIELDS = "kind string, amount long"

    def __init__(self, seconds: int):
        self.wait = seconds * 1_000_000

    def start(self) -> list:
        return [None, None, False]

    def due(self, kept: list) -> int | None:
        return kept[1]

    def done(self, kept: list) -> bool:
        return kept[1] is None

    def lapse(self, kept: list) -> Iterator[tuple]:
        deadline, ended = kept[1], kept[2]
        kept[:] = self.start()
        return iter([] if ended else [("expired", deadline)])

    def step(self, kept: list, row: Row) -> Iterator[tuple]:
        if row.kind == "created":
            if kept[1] is None:
                kept[:] = [row.amount, row.at + self.wait, False]
        elif kept[1] is not None and not kept[2] and (row.kind == "failed" or row.amount == kept[0]):
            kept[2] = True
            return iter([(row.kind, row.at)])
        return iter(())


class Plans(InOrder):
    """A purchase extends a running plan of its kind from its end, else it starts one now; a plan that ends is given out.

    The kept state is the plan and its end; a plan that another one takes the place of does not end by itself.
    """

    FIELDS = "plan string"

    def __init__(self, days: int = 30):
        self.days = days * 86_400_000_000

    def start(self) -> list:
        return [None, None]

    def due(self, kept: list) -> int | None:
        return kept[1]

    def done(self, kept: list) -> bool:
        return kept[1] is None

    def lapse(self, kept: list) -> Iterator[tuple]:
        ended = tuple(kept)
        kept[:] = self.start()
        return iter([ended])

    def step(self, kept: list, row: Row) -> Iterator[tuple]:
        begin = kept[1] if kept[1] is not None and kept[0] == row.plan and kept[1] > row.at else row.at
        kept[:] = [row.plan, begin + self.days]
        return iter(())


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Timers and map state need the store on disk; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_in_order(events: DataFrame, key: str, fold: InOrder, out: str, late: str = "1 day") -> DataFrame:
    """(key, fields of `out`): what a fold gives out over a stream with `ts` and `event_id`, run over what is there.

    A row that is more than `late` behind the latest `ts` of earlier batches is
    lost; of two rows with equal key, `ts` and event_id the later one counts.
    """
    kind = events.schema[key].dataType.simpleString()
    fold.out = [key, *(f.split()[0] for f in out.split(", "))]
    rows = events.withWatermark("ts", late).withColumns({"at": F.unix_micros("ts"), "__bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS))})
    told = rows.groupBy("__bucket").transformWithState(fold, f"`{key}` {kind}, {out}", "Append", "EventTime")
    with _state_store(events.sparkSession):
        return run_available(told, "append")


def with_payments(orders: DataFrame, payments: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Every order with each payment of its price in time; one without stays, with nulls, when the watermarks have passed its time.

    `orders` has order_id, price and ordered_at, `payments` has paid_order, amount and
    paid_at, both as streams. Each side is kept only as long as the other may still bring a partner.
    """
    o, p = orders.withWatermark("ordered_at", late), payments.withWatermark("paid_at", late)
    in_time = F.expr(f"paid_at >= ordered_at and paid_at <= ordered_at + interval {within}")
    return o.join(p, (F.col("order_id") == F.col("paid_order")) & (F.col("amount") == F.col("price")) & in_time, "left_outer")
