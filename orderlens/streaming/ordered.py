"""Velocity in event-time order, with running totals: each order is worked on once, however busy its store is.

Orders wait, by minute, until the watermark has passed their second; then nothing before them can come any more. They are taken
in order: an order adds itself to the totals of the hour and the day, what left the windows since the last order is taken off
again, and members (stores of a user, cards of a store and so on) are counted by a map from each to when it was last seen.
So a micro-batch reads the minutes that new orders fall into and those that leave a window, never the pair's whole day,
and every order is emitted once, with the features of the batch twin.

What comes behind the watermark doesn't get here. `missed_by` finds it in the order table, and `backfill` works out again,
for the pairs concerned, the day after each such order, whose windows hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import velocity as v

MINUTE = 60
TOTALS = ("orders_1h", "orders_24h", "spend_1h", "spend_24h", "decline_count_24h", "members_1", "members_2")


class InOrder(StatefulProcessor):
    """V1-V6, V8, V9, V11 with bounded work for each order.

    State of a pair: totals; orders of the last day and orders that still wait, both in a map by minute; when each member was last
    seen. Of equal seconds all orders count for each other, as in the batch twin. A timer takes waiting orders up when the watermark
    has passed them; a day after the last order it empties the windows and says so (order_id null); after `forget` seconds nothing is kept.
    """

    def __init__(self, forget: int = v.FORGET) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", ", ".join(f"{x} long" for x in (*TOTALS, "last_s", "hour_s", "day_s")))
        self.waiting = handle.getMapState("waiting", "minute long", "at array<long>, order_id array<string>, pence array<long>, declined array<boolean>, m1 array<string>, m2 array<string>")
        self.day = handle.getMapState("day", "minute long", "at array<long>, pence array<long>, declined array<boolean>, m1 array<string>, m2 array<string>")
        self.seen = handle.getMapState("seen", "place int, member string", "at_s long")

    def _add_waiting(self, rows: Iterator[pd.DataFrame]) -> None:
        by_minute: dict[int, list[tuple]] = {}
        for batch in rows:
            text = lambda c, b=batch: [None if pd.isna(x) else str(x) for x in b[c]]
            for row in zip((int(a) for a in batch["at_s"]), text("order_id"), (int(p) for p in batch["pence"]), (bool(d) for d in batch["declined"]), text("m1"), text("m2")):
                by_minute.setdefault(row[0] // MINUTE, []).append(row)
        for minute, new in by_minute.items():
            old = self.waiting.getValue((minute,)) if self.waiting.containsKey((minute,)) else ([],) * 6
            self.waiting.updateValue((minute,), tuple(list(a) + list(b) for a, b in zip(old, zip(*new))))

    def _ripe(self, upto: int) -> list[tuple]:
        """Waiting orders before the second `upto`, in order; those of its own minute that are later go on waiting."""
        out = []
        for minute in sorted(k[0] for k in self.waiting.keys()):
            if minute * MINUTE >= upto:
                break
            rows = list(zip(*self.waiting.getValue((minute,))))
            out += [r for r in rows if r[0] < upto]
            if rest := [r for r in rows if r[0] >= upto]:
                self.waiting.updateValue((minute,), tuple(map(list, zip(*rest))))
            else:
                self.waiting.removeKey((minute,))
        return sorted(out, key=lambda r: r[:2])

    def _timer(self, last_s: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            self.handle.registerTimer(1000 * (min(self.waiting.getValue((first,))[0]) + 1))
        elif last_s is not None:
            held = any(True for _ in self.day.keys())
            self.handle.registerTimer(1000 * (last_s + (v.DAY if held else self.forget) + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._add_waiting(rows)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timer_values) -> Iterator[pd.DataFrame]:
        now = timer_values.getCurrentWatermarkInMs() // 1000
        window = Windows(self, key[0])
        out = window.take(self._ripe(now))
        if window.last_s is not None and window.last_s < now - v.DAY and window.minutes:
            window.expire(now)
            out.append((None, now, None, *window.features()))
        window.store()
        if window.last_s is not None and window.last_s < now - self.forget and not any(True for _ in self.waiting.keys()):
            self.totals.clear()
            window.last_s = None
        self._timer(window.last_s)
        if out:
            order_id, at_s, age, *values = zip(*out)
            data = {"entity": key[0], "id": key[1], "order_id": order_id, "at_s": at_s, "last_order_age": age} | dict(zip([x for x in (*v.PLAIN, *v.COUNTS) if x != "last_order_age"], values))
            yield pd.DataFrame(data, columns=v.NAMES).astype({x: "Int64" for x in (*v.PLAIN, *v.COUNTS)})

    def close(self) -> None:
        pass


class Windows:
    """The windows of a pair while a micro-batch moves them on: what is read of the state is kept, what changed is written once."""

    def __init__(self, op: InOrder, entity: str) -> None:
        self.op, self.spans = op, [(name, span) for name, _, span in v.MEMBERS[entity]]
        held = op.totals.get() if op.totals.exists() else None
        *totals, self.last_s, self.hour_s, self.day_s = held if held else (0,) * len(TOTALS) + (None, 0, 0)
        self.t = dict(zip(TOTALS, totals))
        self.minutes = sorted(k[0] for k in op.day.keys())
        self.read: dict[int, list[tuple]] = {}
        self.changed: set[int] = set()
        self.members: dict[tuple, int | None] = {}
        self.moved: set[tuple] = set()

    def orders(self, minute: int) -> list[tuple]:
        if minute not in self.read:
            self.read[minute] = list(zip(*self.op.day.getValue((minute,))))
        return self.read[minute]

    def when(self, member: tuple) -> int | None:
        if member not in self.members:
            self.members[member] = self.op.seen.getValue(member)[0] if self.op.seen.containsKey(member) else None
        return self.members[member]

    def leave(self, frm: int, to: int, span: int) -> None:
        """Orders of [frm, to) leave the window of this span."""
        hour = span == v.HOUR
        for minute in [m for m in self.minutes if frm // MINUTE <= m <= (to - 1) // MINUTE]:
            for at, pence, declined, *members in self.orders(minute):
                if not frm <= at < to:
                    continue
                self.t["orders_1h" if hour else "orders_24h"] -= 1
                self.t["spend_1h" if hour else "spend_24h"] -= pence
                self.t["decline_count_24h"] -= 0 if hour else declined
                for i, (_, own) in enumerate(self.spans, 1):
                    member = (i, members[i - 1])
                    if own == span and members[i - 1] is not None and self.when(member) == at:
                        self.members[member] = None
                        self.moved.add(member)
                        self.t[f"members_{i}"] -= 1

    def expire(self, now: int) -> None:
        """Moves the windows on so that they end at `now`; minutes that no window needs are dropped."""
        if now - v.HOUR > self.hour_s:
            self.leave(self.hour_s, now - v.HOUR, v.HOUR)
            self.hour_s = now - v.HOUR
        if now - v.DAY > self.day_s:
            self.leave(self.day_s, now - v.DAY, v.DAY)
            self.day_s = now - v.DAY
            for minute in [m for m in self.minutes if (m + 1) * MINUTE <= self.day_s]:
                self.minutes.remove(minute)
                self.changed.add(minute)
                self.read[minute] = []

    def enter(self, at: int, pence: int, declined: bool, members: tuple) -> None:
        minute = at // MINUTE
        if minute not in self.minutes:
            self.minutes.append(minute)  # the latest
            self.read[minute] = []
        self.orders(minute).append((at, pence, declined, *members))
        self.changed.add(minute)
        for span in ("1h", "24h"):
            self.t[f"orders_{span}"] += 1
            self.t[f"spend_{span}"] += pence
        self.t["decline_count_24h"] += declined
        for i, member in enumerate(members[: len(self.spans)], 1):
            if member is not None:
                self.t[f"members_{i}"] += self.when((i, member)) is None
                self.members[i, member] = at
                self.moved.add((i, member))

    def features(self) -> tuple:
        """In the order of the output's columns."""
        counts = {name: self.t[f"members_{i}"] for i, (name, _) in enumerate(self.spans, 1)}
        return tuple(self.t[x] for x in v.PLAIN if x != "last_order_age") + tuple(counts.get(name) for name in v.COUNTS)

    def take(self, orders: list[tuple]) -> list[tuple]:
        """(order_id, at_s, age, *features) of each order; all orders of a second enter before any is looked at."""
        out, i = [], 0
        while i < len(orders):
            at, j = orders[i][0], i
            self.expire(at)
            while j < len(orders) and orders[j][0] == at:
                _, _, pence, declined, *members = orders[j]
                self.enter(at, pence, declined, tuple(members))
                j += 1
            values = self.features()
            for order in orders[i:j]:
                out.append((order[1], at, None if self.last_s is None else (at - self.last_s) // 60, *values))
                self.last_s = at
            i = j
        return out

    def store(self) -> None:
        for minute in self.changed:
            if rows := self.read[minute]:
                self.op.day.updateValue((minute,), tuple(map(list, zip(*rows))))
            elif self.op.day.containsKey((minute,)):
                self.op.day.removeKey((minute,))
        for member in self.moved:
            at = self.members[member]
            if at is not None:
                self.op.seen.updateValue(member, (at,))
            elif self.op.seen.containsKey(member):
                self.op.seen.removeKey(member)
        if self.last_s is not None:
            self.op.totals.update((*(self.t[x] for x in TOTALS), self.last_s, self.hour_s, self.day_s))


def velocity(pairs: DataFrame, forget: int = v.FORGET) -> DataFrame:
    """The features of each pair of a stream (with a watermark on ts) at each of its orders, once the watermark has passed it. Needs the RocksDB state store."""
    return pairs.groupBy("entity", "id").transformWithStateInPandas(InOrder(forget), v.FEATURES, "Update", "EventTime")


def missed_by(orders: DataFrame, features: DataFrame, low, high) -> DataFrame:
    """Orders of (low, high] without a row in what the stream wrote: they came behind the watermark, or never. Nulls in all entity keys: never missed."""
    return v.missed(orders.where(F.coalesce(*[F.col(k).cast("string") for k in v.KEYS.values()]).isNotNull()), features.where("order_id is not null"), low, high)


def backfill(orders: DataFrame, late: DataFrame) -> DataFrame:
    """Rows to upsert after `late` orders (they are in `orders` too): of each pair that has one, the late orders, all
    orders up to a day after one, whose windows hold it, and the next order after it, whose gap it changes.

    Read are the pairs of late orders only, from a day before their first late order on, and for the gap the last order before that.
    """
    pairs, of_late = v.fan_out(orders), v.fan_out(late)
    first = of_late.groupBy("entity", "id").agg((F.min("at_s") - v.DAY).alias("_from"))
    history = pairs.join(first, ["entity", "id"])
    rest = [c for c in pairs.columns if c not in ("entity", "id")]
    before = history.where("at_s < _from").groupBy("entity", "id").agg(F.max_by(F.struct(*rest), F.struct("at_s", "order_id")).alias("r")).select("entity", "id", "r.*")
    events = history.where("at_s >= _from").select(*pairs.columns).unionByName(before)
    marked = events.select("entity", "id", "order_id", "at_s").join(late.select("order_id", F.lit(True).alias("_late")).distinct(), "order_id", "left")
    of_pair = Window.partitionBy("entity", "id")
    after_late = F.coalesce(F.lag("_late").over(of_pair.orderBy("at_s", "order_id")), F.lit(False))
    last_late = F.max(F.when(F.col("_late"), F.col("at_s"))).over(of_pair.orderBy("at_s"))
    changed = marked.withColumn("_after", after_late).withColumn("_last", last_late).where(F.col("_after") | (F.col("_last") >= F.col("at_s") - v.DAY))
    return v.velocity_batch(events).join(changed.select("entity", "id", "order_id"), ["entity", "id", "order_id"], "left_semi").select(*v.NAMES)


def merged(features: DataFrame, fresh: DataFrame) -> DataFrame:
    """What the stream wrote, with the backfilled rows in the place of its own."""
    keys = ["entity", "id", "order_id"]
    old = features.where("order_id is not null").join(fresh.select(*keys), keys, "left_anti")
    return old.select(*v.NAMES).unionByName(fresh)
