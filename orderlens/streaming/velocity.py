"""Streaming velocity of six entities: one keyed stateful operator over a fan-out of each order.

Orders are read as a stream, malformed ones set aside, repeats dropped within the watermark, and fanned out to
(entity, id) pairs; a processor holds each pair's events of the day before the watermark and emits its features at
each order. Windows are event-time, both ends inclusive, the order itself counted, in whole seconds. An order that comes
late changes the features of later ones, which are emitted again; sinks keep the last row of an (entity, id, order).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sketches, windows
from ..sources.io import checkpointed

HOUR, DAY = 3600, 86400
#: Seconds after which a silent pair's last order is forgotten.
FORGET = 30 * DAY
ORDER = "order_id string, user_id string, store_id string, device_id string, payment_id string, address_id string, ip string, total_pence string, status string, placed_at string"
#: entity -> (name of a member count, member column, seconds); orders and spend are common to all.
MEMBERS = {
    "user": (("stores_24h", "store_id", DAY), ("payments_24h", "payment_id", DAY)), "device": (("users_24h", "user_id", DAY), ("payments_24h", "payment_id", DAY)),
    "payment": (("users_24h", "user_id", DAY),), "ip": (("users_24h", "user_id", DAY), ("devices_24h", "device_id", DAY)),
    "store": (("users_24h", "user_id", DAY), ("cards_1h", "payment_id", HOUR)), "address": (("users_24h", "user_id", DAY),),
}
KEYS = {"user": "user_id", "device": "device_id", "payment": "payment_id", "ip": "ip", "store": "store_id", "address": "address_id"}
COUNTS = ("stores_24h", "payments_24h", "users_24h", "devices_24h", "cards_1h")
PLAIN = ("orders_1h", "orders_24h", "spend_1h", "spend_24h", "last_order_age", "decline_count_24h")
FEATURES = "entity string, id string, order_id string, at_s long, " + ", ".join(f"{x} long" for x in (*PLAIN, *COUNTS))
NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def read_orders(spark: SparkSession, path: str, schema: str = ORDER, files_per_trigger: int = 100) -> DataFrame:
    """The stream of new orders."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parsed(raw: DataFrame) -> DataFrame:
    """Typed columns and `bad`: what doesn't parse."""
    out = raw.withColumn("ts", F.col("placed_at").try_cast("timestamp")).withColumn("pence", F.col("total_pence").try_cast("long"))
    return out.withColumn("bad", F.col("order_id").isNull() | F.col("ts").isNull() | F.col("pence").isNull())


def deduplicated(orders: DataFrame, delay: str = "20 minutes") -> DataFrame:
    """An order counts once, if its copies come within the delay."""
    return orders.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["order_id"])


def enriched(ids: DataFrame, orders: DataFrame) -> DataFrame:
    """A stream of order ids joined with the order table."""
    return ids.join(orders, "order_id")


def missed(orders: DataFrame, done: DataFrame, low, high) -> DataFrame:
    """S3: orders of (low, high] that weren't processed."""
    return orders.where((F.col("ts") > F.lit(low)) & (F.col("ts") <= F.lit(high))).join(done.select("order_id"), "order_id", "left_anti")


def fan_out(orders: DataFrame) -> DataFrame:
    """V7: a row per entity that the order has, with its members m1 and m2 for that entity."""
    member = lambda e, i: F.col(MEMBERS[e][i][1]).cast("string") if i < len(MEMBERS[e]) else F.lit(None).cast("string")
    pairs = [F.when(F.col(k).isNotNull(), F.struct(F.lit(e).alias("entity"), F.col(k).cast("string").alias("id"), member(e, 0).alias("m1"), member(e, 1).alias("m2"))) for e, k in KEYS.items()]
    rows = orders.withColumn("pair", F.explode(F.array_compact(F.array(*pairs))))
    return rows.select("pair.*", "order_id", F.unix_seconds("ts").alias("at_s"), "pence", F.coalesce(F.col("status") == "DECLINED", F.lit(False)).alias("declined"), "ts")


class Day:
    """Events of a pair in order of (at_s, order_id) as arrays, and features at any of them."""

    def __init__(self, entity: str, events: list[tuple]) -> None:
        self.entity, self.events = entity, sorted(events, key=lambda e: e[:2])
        self.at = np.array([e[0] for e in self.events], np.int64)
        total = lambda i: np.concatenate(([0], np.cumsum([int(e[i]) for e in self.events], dtype=np.int64)))
        self.pence, self.declined = total(2), total(3)

    def members(self, i: int, span: int, at: np.ndarray) -> np.ndarray:
        """Distinct members seen in the span up to each time: each is in from its first event to `span` after its last one, overlapping stays joined."""
        seen = sorted((m, t) for t, m in ((e[0], e[4 + i]) for e in self.events) if m is not None)
        names, times = [m for m, _ in seen], np.array([t for _, t in seen], np.int64)
        same = np.array([a == b for a, b in zip(names, names[1:])], bool) & (np.diff(times) <= span)
        comes = times[np.concatenate(([True], ~same))[: len(times)]]
        leaves = times[np.concatenate((~same, [True]))[: len(times)]] + span + 1
        return np.searchsorted(np.sort(comes), at, "right") - np.searchsorted(np.sort(leaves), at, "right")

    def features(self, at: np.ndarray) -> dict[str, list]:
        """At each time: what the windows that end there hold."""
        hi, hour, day = np.searchsorted(self.at, at, "right"), np.searchsorted(self.at, at - HOUR, "left"), np.searchsorted(self.at, at - DAY, "left")
        counts = {name: self.members(i, span, at).tolist() for i, (name, _, span) in enumerate(MEMBERS[self.entity])}
        plain = {"orders_1h": hi - hour, "orders_24h": hi - day, "spend_1h": self.pence[hi] - self.pence[hour], "spend_24h": self.pence[hi] - self.pence[day], "decline_count_24h": self.declined[hi] - self.declined[day]}
        return {k: v.tolist() for k, v in plain.items()} | {name: counts.get(name, [None] * len(at)) for name in COUNTS}


class Velocity(StatefulProcessor):
    """A pair's events as list state, from a day before the watermark on; of older ones the last stays for the gap, until it is forgotten.

    An event-time timer trims a silent pair and emits its features as of the watermark (order_id null).
    """

    def __init__(self, forget: int = FORGET) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at_s long, order_id string, pence long, declined boolean, m1 string, m2 string")

    def _held(self) -> list[tuple]:
        return [tuple(e) for e in self.events.get()] if self.events.exists() else []

    def _keep(self, day: Day, watermark: int) -> list[tuple]:
        """What can still matter, and a timer for when the oldest of it can't; an empty list clears the state."""
        old = int(np.searchsorted(day.at, watermark - DAY, "left"))
        kept = day.events[max(0, old - 1) :]
        if kept and kept[-1][0] < watermark - self.forget:
            kept = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            young = [e for e in kept if e[0] >= watermark - DAY]
            self.handle.registerTimer(1000 * (young[0][0] + DAY + 1 if young else kept[-1][0] + self.forget + 1))
        return kept

    def _frame(self, key: tuple, ids: list, at: list, ages: list, features: dict[str, list]) -> pd.DataFrame:
        data = {"entity": key[0], "id": key[1], "order_id": ids, "at_s": at, "last_order_age": ages} | features
        return pd.DataFrame(data, columns=NAMES).astype({x: "Int64" for x in (*PLAIN, *COUNTS)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            text = lambda c, b=batch: [None if pd.isna(x) else str(x) for x in b[c]]
            new += zip((int(a) for a in batch["at_s"]), text("order_id"), (int(p) for p in batch["pence"]), (bool(d) for d in batch["declined"]), text("m1"), text("m2"))
        held = self._held()
        day = Day(key[0], held + new)
        first, last = min(e[0] for e in new), max(e[0] for e in new)
        lo, hi = int(np.searchsorted(day.at, first, "left")), int(np.searchsorted(day.at, last + DAY, "right"))
        ages = [None if i == 0 else int(day.at[i] - day.at[i - 1]) // 60 for i in range(lo, hi)]
        yield self._frame(key, [e[1] for e in day.events[lo:hi]], day.at[lo:hi].tolist(), ages, day.features(day.at[lo:hi]))
        kept = self._keep(day, timerValues.getCurrentWatermarkInMs() // 1000)
        if len(kept) == len(day.events):
            self.events.appendList(new)
        elif kept:
            self.events.put(kept)
        else:
            self.events.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, day = timerValues.getCurrentWatermarkInMs() // 1000, Day(key[0], self._held())
        kept = self._keep(day, now)
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        yield self._frame(key, [None], [now], [None], day.features(np.array([now], np.int64)))

    def close(self) -> None:
        pass


def velocity(pairs: DataFrame, forget: int = FORGET) -> DataFrame:
    """The stateful operator over pairs with a watermark on ts; needs the RocksDB state store. Rows are updates: the last one of an (entity, id, order_id) holds."""
    return pairs.groupBy("entity", "id").transformWithStateInPandas(Velocity(forget), FEATURES, "Update", "EventTime")


def _member_events(pairs: DataFrame) -> DataFrame:
    """(entity, id, _at, n1, n2): a member of a pair comes in (1) or leaves (-1)."""
    span = F.lit(None).cast("long")
    for entity, members in MEMBERS.items():
        for i, (_, _, seconds) in enumerate(members, 1):
            span = F.when((F.col("entity") == entity) & (F.col("j") == i), seconds).otherwise(span)
    each = F.array(*[F.struct(F.lit(i).alias("j"), F.col(f"m{i}").alias("member")) for i in (1, 2)])
    long = pairs.select("entity", "id", "at_s", F.inline(each)).where("member is not null").withColumn("span", span)
    seen = windows.linked(long, ["entity", "id", "j", "member"], "at_s", DAY)
    comes, leaves = windows.presence("at_s", F.col("span"), 1)
    events = F.array(F.struct(F.col("at_s").alias("_at"), comes.cast("long").alias("n")), F.struct(leaves.alias("_at"), F.lit(-1).cast("long").alias("n")))
    out = seen.select("entity", "id", "j", F.inline(events)).where("_at is not null and n != 0")
    return out.select("entity", "id", "_at", *[F.when(F.col("j") == i, F.col("n")).otherwise(0).alias(f"n{i}") for i in (1, 2)])


def _counts() -> list[Column]:
    """The member counts by name, from n1 and n2."""
    out = []
    for name in COUNTS:
        of = [(e, i) for e, members in MEMBERS.items() for i, m in enumerate(members, 1) if m[0] == name]
        value = F.lit(None).cast("long")
        for e, i in of:
            value = F.when(F.col("entity") == e, F.col(f"upto_n{i}")).otherwise(value)
        out.append(value.alias(name))
    return out


def velocity_batch(pairs: DataFrame) -> DataFrame:
    """The same features over a bounded table, as running sums of events: the batch twin, and what backfills use."""
    sums = ["o1", "o24", "s1", "s24", "dec", "n1", "n2"]
    t, pence, declined, zero = F.col("at_s"), F.col("pence"), F.col("declined").cast("long"), F.lit(0)
    event = lambda at, own, *values: F.struct(at.alias("_at"), F.lit(own).alias("_own"), *[v.cast("long").alias(s) for v, s in zip(values, sums)])
    one = F.lit(1)
    changes = F.array(
        event(t, True, one, one, pence, pence, declined, zero, zero), event(t + HOUR + 1, False, -one, zero, -pence, zero, zero, zero, zero),
        event(t + DAY + 1, False, zero, -one, zero, -pence, -declined, zero, zero),
    )
    before = windows.linked(pairs.select("entity", "id", "order_id", "at_s", "pence", "declined"), ["entity", "id"], "at_s", DAY, ("order_id",))
    rows = before.select("entity", "id", "order_id", "at_s", "_previous", F.inline(changes))
    # Sums read the events twice.
    events = checkpointed(rows.unionByName(_member_events(pairs), allowMissingColumns=True).fillna(0, sums))
    out = windows.running(events, ["entity", "id"], "_at", sums, DAY).where("_own")
    named = dict(zip(("o1", "o24", "s1", "s24", "dec"), ("orders_1h", "orders_24h", "spend_1h", "spend_24h", "decline_count_24h")))
    age = F.floor((t - F.col("_previous")) / 60).alias("last_order_age")
    return out.select("entity", "id", "order_id", "at_s", *[F.col(f"upto_{s}").alias(x) for s, x in named.items()], age, *_counts()).select(*NAMES)


def current(pairs: DataFrame, as_of_s: int) -> DataFrame:
    """Features of each pair as of a moment; pairs without an order in the day before it have expired. last_order_age: between the last two orders of the day."""
    day = pairs.where((F.col("at_s") >= as_of_s - DAY) & (F.col("at_s") <= as_of_s))
    hour = F.col("at_s") >= as_of_s - HOUR
    # Distinct members by grouping first: no list or set of a hot pair is held anywhere.
    each = F.array(*[F.struct(F.lit(i).alias("j"), F.col(f"m{i}").alias("member")) for i in (1, 2)])
    distinct = day.select("entity", "id", hour.alias("hour"), F.inline(each)).where("member is not null").groupBy("entity", "id", "j", "member").agg(F.max("hour").alias("hour"))
    spans = {(e, i): (n, s) for e, members in MEMBERS.items() for i, (n, _, s) in enumerate(members, 1)}
    counts = [F.count(F.when(_any([(F.col("entity") == e) & (F.col("j") == i) & (F.col("hour") if s == HOUR else F.lit(True)) for (e, i), (n, s) in spans.items() if n == name]), 1)).alias(name) for name in COUNTS]
    sums = day.groupBy("entity", "id").agg(
        F.count(F.when(hour, 1)).alias("orders_1h"), F.count(F.lit(1)).alias("orders_24h"), F.coalesce(F.sum(F.when(hour, F.col("pence"))), F.lit(0)).alias("spend_1h"),
        F.sum("pence").alias("spend_24h"), F.sum(F.col("declined").cast("long")).alias("decline_count_24h"),
    )
    last = day.withColumn("n", F.row_number().over(Window.partitionBy("entity", "id").orderBy(F.desc("at_s"), F.desc("order_id")))).where("n <= 2")
    ages = last.groupBy("entity", "id").agg(F.when(F.count(F.lit(1)) == 2, F.floor((F.max("at_s") - F.min("at_s")) / 60)).alias("last_order_age"))
    out = sums.join(distinct.groupBy("entity", "id").agg(*counts), ["entity", "id"], "left").join(ages, ["entity", "id"])
    return out.fillna(0, list(COUNTS))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def relations(features: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """The stream relations of a feature vector, by entity, from rows of (entity, id, features)."""
    return {(e, "stream"): features.where(F.col("entity") == e).withColumnRenamed("id", k) for e, k in KEYS.items()}


def per_minute(rows: DataFrame, when: str, by: str, size: str = "1 minute") -> DataFrame:
    """Tumbling counts; the same call on a stream or a table."""
    return rows.groupBy(F.window(when, size).alias("w"), by).count().select(F.unix_micros("w.start").alias("start_us"), by, "count")


MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def _micros(span: str) -> int:
    """Of a span such as "10 seconds"."""
    number, unit = span.split()
    return int(number) * MICROS[unit.removesuffix("s")]


def rolling(rows: DataFrame, when: str, value: str, size: str = "1 minute", step: str = "10 seconds") -> DataFrame:
    """Sliding rate and 99th percentile. Exact on a table; on a stream, whose state mustn't hold all values, an approximation (monitoring only)."""
    if rows.isStreaming:
        return rows.groupBy(F.window(when, size, step).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx(value, 0.99, 10_000).alias("p99")).select(F.unix_micros("w.start").alias("start_us"), "rows", "p99")
    span, each = _micros(size), _micros(step)
    pane = math.gcd(span, each)
    return sketches.sliding_exact(sketches.counted(rows, F.unix_micros(when), value, pane), pane, span, each, 0.99).withColumnRenamed("value", "p99")


def start(features: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Hands each micro-batch to `sink(df, batch_id)`; progress is in the checkpoint, so restarts repeat no committed batch."""
    return features.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def dead_letters(raw: DataFrame, path: str, checkpoint: str):
    """What doesn't parse, as JSON lines, while the good rows go on."""
    bad = parsed(raw).where("bad").select(*raw.columns)
    return bad.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
