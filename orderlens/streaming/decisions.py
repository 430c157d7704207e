"""Decisions on the stream, one an order: its feature rows are gathered, then rules and model score make an audit row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import score
from ..operators.assemble import assemble
from .velocity import FEATURES, KEYS, NAMES, relations

#: Names of the vector's fields in the rules' context.
CONTEXT = {"user_orders_1h": "user_orders_1h", "device_orders_1h": "device_orders_1h", "user_account_age_days": "account_age_days", "user_lifetime_chargeback_count": "chargeback_count"}


def rule_context(vectors: DataFrame) -> DataFrame:
    """An assembled vector as the rules read it; fields that the order's own columns bring stay."""
    return vectors.withColumnsRenamed({k: v for k, v in CONTEXT.items() if k != v})


def of_orders(orders: DataFrame, velocity: DataFrame, batch: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Vectors of the orders of a micro-batch: stream features at each order, batch features of its entities.

    Stream rows are joined by order and entity, since they are as of that order; batch rows by entity.
    """
    # One row an order: the entity's key stands for the order in its stream relation.
    keyed = orders.withColumns({f"_{e}": F.concat_ws(":", "order_id", F.col(k).cast("string")) for e, k in KEYS.items()})
    stream = relations(velocity.where("order_id is not null").withColumn("id", F.concat_ws(":", "order_id", "id")))
    ids = {e: f"_{e}" for e in KEYS}
    out = keyed
    for (entity, _), table in stream.items():
        fields = F.struct(*[c for c in table.columns if c not in ("entity", KEYS[entity], "order_id", "at_s")]).alias(f"s_{entity}")
        out = out.join(table.select(F.col(KEYS[entity]).alias(ids[entity]), fields), ids[entity], "left")
    vectors = assemble(out.drop(*ids.values()), batch)
    return vectors


def decide(orders: DataFrame, velocity: DataFrame, batch: dict[tuple[str, str], DataFrame], model_score: Column, bins: tuple[str, ...] = ()) -> DataFrame:
    """Decisions for the orders of a micro-batch."""
    rows = of_orders(orders, velocity, batch)
    rows = rows.withColumn("user_orders_1h", F.coalesce("s_user.orders_1h", F.lit(0))).withColumn("device_orders_1h", F.coalesce("s_device.orders_1h", F.lit(0)))
    rows = rule_context(rows).withColumn("score", model_score)
    return score.decide(score.with_rules(rows, score.rules(bins)))


class Gather(StatefulProcessor):
    """An order's feature rows, gathered until the order is decided, once.

    An order and its rows come in any order and in any number of micro-batches. With `wait` "complete" it is decided as soon as all its
    pairs have a row; with "watermark", when nothing can change its features any more, with the last row of each pair. In both cases a timer
    decides it when the watermark has passed it by `patience` seconds, with what is there. Rows that come after that change
    nothing; that it was decided is kept for `remember` seconds more.
    """

    def __init__(self, wait: str, patience: int, remember: int) -> None:
        self.wait, self.patience, self.remember = wait, patience, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "entity string", "id string, features string")
        self.order = handle.getValueState("order", "pairs int, at_ms long, decided boolean")

    def _again_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def _decided(self, key: tuple, pairs: int | None, at_ms: int) -> Iterator[pd.DataFrame]:
        rows = {k[0]: value for k, value in self.rows.iterator()}
        yield pd.DataFrame({"order_id": [key[0]], "at_ms": [at_ms], "pairs": pd.array([pairs], "Int32"), "entities": [sorted(rows)], "features": [[rows[e][1] for e in sorted(rows)]]})
        self.rows.clear()
        self.order.update((pairs, at_ms, True))
        self._again_at(at_ms + 1000 * (self.patience + self.remember))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pairs, at_ms, decided = self.order.get() if self.order.exists() else (None, None, False)
        if decided:
            return
        for batch in rows:
            for entity, id_, features, n, at in zip(batch["entity"], batch["id"], batch["features"], batch["pairs"], batch["at_ms"]):
                at_ms = int(at)
                if pd.isna(entity):
                    pairs = int(n)
                else:
                    self.rows.updateValue((entity,), (id_, features))
        if self.wait == "complete" and pairs is not None and sum(1 for _ in self.rows.keys()) >= pairs:
            yield from self._decided(key, pairs, at_ms)
        else:
            self.order.update((pairs, at_ms, False))
            self._again_at(at_ms + 1000 * self.patience + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pairs, at_ms, decided = self.order.get()
        if decided:
            self.order.clear()
        else:
            yield from self._decided(key, pairs, at_ms)

    def close(self) -> None:
        pass


def gathered(orders: DataFrame, features: DataFrame, delay: str = "20 minutes", wait: str = "complete", patience: int = 0, remember: int = 86_400) -> DataFrame:
    """From the streams of orders (order_id, ts, the entities' keys) and of their feature rows: a row (order_id, at_ms, pairs,
    entities, features) an order, once. Both streams get a watermark of `delay`; rows without an order id are left out. Needs the RocksDB state store.
    """
    if wait not in ("complete", "watermark"):
        raise ValueError("wait is complete or watermark")
    has = [F.col(k).isNotNull().cast("int") for k in KEYS.values()]
    heads = orders.where("order_id is not null and ts is not null").select("order_id", "ts", sum(has[1:], has[0]).alias("pairs"))
    values = F.to_json(F.struct(*[c for c in NAMES if c not in ("entity", "id", "order_id")]))
    rows = features.where("order_id is not null").select("order_id", F.timestamp_seconds("at_s").alias("ts"), "entity", "id", values.alias("features"))
    both = heads.withWatermark("ts", delay).unionByName(rows.withWatermark("ts", delay), allowMissingColumns=True)
    both = both.select("order_id", "ts", "entity", "id", "features", "pairs", F.unix_millis("ts").alias("at_ms"))
    return both.groupBy("order_id").transformWithStateInPandas(Gather(wait, patience, remember), "order_id string, at_ms long, pairs int, entities array<string>, features array<string>", "Append", "EventTime")


def feature_rows(gathered_orders: DataFrame, orders: DataFrame) -> DataFrame:
    """The gathered rows as (entity, id, order_id, features): what `decide` reads."""
    each = gathered_orders.select("order_id", F.explode(F.arrays_zip("entities", "features")).alias("r")).select("order_id", F.col("r.entities").alias("entity"), F.from_json("r.features", ", ".join(x for x in FEATURES.split(", ") if x.split()[0] not in ("entity", "id", "order_id"))).alias("f"))
    keys = F.create_map(*[x for e, k in KEYS.items() for x in (F.lit(e), F.col(k).cast("string"))])
    ids = orders.select("order_id", F.explode(keys).alias("entity", "id"))
    return each.join(ids, ["order_id", "entity"]).select("entity", "id", "order_id", "f.*")


def sink(orders: DataFrame, batch: dict[tuple[str, str], DataFrame], model_score: Column, path: str, bins: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """For `velocity.start` of `gathered` orders: writes their audit rows, a folder a micro-batch, so that a repeated batch overwrites itself."""

    def write(ready: DataFrame, batch_id: int) -> None:
        ready = ready.select("order_id", "entities", "features").persist()
        mine = orders.join(ready.select("order_id"), "order_id", "left_semi")
        decided = decide(mine, feature_rows(ready, mine), batch, model_score, bins)
        features = ["total_pence", "user_orders_1h", "device_orders_1h", "account_age_days", "chargeback_count"]
        score.audit(decided, features, F.current_timestamp()).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        ready.unpersist()

    return write
