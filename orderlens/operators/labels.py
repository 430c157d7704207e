"""Labels, archival, pruning, reconciliation and the order event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import cumulative

DAY = 86_400_000_000
TERMINAL = ("DELIVERED", "CANCELLED", "REFUNDED", "FAILED")
#: The states that may follow each state.
TRANSITIONS = (
    ("PLACED", "ACCEPTED"), ("PLACED", "CANCELLED"), ("ACCEPTED", "PREPARING"), ("PREPARING", "READY"), ("PREPARING", "CANCELLED"), ("READY", "PICKED_UP"),
    ("READY", "DELIVERED"), ("READY", "CANCELLED"), ("PICKED_UP", "IN_TRANSIT"), ("IN_TRANSIT", "DELIVERED"), ("IN_TRANSIT", "FAILED"),
)
# The chain of states of a delivered order.
CHAIN = ("PLACED", "ACCEPTED", "PREPARING", "READY", "PICKED_UP", "IN_TRANSIT", "DELIVERED")
PICKUP_CHAIN = tuple(s for s in CHAIN if s not in ("PICKED_UP", "IN_TRANSIT"))


def is_archivable(as_of: int, hours: int = 48, states: tuple[str, ...] = TERMINAL):
    """terminal, and for longer than the hours given."""
    return F.col("status").isin(*states) & (F.col("terminal_us") < as_of - hours * 3_600_000_000)


def is_open(as_of: int, days: int = 7):
    """F2."""
    return ~F.col("status").isin(*TERMINAL) & (F.col("placed_us") > as_of - days * DAY)


def archive_split(orders: DataFrame, children: dict[str, DataFrame], as_of: int, keys: tuple[str, ...] = ("order_id",)) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(cold, hot) of orders and each child table. Every row is in one of the two: semi and anti join on the same keys."""
    gone = orders.where(is_archivable(as_of))
    marks = gone.select(*keys)
    cold = {"orders": gone} | {k: v.join(marks, list(keys), "left_semi") for k, v in children.items()}
    hot = {"orders": orders.where(~F.coalesce(is_archivable(as_of), F.lit(False)))} | {k: v.join(marks, list(keys), "left_anti") for k, v in children.items()}
    return cold, hot


def archive(spark, orders: DataFrame, children: dict[str, DataFrame], cold_root: str, hot_root: str, as_of: int) -> DataFrame:
    """Writes cold and hot tables to new folders, checks that no row was lost or doubled, and reports the moves.

    The caller points its tables at the new folders afterwards; a run that fails before that changes nothing.
    """
    cold, hot = archive_split(orders, children, as_of)
    moved = []
    for name, source in ({"orders": orders} | children).items():
        cold[name].write.mode("overwrite").parquet(f"{cold_root}/{name}")
        hot[name].write.mode("overwrite").parquet(f"{hot_root}/{name}")
        n = spark.read.parquet(f"{cold_root}/{name}").count()
        if n + spark.read.parquet(f"{hot_root}/{name}").count() != source.count():
            raise RuntimeError(f"{name}: rows were lost or doubled")
        moved.append((name, n))
    return spark.createDataFrame(moved, "table string, moved long")


def archive_passes(orders: DataFrame, as_of: int, batch: int = 10_000, passes: int = 500) -> DataFrame:
    """What throttled archive passes move: archivable orders with their pass, oldest first, until none is left or the passes are over."""
    gone = orders.where(is_archivable(as_of))
    times = cumulative(gone.groupBy("terminal_us").agg(F.count(F.lit(1)).alias("n")), "terminal_us", ["n"]).select("terminal_us", (F.col("upto_n") - F.col("n")).alias("_before"))
    tie = F.row_number().over(Window.partitionBy("terminal_us").orderBy("order_id")) - 1
    numbered = gone.withColumn("_tie", tie).join(times, "terminal_us").withColumn("pass", F.floor((F.col("_before") + F.col("_tie")) / batch))
    return numbered.where(F.col("pass") < passes).drop("_before", "_tie")


def outcomes(orders: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """L1: chargebacks turn into outcome columns."""
    cb = chargebacks.select("order_id", F.col("category").alias("cb_category"), F.col("received_us").alias("cb_received_us"), F.col("amount_pence").alias("cb_pence"))
    fraud = F.col("cb_category") == "FRAUD"
    out = orders.join(cb, "order_id", "left")
    return out.withColumn("category", F.when(fraud, "FRAUD").when(F.col("cb_category").isNotNull(), "OTHER")).withColumn("outcome", F.when(fraud, "CHARGEBACK").when(F.col("cb_category").isNotNull(), "LEGIT"))


def finalise(labelled: DataFrame, refunds: DataFrame, as_of: int, days: int = 60) -> DataFrame:
    """Delivered long ago without an outcome: abuse if refunded, else legit."""
    out = labelled.join(refunds.select("order_id", F.lit(True).alias("_refunded")), "order_id", "left")
    stale = (F.col("status") == "DELIVERED") & (F.col("terminal_us") < as_of - days * DAY) & F.col("outcome").isNull()
    return out.withColumn("outcome", F.when(stale, F.when(F.col("_refunded"), "REFUND_ABUSE").otherwise("LEGIT")).otherwise(F.col("outcome"))).drop("_refunded")


def chargeback_candidates(orders: DataFrame, chargebacks: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """L4: delivered lately, without an outcome (a column `outcome`, where there is one) and not charged back."""
    fresh = orders.where((F.col("status") == "DELIVERED") & (F.col("terminal_us") >= as_of - days * DAY))
    fresh = fresh.where("outcome is null") if "outcome" in orders.columns else fresh
    return fresh.join(chargebacks.select("order_id"), "order_id", "left_anti")


def training_labels(orders: DataFrame, truth: DataFrame) -> DataFrame:
    """Orders without truth are legit."""
    t = truth.select("order_id", F.col("is_fraud").alias("t_fraud"), F.col("category").alias("t_category"))
    out = orders.join(t, "order_id", "left")
    return out.withColumn("is_fraud", F.coalesce("t_fraud", F.lit(False))).withColumn("fraud_category", F.coalesce("t_category", F.lit("LEGIT"))).drop("t_fraud", "t_category")


def business_label(category, outcome):
    """L6."""
    return F.coalesce(category == "FRAUD", F.lit(False)) | F.coalesce(outcome.isin("FRAUD", "CHARGEBACK", "REFUND_ABUSE", "PROMO_ABUSE"), F.lit(False))


def chargeback_audit(orders: DataFrame, truth: DataFrame, chargebacks: DataFrame, expected: DataFrame) -> DataFrame:
    """Chargeback rate and mean delay in days by category, beside what was expected."""
    rows = training_labels(orders, truth).join(chargebacks.select("order_id", "received_us"), "order_id", "left")
    got = rows.groupBy("fraud_category").agg(
        F.count(F.lit(1)).alias("orders"), F.count("received_us").alias("chargebacks"), F.round(F.avg((F.col("received_us") - F.col("placed_us")) / DAY), 4).alias("delay_days")
    )
    out = got.join(F.broadcast(expected), "fraud_category", "left").withColumn("observed_rate", F.round(F.col("chargebacks") / F.col("orders"), 6))
    return out.withColumn("difference", F.round(F.col("observed_rate") - F.col("expected_rate"), 6))


def status_times(log: DataFrame) -> DataFrame:
    """First time of each state as a column, and the terminal time."""
    first = [F.min(F.when(F.col("event_type") == s, F.col("at_us"))).alias(f"{s.lower()}_us") for s in ("ACCEPTED", "READY", "PICKED_UP", "DELIVERED", "CANCELLED")]
    return log.groupBy("order_id").agg(*first, F.min(F.when(F.col("event_type").isin(*TERMINAL), F.col("at_us"))).alias("terminal_us"))


def current_state(log: DataFrame, as_of: int, days: int | None = None) -> DataFrame:
    """Last state of each order and minutes in it; days: only events of so many days before as_of."""
    recent = log if days is None else log.where((F.col("at_us") >= as_of - days * DAY) & (F.col("at_us") <= as_of))
    last = recent.groupBy("order_id").agg(F.max(F.struct("at_us", "event_type")).alias("l"))
    return last.select("order_id", F.col("l.event_type").alias("state"), F.floor((F.lit(as_of) - F.col("l.at_us")) / 60_000_000).alias("minutes"))


def stage_durations(log: DataFrame) -> DataFrame:
    """Seconds from each event to the next of its order."""
    after = F.lead("at_us").over(Window.partitionBy("order_id").orderBy("at_us", "event_type"))
    return log.withColumn("seconds", ((after - F.col("at_us")) / 1_000_000).cast("long"))


def invalid_transitions(spark, log_with_previous: DataFrame) -> DataFrame:
    """Events that may not follow the one before; a first event must be PLACED."""
    allowed = spark.createDataFrame(TRANSITIONS, "previous string, event_type string")
    steps = log_with_previous.where(F.col("previous").isNotNull() | (F.col("event_type") != "PLACED"))
    return steps.join(F.broadcast(allowed), ["previous", "event_type"], "left_anti")


def chain_gaps(log: DataFrame, chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """States of the chain that delivered orders never had."""
    seen = log.groupBy("order_id").agg(F.collect_set("event_type").alias("seen"))
    gaps = F.array_except(F.array(*[F.lit(s) for s in chain]), "seen")
    return seen.where(F.array_contains("seen", "DELIVERED")).select("order_id", gaps.alias("missing")).where(F.size("missing") > 0)


def prune_window(tables: dict[str, DataFrame], start: int, end: int) -> dict[str, DataFrame]:
    """All tables without the orders placed in a window and what hangs on them."""
    gone = tables["orders"].where((F.col("placed_us") >= start) & (F.col("placed_us") < end)).select("order_id")
    return {k: v.join(gone, "order_id", "left_anti") for k, v in tables.items()}


def overwrite_window(tables: dict[str, DataFrame], fresh: dict[str, DataFrame], start: int, end: int, payments: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables with the window's orders, and what hangs on them, replaced by fresh ones; payments that no order has any more go."""
    if fresh["orders"].where(~F.col("placed_us").between(start, end - 1)).limit(1).count():
        raise ValueError("fresh orders outside the window")
    out = {k: v.unionByName(fresh[k]) if k in fresh else v for k, v in prune_window(tables, start, end).items()}
    if payments is not None:
        out["payments"] = payments.join(out["orders"].select("payment_id"), "payment_id", "left_semi")
    return out


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children without a parent."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def cart_rollup(items: DataFrame) -> DataFrame:
    """Subtotal, counts and VAT (half up by line) of each order."""
    from ..functions.columns import vat

    line = F.col("quantity") * F.col("unit_pence")
    return items.groupBy("order_id").agg(
        F.sum(line).alias("subtotal"), F.sum("quantity").alias("item_count"), F.count_distinct("item_id").alias("unique_items"), F.sum(vat(line, F.col("is_hot"))).alias("vat")
    )


def reconcile(orders: DataFrame, carts: DataFrame) -> DataFrame:
    """Orders whose total isn't their items' subtotal and VAT."""
    both = orders.join(carts, "order_id")
    return both.where(F.col("total_pence") != F.col("subtotal") + F.col("vat")).withColumn("difference", F.col("total_pence") - F.col("subtotal") - F.col("vat"))


def undecided(orders: DataFrame, decisions: DataFrame) -> DataFrame:
    """Orders that don't have exactly one decision, with their number; decisions of unknown orders too, with `known` false."""
    count = decisions.groupBy("order_id").agg(F.count(F.lit(1)).alias("decisions"))
    both = orders.select("order_id", F.lit(True).alias("known")).join(count, "order_id", "full").fillna(0, ["decisions"]).fillna(False, ["known"])
    return both.where((F.col("decisions") != 1) | ~F.col("known"))
