"""Window features, exact about ties and bounds, as running sums of events.

Times are microseconds. An order adds to a sum when it happens and, where the window trails, is taken off again
when it leaves; so no window frame slides and no set is rebuilt for each row. Sums are two-level: within slots of
time, and over the totals of the slots before; so a hot key is spread over as many tasks as it has slots. Rows
with a null key are keys of their own, which spreads them too; their features are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000

_past = Window.unboundedPreceding


def running(events: DataFrame, keys: list[str | Column], when: str, values: list[str], slot: int | Column = DAY, descending: bool = False) -> DataFrame:
    """events with before_v and upto_v for each of the values: its sum over the same keys at earlier times, and up to the row's time.

    slot: how long the slots are, or a column that numbers them in order (of descending `when`, if told to; then there is no before_v).
    """
    cut = events.withColumn("_k", F.struct(*keys)).withColumn("_slot", slot if isinstance(slot, Column) else F.floor(F.col(when) / F.lit(slot)))
    totals = cut.groupBy("_k", "_slot").agg(*[F.sum(v).alias(v) for v in values])
    past = Window.partitionBy("_k").orderBy("_slot").rowsBetween(_past, -1)
    offsets = totals.select("_k", "_slot", *[F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"_o_{v}") for v in values])
    within = Window.partitionBy("_k", "_slot").orderBy(F.desc(when) if descending else F.asc(when))
    frames = {"upto": within.rangeBetween(_past, 0)} | ({} if descending else {"before": within.rangeBetween(_past, -1)})
    sums = [(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(f"{name}_{v}") for name, w in frames.items() for v in values]
    return cut.join(offsets, ["_k", "_slot"]).select(*events.columns, *sums)


def cumulative(counts: DataFrame, order: str, values: list[str], by: tuple[str, ...] = (), descending: bool = False, parts: int = 64) -> DataFrame:
    """counts (a row a value of `order` and group) with upto_v, the sum of v up to the row, and whole_v, the group's sum.

    The order is cut into `parts` ranges at quantiles of a sample, so that no task meets a whole group; the sums are exact. The cuts are
    worked out more than once in a plan, so they must not depend on the order in which rows arrive, as approximate quantiles do: the sample
    holds the value of the smallest hash in each of 8 * parts cells of hashes.
    """
    at, draw = F.col(order).cast("double"), F.xxhash64(F.col(order).cast("double"))
    drawn = counts.groupBy(*by, F.pmod(draw, F.lit(8 * parts)).alias("_cell")).agg(F.min(F.when(at.isNotNull(), F.struct(draw.alias("h"), at.alias("v")))).alias("_draw"), *[F.sum(v).alias(v) for v in values])
    wide = drawn.groupBy(*by).agg(F.sort_array(F.collect_list("_draw.v")).alias("_sample"), *[F.sum(v).alias(f"whole_{v}") for v in values])
    cuts = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("_sample", (i * F.size("_sample") / parts).cast("int")))
    wide = wide.select(*by, cuts.alias("_cuts"), *[f"whole_{v}" for v in values])
    keyed = lambda table: table.withColumn("_by", F.struct(*by))  # noqa: E731  (null keys are groups, too)
    rows = keyed(counts).join(keyed(wide).drop(*by), "_by").drop("_by") if by else counts.join(F.broadcast(wide))
    at = F.size(F.filter("_cuts", lambda x: x < F.col(order)))
    return running(rows.withColumn("_at", -at if descending else at), list(by) or [F.lit(0).alias("all")], order, values, F.col("_at"), descending).drop("_cuts", "_at")


def between(low: Column, high: Column, share: Column) -> Column:
    """(1 - share) * low + share * high as a fused multiply-add gives it, rounded once: what is lost of the product is put back with the sum.
    That is how the oracle interpolates; the plain formula differs in the last digit."""
    half = lambda x: x * 134_217_729.0 - (x * 134_217_729.0 - x)
    a, c = 1.0 - share, share * high
    product, total = a * low, a * low + c
    ah, lh = half(a), half(low)
    lost = ((ah * lh - product) + ah * (low - lh) + (a - ah) * lh) + (a - ah) * (low - lh)
    added = total - product
    return F.when(F.abs(low) < 1e290, total + (((product - (total - added)) + (c - added)) + lost)).otherwise(total)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Exact interpolated percentiles, named as in `shares`, and the number n of values, for each group; nulls don't count. A group without values has none.

    Values are counted first (a row counts `weight` times), then running counts over ranges of them find the ranks: no task holds a group's values.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")).where("_v is not null")
    ranked = cumulative(counts, "_v", ["_n"], by)
    found = {}
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("whole__n") - 1)
        holds = lambda k: (F.col("upto__n") - F.col("_n") <= k) & (k < F.col("upto__n"))
        found |= {f"_lo_{name}": F.max(F.when(holds(F.floor(rank)), F.col("_v"))), f"_hi_{name}": F.max(F.when(holds(F.ceil(rank)), F.col("_v")))}
    one = ranked.groupBy(*by).agg(F.max("whole__n").alias("n"), *[c.alias(k) for k, c in found.items()])
    at = lambda name, rank: F.when(F.floor(rank) == F.ceil(rank), F.col(f"_lo_{name}")).otherwise(between(F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), rank - F.floor(rank)))
    return one.select(*by, "n", *[at(name, F.lit(share) * (F.col("n") - 1)).alias(name) for name, share in shares.items()])


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows with _lone: what keeps rows of a null key apart."""
    return rows.withColumn("_lone", F.when(F.col(key).isNull(), F.xxhash64(*rows.columns)))


def _events(rows: DataFrame, key: str, when: str, changes: list[tuple[int, dict[str, Column]]], values: list[str]) -> DataFrame:
    """A row per change: _at (the row's time and an offset) and values (0 if a change doesn't name them); _own marks the rows themselves."""
    one = lambda i, offset, change: F.struct((F.col(when) + offset).alias("_at"), F.lit(i == 0).alias("_own"), *[change.get(v, F.lit(0)).cast("long").alias(v) for v in values])
    each = F.array(*[one(i, *change) for i, change in enumerate(changes)])
    return _keyed(rows, key).select("*", F.inline(F.when(F.col(key).isNull(), F.slice(each, 1, 1)).otherwise(each)))


def _feature(value: Column, key: str) -> Column:
    return F.when(F.col(key).isNull(), 0).otherwise(value).cast("long")


def velocity(rows: DataFrame, key: str, when: str, spend: str | None, ties: str = "peers") -> DataFrame:
    """Orders of the trailing hour and day, and spend of the day, at each row; lower bound inclusive.

    ties='peers': rows of the same time count, the row itself doesn't. ties='strict': only earlier rows.
    Null keys get 0.
    """
    one, pence = F.lit(1), F.coalesce(F.col(spend), F.lit(0)) if spend else F.lit(0)
    changes = [(0, {"_h": one, "_d": one, "_s": pence}), (HOUR + 1, {"_h": -one}), (DAY + 1, {"_d": -one, "_s": -pence})]
    out = running(_events(rows, key, when, changes, ["_h", "_d", "_s"]), [key, "_lone"], "_at", ["_h", "_d", "_s"]).where("_own")
    at = (lambda v, own: F.col(f"upto_{v}") - own) if ties == "peers" else (lambda v, own: F.col(f"before_{v}"))
    features = [_feature(at("_h", one), key).alias("orders_1h"), _feature(at("_d", one), key).alias("orders_24h")]
    return out.select(*rows.columns, *features, *([_feature(at("_s", pence), key).alias("spend_24h")] if spend else []))


def lifetime_count(rows: DataFrame, key: str, when: str, name: str) -> DataFrame:
    """Orders so far, the row itself left out, peers counted; null key: 0."""
    out = running(_keyed(rows, key).withColumn("_n", F.lit(1)), [key, "_lone"], when, ["_n"])
    return out.select(*rows.columns, _feature(F.col("upto__n") - 1, key).alias(name))


def distinct_before(rows: DataFrame, key: str, member: str, when: str, name: str) -> DataFrame:
    """Distinct members strictly before, lifetime: first appearances are events, found by one aggregation."""
    first = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).groupBy(key, member).agg(F.min(when).alias(when)).select(key, when, F.lit(1).alias("_n"))
    asked = _keyed(rows, key).withColumn("_n", F.lit(0)).withColumn("_own", F.lit(True))
    out = running(asked.unionByName(first, allowMissingColumns=True), [key, "_lone"], when, ["_n"]).where("_own")
    return out.select(*rows.columns, _feature(F.col("before__n"), key).alias(name))


def linked(rows: DataFrame, keys: list[str], when: str, slot: int = DAY, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with _previous and _next: the time of the row before and after with the same keys (of one time: in order of `ties`), two-level as `running`."""
    cut = rows.withColumn("_k", F.struct(*keys)).withColumn("_slot", F.floor(F.col(when) / F.lit(slot)))
    ends = cut.groupBy("_k", "_slot").agg(F.min(when).alias("_low"), F.max(when).alias("_high"))
    over = Window.partitionBy("_k").orderBy("_slot")
    ends = ends.select("_k", "_slot", F.lag("_high").over(over).alias("_from"), F.lead("_low").over(over).alias("_to"))
    within = Window.partitionBy("_k", "_slot").orderBy(when, *ties)
    found = [F.coalesce(F.lag(when).over(within), F.col("_from")).alias("_previous"), F.coalesce(F.lead(when).over(within), F.col("_to")).alias("_next")]
    return cut.join(ends, ["_k", "_slot"]).select(*rows.columns, *found)


def presence(when: str, span: int | Column, left: int = 0) -> tuple[Column, Column]:
    """For `linked` rows of a (key, member): whether the member comes in at the row, and when it leaves, if it does before it is seen again.

    It is in for `span` from each row on; overlapping stays are one. `left` is added to the time it leaves.
    """
    t = F.col(when)
    return F.col("_previous").isNull() | (F.col("_previous") < t - span), F.when(F.col("_next").isNull() | (F.col("_next") > t + span), t + span + left)


def distinct_within(rows: DataFrame, key: str, member: str, when: str, name: str, span: int = DAY) -> DataFrame:
    """Distinct members of the trailing span, strictly before, lower bound inclusive."""
    known = F.col(key).isNotNull() & F.col(member).isNotNull()
    comes, leaves = presence(when, span)
    seen = linked(rows.where(known).select(key, member, when), [key, member], when)
    stays = seen.select(key, F.inline(F.array(F.struct(F.col(when).alias("_at"), comes.cast("int").alias("_n")), F.struct(leaves.alias("_at"), F.lit(-1).alias("_n")))))
    asked = _keyed(rows, key).withColumn("_at", F.col(when)).withColumn("_n", F.lit(0)).withColumn("_own", F.lit(True))
    out = running(asked.unionByName(stays.where("_at is not null and _n != 0"), allowMissingColumns=True), [key, "_lone"], "_at", ["_n"]).where("_own")
    return out.select(*rows.columns, _feature(F.col("before__n"), key).alias(name))


def asof_rate(counts: DataFrame, orders: DataFrame, key: str, when: str, name: str) -> DataFrame:
    """Chargebacks over orders known strictly before each order, from counts by (entity, time).

    Running sums over the aggregated times; orders pick theirs up by equality, since each order time is one of them.
    """
    known = running(counts.select(key, F.col("at_us").alias(when), "orders", "chargebacks"), [key], when, ["orders", "chargebacks"])
    out = orders.join(known.select(key, when, F.col("before_orders").alias("_o"), F.col("before_chargebacks").alias("_c")), [key, when], "left")
    return out.withColumn(name, F.when(F.col("_o") > 0, F.col("_c") / F.col("_o")).otherwise(0.0)).drop("_o", "_c")


def previous_gap(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """Whole minutes since the one before; null for the first."""
    before = F.lag(when).over(Window.partitionBy(key).orderBy(when, tie))
    return rows.withColumn("gap_minutes", F.when(before.isNotNull(), F.greatest(F.floor((F.col(when) - before) / 60_000_000), F.lit(0))))


def user_snapshot(rows: DataFrame) -> DataFrame:
    """What was known of the user strictly before the order, and whether its payment and address are new."""
    one = F.lit(1)
    changes = [(0, {"_n": one, "_m": one, "_s": F.col("total_pence")}), (30 * DAY, {"_m": -one})]
    out = running(_events(rows, "user_id", "placed_us", changes, ["_n", "_m", "_s"]), ["user_id", "_lone"], "_at", ["_n", "_m", "_s"]).where("_own")
    sums = {"lifetime_orders": "_n", "orders_30d": "_m", "lifetime_spend": "_s"}
    out = out.select(*rows.columns, *[_feature(F.col(f"before_{v}"), "user_id").alias(name) for name, v in sums.items()]).withColumn("is_first", F.col("lifetime_orders") == 0)
    for key, name in (("payment_id", "new_payment"), ("address_id", "new_address")):
        first = rows.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.min("placed_us").alias("_first"))
        out = out.join(first, ["user_id", key], "left").withColumn(name, F.coalesce(F.col("placed_us") == F.col("_first"), F.lit(False))).drop("_first")
    return out


def top_per_parent(rows: DataFrame, parent: str, order: list, n: int) -> DataFrame:
    """The first n rows of each parent; Spark cuts groups to n before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= n)


def previous_status(log: DataFrame) -> DataFrame:
    """Each event with the one before it in its order."""
    w = Window.partitionBy("order_id").orderBy("at_us", "event_type")
    return log.withColumn("previous", F.lag("event_type").over(w)).withColumn("previous_us", F.lag("at_us").over(w))
