"""Column functions of the order model. All of them are built-in expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DAY = 86_400_000_000
POSTCODE = "^[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}$"
#: Fixed values.
DISPOSABLE = ("mailinator.com", "guerrillamail.com", "tempmail.io", "throwawaymail.com", "10minutemail.com", "mailsac.com")
BANK_HOLIDAYS = ("2026-01-01", "2026-04-03", "2026-04-06", "2026-05-04", "2026-05-25", "2026-08-31", "2026-12-25", "2026-12-28")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance_or_zero(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """0 if a point is missing."""
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, haversine_km(lat1, lon1, lat2, lon2)).otherwise(0.0)


def pounds_to_pence(amount: Column) -> Column:
    """Half up, on decimals."""
    return F.round(amount.cast("decimal(20,6)") * 100, 0).cast("long")


def pence_to_text(pence: Column) -> Column:
    """-£12.05."""
    p = F.abs(pence)
    return F.concat(F.when(pence < 0, "-").otherwise(""), F.lit("£"), F.floor(p / 100).cast("string"), F.lit("."), F.lpad(F.pmod(p, F.lit(100)).cast("string"), 2, "0"))


def vat(pence: Column, is_hot: Column) -> Column:
    """20 % of a hot line, half up for each line."""
    return F.when(is_hot, F.round(pence.cast("decimal(20,2)") * F.lit(0.2).cast("decimal(3,2)"), 0).cast("long")).otherwise(0)


def vat_with_fees(items_vat: Column, delivery: Column, service: Column) -> Column:
    """VAT of an order's items, and of its delivery and service fees as two more hot lines."""
    return F.coalesce(items_vat, F.lit(0)) + vat(delivery, F.lit(True)) + vat(service, F.lit(True))


def order_total(subtotal: Column, vat_: Column, delivery: Column, service: Column, tip: Column, discount: Column) -> Column:
    """X6."""
    return subtotal + vat_ + delivery + service + tip - discount


def delivery_fee(km: Column, order_type: Column) -> Column:
    """250 + 20 a km, at most 499; only deliveries."""
    return F.when(order_type == "DELIVERY", F.greatest(F.lit(250), F.least(F.lit(499), 250 + F.least(F.lit(249), F.floor(km * 20))))).otherwise(0).cast("long")


def service_fee(subtotal: Column) -> Column:
    """A tenth, at most 250."""
    return F.least(F.lit(250), F.floor(subtotal / 10)).cast("long")


def promo_discount(subtotal: Column, fixed: Column, percent: Column) -> Column:
    """Fixed, else percent half up; never more than the subtotal."""
    share = F.round(subtotal.cast("decimal(20,2)") * percent.cast("decimal(5,2)") / 100, 0).cast("long")
    return F.coalesce(F.least(subtotal, F.coalesce(fixed, share)), F.lit(0)).cast("long")


def email_domain(email: Column) -> Column:
    """`unknown` without an @."""
    return F.when(F.instr(email, "@") > 0, F.lower(F.split_part(email, F.lit("@"), F.lit(2)))).otherwise("unknown")


def is_disposable(domain: Column) -> Column:
    return F.coalesce(domain.isin(*DISPOSABLE), F.lit(False))


def mask_email(email: Column) -> Column:
    """X11: al***@example.com."""
    return F.concat(F.substring(email, 1, 2), F.lit("***@"), email_domain(email))


def whole_days(now_us: Column, then_us: Column) -> Column:
    """Whole days of 24 hours, at least 0; null: 0."""
    return F.coalesce(F.greatest(F.floor((now_us - then_us) / DAY), F.lit(0)), F.lit(0)).cast("long")


def half_even(value: Column) -> Column:
    """banker's rounding on decimals; null: 0."""
    return F.coalesce(F.bround(value.cast("decimal(38,10)"), 0).cast("long"), F.lit(0))


def average(total: Column, n: Column) -> Column:
    """Half-even average of integers: decimal division, not a double."""
    return F.when(n > 0, half_even(total.cast("decimal(20,0)") / n.cast("decimal(18,0)"))).otherwise(0)


def rate(n: Column, d: Column) -> Column:
    """0 if there is nothing to divide by; six digits."""
    return F.when(d > 0, F.round(n / d, 6)).otherwise(0.0)


def smoothed_rate(n: Column, d: Column) -> Column:
    """X15."""
    return n / (d + 1)


def member_pence(member: Column) -> Column:
    """Pence of `id:pence`; null if malformed."""
    return F.when(F.instr(member, ":") > 0, F.substring_index(member, ":", -1).try_cast("long"))


def iso_week_key(ts: Column) -> Column:
    """IYYY_IW."""
    thursday = F.date_trunc("week", ts) + F.expr("interval 3 days")
    return F.concat(F.year(thursday).cast("string"), F.lit("_"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def local_hour(ts: Column, zone: str = "Europe/London") -> Column:
    """X18."""
    return F.hour(F.from_utc_timestamp(ts, zone))


def is_night(ts: Column) -> Column:
    return local_hour(ts).between(2, 5)


def iso_country(raw: Column, names: dict[str, str] | None = None, default: str = "GB") -> Column:
    """Two letters as they are, other names by the map; missing and unknown ones get the default."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in (names or {}).items() for x in kv]), raw) if names else F.lit(None)
    return F.coalesce(F.when(raw.rlike("^[A-Za-z]{2}$"), F.upper(raw)), named, F.lit(default))


def channels(device_types: Column) -> Column:
    """Which apps a user's devices allow."""
    has = lambda what: F.exists(device_types, lambda x: F.lower(x) == what)
    return F.struct(has("ios").alias("has_ios"), has("android").alias("has_android"))


def bucket(epoch_s: Column, size: int = 600) -> Column:
    """Start of the tumbling bucket."""
    return F.floor(epoch_s / size) * size


def cancelled_by(reason: Column, status: Column, order_type: Column) -> Column:
    """Who the reason names; else the store while it prepares, and the user who never collects."""
    named, state = F.regexp_extract(reason, "^cancelled_by=(USER|MERCHANT)$", 1), F.upper(status)
    return F.when(named != "", named).when(state == "PREPARING", "MERCHANT").when((state == "READY") & (F.upper(order_type) == "PICKUP"), "USER")


def json_number(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def is_bank_holiday(ts: Column, days: tuple[str, ...] = BANK_HOLIDAYS) -> Column:
    """X26."""
    return F.to_date(F.from_utc_timestamp(ts, "Europe/London")).cast("string").isin(*days)


def is_new_user_promo(code: Column) -> Column:
    """X27."""
    return F.coalesce(code.startswith("WELCOME"), F.lit(False))


def order_types(delivery: Column, pickup: Column, in_store: Column) -> Column:
    """X28."""
    kinds = F.array(F.when(delivery, "DELIVERY"), F.when(pickup, "PICKUP"), F.when(in_store, "IN_STORE"))
    return F.filter(kinds, lambda x: x.isNotNull())
