"""Feature vectors: an order context joined with the feature rows of its entities, typed defaults, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import KEYS, OWN_NAMES, RELATIONS, STREAM_NAMES


def typed(value: Column, is_float: bool = False) -> Column:
    """G1: a stored string as a number; blank or malformed: 0."""
    kind = "double" if is_float else "long"
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast(kind), F.lit(0).cast(kind))


def contract() -> list[str]:
    """Output fields in order."""
    return [f"{entity}_{field}" for entity, _, fields in RELATIONS for field in fields]


def named(table: DataFrame, entity: str, kind: str) -> DataFrame:
    """One of this library's feature tables under the contract's field names."""
    return table.withColumnsRenamed(STREAM_NAMES if kind == "stream" else OWN_NAMES[entity, kind])


def assemble(orders: DataFrame, features: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Left joins on the entity keys; absent relations count as empty. Counts are longs, rates doubles.

    missing_features lists `fs:entity:id:kind` for rows that aren't there (null ids aren't reported) and
    `fs:entity:id:kind:field` for fields that a present row lacks.
    """
    rows, values, no_row, no_field = orders, [], [], []
    for entity, kind, fields in RELATIONS:
        table, key, tag = features.get((entity, kind)), KEYS[entity], f"_{entity}_{kind}"
        have = dict(table.dtypes) if table is not None else {}
        if table is not None:
            rows = rows.join(table.select(key, F.struct(F.lit(True).alias("_there"), *[f for f in fields if f in have]).alias(tag)), key, "left")
        known, there = F.col(key).isNotNull(), F.col(tag).isNotNull() if have else F.lit(False)
        path = F.concat(F.lit(f"fs:{entity}:"), F.col(key).cast("string"), F.lit(f":{kind}"))
        no_row.append(F.when(known & ~there, path))
        for field in fields:
            value, is_float = F.col(f"{tag}.{field}") if field in have else F.lit(None), field.endswith("rate")
            text = have.get(field, "string") == "string"
            absent = F.coalesce(F.trim(value.cast("string")) == "", F.lit(True)) if text else value.isNull()
            number = typed(value, is_float) if text else F.coalesce(value.cast("double" if is_float else "long"), F.lit(0))
            values.append(number.cast("double" if is_float else "long").alias(f"{entity}_{field}"))
            no_field.append(F.when(known & there & absent, F.concat(path, F.lit(f":{field}"))))
    missing = F.array_compact(F.array(*no_row, *no_field))
    return rows.select(*orders.columns, *values, missing.alias("missing_features"))


def narrow(vector: DataFrame, entity: str) -> DataFrame:
    """One entity's fields."""
    return vector.select(KEYS[entity], *[f"{e}_{field}" for e, _, fields in RELATIONS if e == entity for field in fields])
