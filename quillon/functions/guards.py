"""Schemas of the physical tables, and checks of tables and parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVENT_TYPES = ("view", "addtocart", "transaction")
EVENTS = T.StructType([T.StructField(n, t) for n, t in (("timestamp", T.LongType()), ("visitorid", T.LongType()), ("event", T.StringType()), ("itemid", T.LongType()), ("transactionid", T.LongType()))])
PROPERTIES = T.StructType([T.StructField(n, t) for n, t in (("timestamp", T.LongType()), ("itemid", T.LongType()), ("property", T.StringType()), ("value", T.StringType()))])
TREE = T.StructType([T.StructField("categoryid", T.StringType()), T.StructField("parentid", T.StringType())])


def require_columns(have: Iterable[str], needed: Iterable[str], name: str) -> None:
    """A ValueError that names the table and its missing columns."""
    missing = sorted(set(needed) - set(have))
    if missing:
        raise ValueError(f"{name}: missing required columns: {', '.join(missing)}")


def require_table(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    require_columns(df.columns, schema.fieldNames(), name)
    return df


def require_fractions(train: float, validation: float) -> float:
    """The test fraction that the other two leave."""
    for name, value in (("train", train), ("validation", validation)):
        if not 0 < value < 1:
            raise ValueError(f"{name}_fraction must be between 0 and 1")
    if 1.0 - train - validation <= 0:
        raise ValueError("train + validation fractions must leave a positive test fraction")
    return 1.0 - train - validation


def require_positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def require_at_least(least: float, reason: str, **values: float) -> None:
    for name, value in values.items():
        if value < least:
            raise ValueError(f"{name} must be >= {reason}")


def require_share(name: str, value: float, closed: bool = False) -> None:
    """Between 0 and 1; with ``closed`` 1 itself is allowed."""
    if not (0 < value < 1 or closed and value == 1):
        raise ValueError(f"{name} must be in (0, 1]" if closed else f"{name} must be between 0 and 1")
