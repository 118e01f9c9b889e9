"""Joining a big pixel table to a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropscan.session import materialise

#: Measured bytes up to which a table is broadcast: about four million scenes of extremes. The
#: driver and every executor hold it, so lower it where they are small.
BROADCAST_BYTES = 512 << 20
SALTS = 64


def _payload_bytes(field: T.StructField) -> Column:
    """Bytes one value takes beyond its 8-byte slot."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        if not isinstance(field.dataType.elementType, (T.NumericType, T.DateType)):
            raise TypeError(f"{field.name}: size of nested values is not measured")
        return F.coalesce(F.array_size(field.name), F.lit(0)) * 8
    if isinstance(field.dataType, (T.NumericType, T.DateType, T.BooleanType)):
        return F.lit(0)
    raise TypeError(f"{field.name}: size of {field.dataType.simpleString()} is not measured")


def table_bytes(table: DataFrame) -> int:
    """In-memory size of a table's rows, measured in one small aggregation."""
    width = F.lit(8 * (len(table.columns) + 2)).cast("long")
    for field in table.schema.fields:
        width = width + _payload_bytes(field)
    return table.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``table`` (one row per ``keys``) to ``facts``.

    ``table`` is computed once and its size measured. Within ``max_bytes`` it is
    broadcast and the facts are not shuffled. Beyond that both sides are shuffled
    on the keys plus a salt taken from the ``spread`` columns, so that a key which
    holds a large share of the facts is split over ``SALTS`` tasks.
    """
    table = materialise(table)
    if table_bytes(table) <= max_bytes:
        return facts.join(F.broadcast(table), list(keys), how)
    salted_facts = facts.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(SALTS)))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_facts.join(salted_table.hint("merge"), [*keys, "_salt"], how).drop("_salt")
