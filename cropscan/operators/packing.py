"""Wide rows made narrow for an exchange: whole numbers side by side in a few longs.

A shuffled row has eight bytes for every column, and small numbers spread over them compress to about half. Here a column
takes the bits between its least and largest value, as measured in one pass, and a code for null where it has nulls. Whatever the values are
they come back exactly; a column of other type, or of too wide a range, stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropscan.session import bound_methods, no_shuffle_left

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
#: Bits of a long that are used; the sign is not.
_BITS = 62


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class _Field:
    """A column of whole numbers between two values; one without any has them the wrong way round."""

    name: str
    kind: T.DataType
    low: int = 0
    high: int = -1
    nulls: bool = False

    @property
    def bits(self) -> int:
        return max(1, (self.high - self.low + self.nulls).bit_length())

    def number(self) -> Column:
        column = _named(self.name)
        return F.unix_date(column) if isinstance(self.kind, T.DateType) else column

    def fits(self) -> Column:
        return F.coalesce(self.number().between(self.low, self.high), F.lit(self.nulls))

    def code(self) -> Column:
        above = self.number().cast("long") - F.lit(self.low).cast("long")
        return F.coalesce(above + 1, F.lit(0).cast("long")) if self.nulls else above

    def value(self, code: Column) -> Column:
        number = (code - 1 if self.nulls else code) + F.lit(self.low).cast("long")
        if isinstance(self.kind, T.DateType):
            number = F.date_from_unix_date(number.cast("int"))
        number = number.cast(self.kind)
        return F.when(code != 0, number) if self.nulls else number


def _measured(rows: DataFrame) -> list[_Field]:
    """The columns of whole numbers with their least and largest values, from one aggregation."""
    fields = [_Field(f.name, f.dataType) for f in rows.schema.fields if isinstance(f.dataType, _WHOLE)]
    if not fields:
        return []
    with no_shuffle_left(rows.sparkSession):
        found = rows.agg(F.count(F.lit(1)), *(
            figure(f.number()) for f in fields for figure in (F.min, F.max, F.count))).first()
    n, figures = found[0], found[1:]
    return [
        _Field(f.name, f.kind, *((low, high) if known else (0, -1)), known < n)
        for f, low, high, known in zip(fields, figures[::3], figures[1::3], figures[2::3], strict=True)]


def packed(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The rows in narrow form, and every column of theirs as an expression on that form.

    The rows are gone over once to measure them. Should they come out otherwise when they are used, with a value that was not there,
    the query stops.
    """
    bound_methods(rows.sparkSession)
    fields = [f for f in _measured(rows) if f.bits <= _BITS]
    words: list[list[_Field]] = [[]]
    for field in fields:
        room = (w for w in words if sum(f.bits for f in w) + field.bits <= _BITS)
        word = next(room, None)
        if word is None:
            words.append(word := [])
        word.append(field)

    prefix = "_word"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix = f"_{prefix}"
    columns, made = {}, []
    for i, word in enumerate(words):
        name, at, total = f"{prefix}{i}", 0, F.lit(0).cast("long")
        for field in word:
            total = total.bitwiseOR(F.shiftleft(field.code(), at))
            code = F.shiftright(F.col(name), at).bitwiseAND(F.lit((1 << field.bits) - 1).cast("long"))
            columns[field.name], at = field.value(code), at + field.bits
        made.append((name, total))
    fits = F.lit(True)
    for field in fields:
        fits = fits & field.fits()
    changed = F.raise_error(F.lit("a row differs from what it was when the rows were measured")).cast("long")
    first, total = made[0]
    made[0] = (first, F.when(fits, total).otherwise(changed))
    plain = [c for c in rows.columns if c not in columns]
    columns |= {c: _named(c) for c in plain}
    narrow = rows.select(*(total.alias(name) for name, total in made), *(_named(c) for c in plain))
    return narrow, {c: columns[c] for c in rows.columns}
