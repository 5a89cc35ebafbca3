"""The seven types of relations and how they map to Spark's.

There is no null in these types: a missing value is the type's default. Trailing blanks, line breaks and NULs of strings
aren't significant; `fit` drops them and cuts a string to its declared number of UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name: Spark's type, default value, range of integers.
_KINDS: dict[str, tuple[T.DataType, Any, tuple[int, int] | None]] = {
    "byte": (T.ShortType(), 0, (0, 255)),
    "short": (T.ShortType(), 0, (-(1 << 15), (1 << 15) - 1)),
    "int": (T.IntegerType(), 0, (-(1 << 31), (1 << 31) - 1)),
    "float": (T.FloatType(), 0.0, None),
    "double": (T.DoubleType(), 0.0, None),
    "char": (T.StringType(), "", None),
    "text": (T.StringType(), "", None),
}
_STRINGS = ("char", "text")
_GRAMMAR = re.compile(r"([a-z]+)(?:\((\d+)\))?")


@dataclass(frozen=True)
class FieldType:
    kind: str
    length: int | None = None

    @property
    def spark(self) -> T.DataType:
        return _KINDS[self.kind][0]

    @property
    def default(self) -> Any:
        return _KINDS[self.kind][1]

    def __str__(self) -> str:
        return self.kind if self.length is None else f"{self.kind}({self.length})"

    def fit(self, value: Column) -> Column:
        """value as this type: cast under ANSI rules, so that what doesn't fit is an error; null becomes the default.
        Strings longer than the declared bytes are cut at the last whole character that fits."""
        if self.kind in _STRINGS:
            text = F.regexp_replace(value.cast("string"), r"[\x00 \n]+\z", "")
            octets = F.substring(text.cast("binary"), 1, self.length).cast("string")
            whole = F.when(F.octet_length(text) <= self.length, text).otherwise(F.regexp_replace(octets, "�+$", ""))
            return F.coalesce(whole, F.lit(""))
        out = value.cast(self.spark)
        if self.kind == "byte":
            out = F.when(out.between(0, 255) | out.isNull(), out).otherwise(F.raise_error(F.lit("a byte is out of 0 to 255")).cast(self.spark))
        return F.coalesce(out, F.lit(self.default).cast(self.spark))

    def parse(self, text: Column) -> Column:
        """Text to a value; text that is none gives the default."""
        return self.fit(text if self.kind in _STRINGS else text.try_cast(self.spark))


def parse_type(text: str) -> FieldType | None:
    """The type that text describes, or None: strings need a length, other types have none."""
    m = _GRAMMAR.fullmatch(text)
    if not m or m[1] not in _KINDS or (m[1] in _STRINGS) != (m[2] is not None):
        return None
    return FieldType(m[1], int(m[2]) if m[2] else None)


def field_type(text: str | FieldType) -> FieldType:
    found = text if isinstance(text, FieldType) else parse_type(text)
    if found is None:
        raise ValueError(f"no type: {text!r}")
    return found


def of_spark(kind: T.DataType, length: int = 255) -> FieldType:
    """The nearest type of a column: wider numbers and dates keep their own Spark type elsewhere."""
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return FieldType("short")
    if isinstance(kind, T.IntegralType):
        return FieldType("int")
    if isinstance(kind, T.FloatType):
        return FieldType("float")
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return FieldType("double")
    return FieldType("text", length)


def date_number(value: Column) -> Column:
    """A date as the integer yyyymmdd."""
    d = value.cast("date")
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def date_of_number(value: Column) -> Column:
    return F.to_date(F.lpad(value.cast("string"), 8, "0"), "yyyyMMdd")
