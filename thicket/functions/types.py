"""Column types: how values as drivers deliver them become Spark values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnType:
    """A Spark type and the projection that decodes a driver's value; ``from_json`` where JSON delivers another form."""

    name: str
    spark_type: str
    decode: Callable[[Column], Column] = lambda c: c
    decode_json: Callable[[Column], Column] | None = None
    nullable: bool = False
    generated: str | None = None  # None, by_default, always

    def from_driver(self, c: Column) -> Column:
        return self.decode(c)

    def from_json(self, c: Column) -> Column:
        return (self.decode_json or self.decode)(c)

    def as_nullable(self) -> ColumnType:
        return ColumnType(f"nullable {self.name}", self.spark_type, self.decode, self.decode_json, True, self.generated)

    def as_generated(self, always: bool = False) -> ColumnType:
        return ColumnType(self.name, self.spark_type, self.decode, self.decode_json, self.nullable, "always" if always else "by_default")


def _cast(kind: str) -> Callable[[Column], Column]:
    return lambda c: c.cast(kind)


def _identity(name: str, kind: str) -> Callable[[], ColumnType]:
    return lambda: ColumnType(name, kind, _cast(kind))


# Types of a server database.
bigint, bigserial = _identity("bigint", "bigint"), _identity("bigserial", "bigint")
integer, serial = _identity("integer", "int"), _identity("serial", "int")
smallint, smallserial = _identity("smallint", "smallint"), _identity("smallserial", "smallint")
real, double_precision = _identity("real", "float"), _identity("double precision", "double")
boolean, text = _identity("boolean", "boolean"), _identity("text", "string")
date = _identity("date", "date")
uuid, cidr, inet, macaddr, macaddr8 = (_identity(n, "string") for n in ("uuid", "cidr", "inet", "macaddr", "macaddr8"))


def never() -> ColumnType:
    return ColumnType("never", "void")


def numeric(precision: int = 38, scale: int = 18) -> ColumnType:
    return ColumnType("numeric", f"decimal({precision},{scale})", _cast(f"decimal({precision},{scale})"))


decimal = numeric


def varchar(n: int) -> ColumnType:
    return ColumnType(f"varchar({n})", "string")


def char(n: int) -> ColumnType:
    return ColumnType(f"char({n})", "string", lambda c: F.rpad(c, n, " "))


def timestamp(with_time_zone: bool = False) -> ColumnType:
    kind = "timestamp" if with_time_zone else "timestamp_ntz"
    return ColumnType(kind, kind, _cast(kind))


def time() -> ColumnType:
    return ColumnType("time", "string")


def interval() -> ColumnType:
    return ColumnType("interval", "string")


def json() -> ColumnType:
    """A variant; text that isn't JSON is kept as a string variant."""
    quoted = lambda c: F.parse_json(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r'(["\\])', r'\\$1'), r"[\x00-\x1F]", " "), F.lit('"')))
    return ColumnType("json", "variant", lambda c: F.coalesce(F.try_parse_json(c), quoted(c)))


jsonb = json


def enum(*values: str) -> ColumnType:
    return ColumnType("enum", "string", lambda c: F.when(c.isin(*values), c))


def array(of: ColumnType) -> ColumnType:
    """Arrays arrive as arrays, or in the text form {a,b,"c,d"}; each element is decoded."""

    def decode(c: Column) -> Column:
        return F.transform(c, of.decode)

    def decode_text(c: Column) -> Column:
        inner = F.substring(c, 2, F.length(c) - 2)
        parts = F.regexp_extract_all(inner, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), F.lit(1))
        plain = F.transform(parts, lambda p: F.when(F.upper(p) == "NULL", F.lit(None)).otherwise(F.regexp_replace(F.regexp_replace(p, r'^"|"$', ""), r"\\(.)", "$1")))
        return F.transform(plain, of.decode)

    return ColumnType(f"{of.name}[]", f"array<{of.spark_type}>", decode, decode_text)


def custom(name: str, spark_type: str, decode: Callable[[Column], Column], decode_json: Callable[[Column], Column] | None = None) -> ColumnType:
    return ColumnType(name, spark_type, decode, decode_json)


# Types of an embedded database.
embedded_integer, embedded_real, embedded_text = _identity("integer", "bigint"), _identity("real", "double"), _identity("text", "string")


def embedded_timestamp(mode: str = "timestamp_ms") -> ColumnType:
    return ColumnType(mode, "timestamp", (lambda c: F.timestamp_seconds(c)) if mode == "timestamp" else (lambda c: F.timestamp_millis(c.cast("long"))))


def embedded_boolean() -> ColumnType:
    return ColumnType("boolean", "boolean", lambda c: c.cast("double") == 1)


def text_json() -> ColumnType:
    return ColumnType("json", "variant", lambda c: F.parse_json(c))


def blob_json() -> ColumnType:
    return ColumnType("json", "variant", lambda c: F.parse_json(F.decode(c, "UTF-8")))


def blob() -> ColumnType:
    return ColumnType("blob", "binary", _cast("binary"), lambda c: F.unbase64(c))


def blob_bigint() -> ColumnType:
    return ColumnType("bigint", "bigint", lambda c: F.decode(c, "UTF-8").cast("bigint"))


def embedded_numeric(mode: str = "string") -> ColumnType:
    kind = {"string": "decimal(38,18)", "number": "double", "bigint": "bigint"}[mode]
    return ColumnType(f"numeric as {mode}", kind, _cast(kind))


def decoded(df: DataFrame, types: dict[str, ColumnType]) -> DataFrame:
    """The frame with the columns that have a type decoded."""
    return df.select(*[types[c].from_driver(F.col(f"`{c}`")).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])
