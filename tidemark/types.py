"""Neutral types, their Spark types, and literals of them."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import uuid
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The open upper bound of an interval. Spark has no infinite timestamp and null is no bound.
INFINITY = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)

#: The names of the neutral types.
_SIMPLE = {
    "boolean": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "date": T.DateType(),
    "time": T.TimeType(6),
    "timestamp": T.TimestampNTZType(),
    "uuid": T.StringType(),
}
_DECIMAL = re.compile(r"decimal\((\d+),\s*(\d+)\)$")
_BOUNDS = {"int32": 31, "int64": 63}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a neutral type; timestamps stay without zone from end to end, in UTC."""
    if name in _SIMPLE:
        return _SIMPLE[name]
    if m := _DECIMAL.match(name):
        p, s = int(m[1]), int(m[2])
        if 1 <= p <= 38 and s <= p:
            return T.DecimalType(p, s)
    raise ValueError(f"no such type: {name}")


def is_instant(name: str) -> bool:
    return name == "timestamp"


def conforms(value: Any, name: str) -> bool:
    """Whether a Python value lies in the value space of a neutral type; null lies in none."""
    if name == "boolean":
        return isinstance(value, bool)
    if isinstance(value, bool):
        return False
    if name in _BOUNDS:
        return isinstance(value, int) and -(1 << _BOUNDS[name]) <= value < 1 << _BOUNDS[name]
    if name in ("float32", "float64"):
        return isinstance(value, (int, float)) and math.isfinite(value)
    if m := _DECIMAL.match(name):
        if not isinstance(value, (int, decimal.Decimal)):
            return False
        d = decimal.Decimal(value)
        digits = d.as_tuple()
        scale = max(0, -digits.exponent) if d.is_finite() else 99
        return d.is_finite() and scale <= int(m[2]) and len(digits.digits) - scale <= int(m[1]) - int(m[2])
    if name == "string":
        return isinstance(value, str)
    if name == "bytes":
        return isinstance(value, (bytes, bytearray))
    if name == "date":
        return isinstance(value, dt.date) and not isinstance(value, dt.datetime)
    if name == "time":
        return isinstance(value, dt.time) and value.tzinfo is None
    if name == "timestamp":
        return isinstance(value, dt.datetime)
    if name == "uuid":
        try:
            uuid.UUID(str(value))
        except ValueError:
            return False
        return True
    return False


def utc(value: dt.datetime) -> dt.datetime:
    """An instant as UTC without zone, to the microsecond."""
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def literal(value: Any, name: str) -> Column:
    """A literal of exactly the column's type, so that comparisons reach the scan."""
    if value is None:
        return F.lit(None).cast(spark_type(name))
    if name == "timestamp":
        return F.lit(utc(value).isoformat(sep=" ")).cast("timestamp_ntz")
    if name == "uuid":
        return F.lit(str(uuid.UUID(str(value))))
    if name == "time":
        return F.lit(value.isoformat()).cast("time(6)")
    if name.startswith("decimal"):
        return F.lit(str(value)).cast(spark_type(name))
    return F.lit(value).cast(spark_type(name))


def document_value(value: Any, name: str) -> Any:
    """A value as it stands in a JSON document: numbers and booleans as such, all else as its canonical text."""
    if value is None or name in ("boolean", "int32", "int64", "float32", "float64", "string"):
        return value
    if name.startswith("decimal"):
        return format(decimal.Decimal(value), "f")
    if name == "bytes":
        return bytes(value).hex()
    if name == "uuid":
        return str(uuid.UUID(str(value)))
    if name == "timestamp":
        return utc(value).isoformat(timespec="microseconds") + "Z"
    return value.isoformat()


def decoded(value: Any, name: str) -> Any:
    """The value of a canonical text, number or boolean; what is no text of the type is passed on for ``conforms`` to reject."""
    if not isinstance(value, str) or name in ("string", "uuid"):
        return value
    try:
        if name.startswith("decimal"):
            return decimal.Decimal(value)
        if name == "bytes":
            return bytes.fromhex(value)
        if name == "timestamp":
            return utc(dt.datetime.fromisoformat(value))
        kind = {"date": dt.date, "time": dt.time}.get(name)
        return kind.fromisoformat(value) if kind else value
    except (ValueError, decimal.InvalidOperation):
        return value


def instant(value: dt.datetime) -> Column:
    return literal(value, "timestamp")


def wired(value: Column, kind: T.DataType) -> Column:
    """A value of any shape with every leaf that JSON has no form for as its canonical text."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[wired(value.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: wired(x, kind.elementType))
    names = {T.BinaryType: "bytes", T.TimestampNTZType: "timestamp", T.DecimalType: "decimal", T.DateType: "date", T.TimeType: "time"}
    return wire(value, names[type(kind)]) if type(kind) in names else value


def wire(value: Column, name: str) -> Column:
    """The canonical text of a value: lowercase hex bytes, plain decimals, ISO dates, UTC instants with Z."""
    if name == "bytes":
        return F.lower(F.hex(value))
    if name == "timestamp":
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return F.when(value == instant(INFINITY), F.lit("infinity")).otherwise(text)
    if name in ("float32", "float64"):
        # both zeros are one value
        return F.when(value == 0, F.lit("0.0")).otherwise(value.cast("string"))
    return F.lower(value) if name == "uuid" else value.cast("string")
