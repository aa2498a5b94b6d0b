"""The dialect's column types, and how values become them.

Tables that the dialect creates store INTEGER as 32-bit, BIGINT as 64-bit and FLOAT as 32-bit numbers,
and STRING(n) cut to n bytes of UTF-8, never inside a character.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError

#: The accepted spellings of each type, and the size of a string column that states none.
SPELLINGS = {
    "INTEGER": "INTEGER", "INT": "INTEGER",
    "BIGINT": "BIGINT",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "FLOAT",
    "STRING": "STRING", "VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING",
}
DEFAULT_SIZE = 50
SPARK_TYPES = {"INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "STRING": T.StringType()}
RANGES = {"INTEGER": (-(1 << 31), (1 << 31) - 1), "BIGINT": (-(1 << 63), (1 << 63) - 1)}
_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    size: int | None = None

    def struct_field(self) -> T.StructField:
        meta = {"type": self.type} | ({"size": self.size} if self.size else {})
        return T.StructField(self.name, SPARK_TYPES[self.type], True, meta)


def field_of(name: str, type_name: str, size: int | None = None) -> Field:
    kind = SPELLINGS.get(type_name.upper())
    if kind is None:
        raise AnalysisError(f"unknown type {type_name!r} of column {name!r}")
    if size is not None and size < 1:
        raise AnalysisError(f"column {name!r} needs a size of 1 at least")
    return Field(name, kind, (size or DEFAULT_SIZE) if kind == "STRING" else None)


def schema_of(fields: list[Field]) -> T.StructType:
    return T.StructType([f.struct_field() for f in fields])


#: What is stripped from both ends of a value: the white space of Unicode.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACE))


def cut_bytes(text: Column, size: int) -> Column:
    """text cut to size bytes, without a broken last character: of the cuts that are up to three bytes
    shorter, the first one that is whole."""
    raw = text.cast("binary")
    cuts = [F.call_function("try_validate_utf8", F.substring(raw, 1, max(0, size - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) > size, F.coalesce(*cuts, F.call_function("make_valid_utf8", F.substring(raw, 1, size).cast("string")))).otherwise(text)


def _cut(text: str, size: int) -> str:
    return text.encode()[:size].decode(errors="ignore")


def converted(value: object, field: Field) -> object:
    """An INSERT literal as a field's value: numbers lose their fraction for integers, numeric strings
    are read; what does not fit is an error."""
    try:
        if field.type in RANGES:
            number = int(value)
            low, high = RANGES[field.type]
            if not low <= number <= high:
                raise AnalysisError(f"{value!r} is out of range for {field.type} column {field.name!r}")
            return number
        if field.type == "FLOAT":
            return struct.unpack("f", struct.pack("f", float(value)))[0]
    except (ValueError, TypeError, OverflowError, struct.error) as e:
        if isinstance(e, AnalysisError):
            raise
        raise AnalysisError(f"{value!r} is no {field.type} for column {field.name!r}") from e
    return _cut(str(value), field.size or DEFAULT_SIZE)


def coerced(raw: Column, field: Field) -> Column:
    """A CSV value as a field's value: what is no number counts as zero; strings are stripped and cut
    to the size in characters, then in bytes."""
    text = stripped(F.coalesce(raw, F.lit("")))
    number = F.when(text.rlike(_NUMBER), text)
    real = number.try_cast("double")
    if field.type in RANGES:
        exact = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text).try_cast("bigint")
        # Whatever the session's ANSI mode, a number out of range stops the load.
        low, high = RANGES[field.type]
        fits = F.coalesce(exact.between(low, high), real > float(low) - 1, F.lit(True)) & F.coalesce(exact.isNotNull() | (real < float(high) + 1), F.lit(True))
        whole = F.coalesce(exact, real.try_cast("bigint"), F.lit(0))
        out_of_range = F.raise_error(F.concat(F.lit(f"out of range for {field.type} column {field.name}: "), text))
        return F.when(fits, whole.cast(SPARK_TYPES[field.type])).otherwise(out_of_range.cast(SPARK_TYPES[field.type]))
    if field.type == "FLOAT":
        return F.coalesce(real, F.lit(0.0)).cast("float")
    size = field.size or DEFAULT_SIZE
    return cut_bytes(F.substring(text, 1, size), size)


#: What a string column gets beyond its longest sample, the least and the largest size.
ROOM, LEAST_SIZE, LARGEST_SIZE = 4, 20, 120
#: What counts as an integer and as another number in a sample.
_INTEGER = r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"
_OTHER_NUMBER = r"(?i)\A[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf|infinity|nan)\z"


def field_of_samples(value: Column, typed: Column) -> Column:
    """An aggregate, the struct (type, size) of the narrowest type that all samples fit. typed: whether a
    sample decides the type; all decide the length. Every sample is of the class 0 to 3 of integers,
    longer integers, other numbers and texts; the largest class is the type. Blank samples decide nothing."""
    text = stripped(value)
    low, high = RANGES["INTEGER"]
    exact = F.regexp_replace(text, "_", "").try_cast("decimal(38,0)")
    kind = (
        F.when(~typed | (text == ""), F.lit(None).cast("int"))
        .when(text.rlike(_INTEGER), F.when(exact.between(low, high), 0).otherwise(1))
        .when(text.rlike(_OTHER_NUMBER), 2)
        .otherwise(3)
    )
    largest = F.coalesce(F.max(kind), F.lit(0))
    name = F.element_at(F.array(*[F.lit(x) for x in ("INTEGER", "BIGINT", "FLOAT", "STRING")]), largest + 1)
    size = F.least(F.greatest(F.max(F.length(value)) + ROOM, F.lit(LEAST_SIZE)), F.lit(LARGEST_SIZE))
    return F.struct(name.alias("type"), F.when(largest == 3, size).alias("size"))
