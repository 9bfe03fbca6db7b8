"""Types for functions that are declared before there is a session."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BINARY, LONG, BOOLEAN = T.StringType(), T.BinaryType(), T.LongType(), T.BooleanType()
WIDE = T.DecimalType(38, 0)
FILES = T.ArrayType(T.StructType().add("path", STRING).add("length", LONG))


def struct(**fields: T.DataType) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


def strings() -> T.ArrayType:
    return T.ArrayType(STRING)
