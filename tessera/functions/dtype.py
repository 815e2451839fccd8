"""Element types: promotion and casts that wrap as typed arrays do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's type for each element type; there is no unsigned byte, so one more bit is used.
SPARK = {"float64": "double", "float32": "float", "int32": "int", "int16": "smallint", "int8": "tinyint", "uint8": "smallint", "bool": "smallint"}
BITS = {"int32": 32, "int16": 16, "int8": 8, "uint8": 8, "bool": 8}
#: From narrow to wide; of equals the left operand's type wins.
WIDTH = {"bool": 0, "int8": 1, "uint8": 1, "int16": 2, "int32": 3, "float32": 4, "float64": 5}


def promote(a: str, b: str) -> str:
    return b if WIDTH[b] > WIDTH[a] else a


def result_type(*kinds) -> str:
    """The type that holds all of ``kinds``: names, or things with a dtype. float64 for none."""
    names = [getattr(k, "dtype", k) for k in kinds]
    for n in names:
        if n not in SPARK:
            raise ValueError(f"unknown element type {n!r}")
    out = names[0] if names else "float64"
    for n in names[1:]:
        out = promote(out, n)
    return out


def wrap(x: Column, kind: str) -> Column:
    """``x`` as elements of ``kind``: integers are cut toward 0 and wrap modulo 2**bits, NaN and infinities become 0; bool is an unsigned byte (2 stays 2)."""
    x = x.cast("double")
    if kind not in SPARK:
        raise ValueError(f"unknown element type {kind!r}")
    if kind not in BITS:
        return x.cast(SPARK[kind])
    size = float(1 << BITS[kind])
    whole = F.when(x >= 0, F.floor(F.least(x, F.lit(9e18)))).otherwise(F.ceil(F.greatest(x, F.lit(-9e18)))).cast("double")
    low = ((whole % size) + size) % size
    if kind not in ("uint8", "bool"):
        low = F.when(low >= size / 2, low - size).otherwise(low)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(low).cast(SPARK[kind])
