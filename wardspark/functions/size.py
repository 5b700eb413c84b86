"""Broadcasting behind a check of the size in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: What may be broadcast, and what a row and a number take beside their contents.
MAX_BYTES, ROW, NUMBER = 32 << 20, 32, 16


def bytes_of(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + NUMBER
    if isinstance(kind, ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(NUMBER).cast("long"), lambda s, x: s + bytes_of(x, kind.elementType)), F.lit(NUMBER))
    if isinstance(kind, MapType):
        return bytes_of(F.map_keys(c), ArrayType(kind.keyType)) + bytes_of(F.map_values(c), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((bytes_of(c.getField(f.name), f.dataType) for f in kind), F.lit(NUMBER))
    return F.lit(NUMBER)


def counted(df: DataFrame) -> int:
    """Bytes of all rows, by one pass."""
    row = sum((bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW))
    return int(df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0])


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it takes at most so many bytes; else as it is, for a join by a shuffle."""
    return F.broadcast(df) if counted(df) <= (MAX_BYTES if most is None else most) else df
