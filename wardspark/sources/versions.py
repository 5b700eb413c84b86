"""Tables whose files were written by several versions of their schema, read as one.

Each version's files lie in a folder of their own, so no file is ever changed: a new version adds columns with defaults,
renames, drops or widens them, and ``read`` brings all to the newest. A version's part is a projection of its files, so
filters and the choice of columns go down to each; where a filter contradicts a default the whole version is left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardspark.functions.shared import names

# fixed values: changes of type that lose nothing
WIDER = {
    "tinyint": ["smallint", "int", "bigint", "double"], "smallint": ["int", "bigint", "float", "double"], "int": ["bigint", "double"], "float": ["double"],
    "date": ["timestamp", "timestamp_ntz"], "boolean": [], "bigint": [], "string": [], "double": [], "timestamp": [], "timestamp_ntz": [],
}


class Version(NamedTuple):
    """columns: DDL. defaults: SQL for columns that the version before lacks, over that version's columns (null without
    one). renamed: new names of columns of the version before, by their old ones."""

    columns: str
    defaults: dict[str, str] = {}
    renamed: dict[str, str] = {}


def fits(old: str, new: str) -> bool:
    """Whether a column of one type can become another without loss; decimals if neither side of the point shrinks."""
    if old.startswith("decimal") and new.startswith("decimal"):
        (p, s), (q, t) = ([int(x) for x in d[8:-1].split(",")] for d in (old, new))
        return t >= s and q - t >= p - s
    return old == new or new in WIDER.get(old, [])


def _next(d: DataFrame, old: StructType, version: Version) -> DataFrame:
    """A table of one version as one of the next."""
    new = StructType.fromDDL(version.columns)
    source = {version.renamed.get(c, c): c for c in old.names}
    columns: list[Column] = []
    for f in new:
        kind = f.dataType.simpleString()
        if f.name in source:
            had = old[source[f.name]].dataType.simpleString()
            if not fits(had, kind):
                raise ValueError(f"column {f.name}: {had} does not fit into {kind}")
            columns.append(F.col(f"`{source[f.name]}`").cast(f.dataType).alias(f.name))
        else:
            columns.append(F.expr(version.defaults.get(f.name, "NULL")).cast(f.dataType).alias(f.name))
    return d.select(*columns)


def write(rows: DataFrame, path: str, versions: list[Version], number: int | None = None, mode: str = "append") -> None:
    """Rows of a version (the newest if not said), by the names of their columns; a column that is missing is refused."""
    number = len(versions) if number is None else number
    schema = StructType.fromDDL(versions[number - 1].columns)
    rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).write.mode(mode).parquet(f"{path}/version={number}")


def read(spark: SparkSession, path: str, versions: list[Version]) -> DataFrame:
    """All rows, in the newest schema. A folder of a version that isn't known is refused."""
    there = sorted(int(n.removeprefix("version=")) for n in names(spark, path) if n.startswith("version="))
    if there and there[-1] > len(versions):
        raise ValueError(f"{path} holds version {there[-1]}, known are {len(versions)}")
    schemas = [StructType.fromDDL(v.columns) for v in versions]
    out = spark.createDataFrame([], schemas[-1])
    for k, number in enumerate(there):
        d = spark.read.schema(schemas[number - 1]).parquet(f"{path}/version={number}")
        for n in range(number, len(versions)):
            d = _next(d, schemas[n - 1], versions[n])
        out = d if k == 0 else out.unionByName(d)
    return out
