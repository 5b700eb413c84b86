"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splits(df: DataFrame, path: str, label: str, fmt: str = "parquet") -> DataFrame:
    """Writes a folder per split and the counts beside them; returns the counts as read back."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(f"{path}/data")
    back = df.sparkSession.read.format(fmt).load(f"{path}/data")
    stats = back.groupBy("split", label).agg(F.count("*").alias("n"))
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return df.sparkSession.read.json(f"{path}/stats")


def lines(df: DataFrame, path: str) -> None:
    """Lines of JSON."""
    df.write.mode("overwrite").json(path)


def markdown(blocks: DataFrame, counts: dict[str, int]) -> str:
    """A report: counts, then files with their blocks. blocks are bounded by the cap that made them."""
    out, path = ["# Findings", ", ".join(f"{k}: {n}" for k, n in counts.items())], None
    for r in blocks.orderBy("upto").collect():
        if r.filepath != path:
            path = r.filepath
            out.append(f"## {path}")
        out.append(r.block)
    return "\n\n".join(out)


def schema_json(df: DataFrame) -> str:
    return df.schema.json()
