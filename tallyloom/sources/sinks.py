"""Sinks (2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """K1, K8: parquet, one folder a value; helper columns (prefix _) are dropped."""
    plain = df.drop(*(c for c in df.columns if c.startswith("_")))
    plain.write.mode("overwrite").partitionBy(by).parquet(path)


def write_jsonl(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """K2, K3, K7: JSON lines, at most max_rows a file."""
    w = df.write.mode("overwrite")
    (w.option("maxRecordsPerFile", max_rows) if max_rows else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K5: nested columns become JSON text."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """K4, K6."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, title: str) -> None:
    """K9: a text report of a small result (an aggregate of at most a few thousand rows): a title, then ``name: value`` lines."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce((F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")), F.lit("-"))) for c, t in df.dtypes), F.lit(""))
    head = df.sparkSession.createDataFrame([(f"{title}\n{'=' * len(title)}\n",)], "value string")
    head.unionByName(df.select(lines.alias("value"))).coalesce(1).write.mode("overwrite").text(path)
