"""Sources (2.1): one reader for every layout, schemas declared and never inferred where they are known."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CUSTOM = T.StructType([T.StructField(n, t) for n, t in (("instruction", T.StringType()), ("chosen", T.StringType()), ("reject", T.StringType()), ("label", T.IntegerType()), ("margin", T.DoubleType()))])
PREFERENCES = T.StructType([*(T.StructField(n, T.ArrayType(MESSAGE)) for n in ("prompt", "chosen", "rejected")), T.StructField("dimension", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("score_chosen", "score_rejected", "margin")), T.StructField("source_dataset", T.StringType())])

#: Extension -> format and options.
FORMATS = {"parquet": ("parquet", {}), "jsonl": ("json", {}), "json": ("json", {}), "csv": ("csv", {"header": "true"}), "txt": ("text", {}), "orc": ("orc", {})}


def resolve(spec: str) -> str:
    """``name@subdir`` is a folder of a data set."""
    name, _, sub = spec.partition("@")
    return f"{name}/{sub}" if sub else name


def read_any(spark: SparkSession, spec: str, schema: T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """The format by extension; a folder by the first known extension inside it; multiline for one JSON array."""
    path = resolve(spec)
    ext = PurePosixPath(path).suffix.lstrip(".")
    if ext not in FORMATS:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
        found = sorted({n.rsplit(".", 1)[-1] for n in (f.getPath().getName() for f in files) if n[0] not in "._"} & set(FORMATS), key=list(FORMATS).index)
        if not found:
            raise ValueError(f"no readable file under {path}")
        ext = found[0]
    fmt, options = FORMATS[ext]
    r = spark.read.format(fmt).options(**options)
    if ext in ("json", "jsonl") and multiline:
        r = r.option("multiLine", "true")
    return (r.schema(schema) if schema else r).load(path)


def unwrap(df: DataFrame, name: str) -> Column:
    """B1: first message's content of a conversation, or the value as text."""
    kind = df.schema[name].dataType
    return F.try_element_at(name, F.lit(1))["content"] if isinstance(kind, T.ArrayType) else F.col(name).cast("string")


def preference_tuples(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected", limit: int | None = None) -> DataFrame:
    """A3, A4: (prompt, chosen, rejected) from either layout under any key names."""
    out = df.select(unwrap(df, prompt).alias("prompt"), unwrap(df, chosen).alias("chosen"), unwrap(df, rejected).alias("rejected"))
    return out if limit is None else out.limit(limit)


def transcripts(df: DataFrame, text: str = "chosen") -> DataFrame:
    """Df with messages, prompt, response and usable (the last turn is the assistant's)."""
    marker = r"\n\n(?:Human|Assistant):\s*"
    roles = F.transform(F.regexp_extract_all(text, F.lit(r"\n\n(Human|Assistant):\s*"), F.lit(1)), lambda r: F.when(r == "Human", "user").otherwise("assistant"))
    parts = F.transform(F.slice(F.split(text, marker), 2, 1_000_000), lambda c: F.btrim(c, F.lit(" \n\t\r")))
    m = F.zip_with(roles, parts, lambda r, c: F.struct(r.alias("role"), c.alias("content")))
    d = df.withColumn("messages", m)
    return d.withColumns({"prompt": F.when(F.size("messages") > 0, F.slice("messages", 1, F.greatest(F.lit(0), F.size("messages") - 1))), "response": F.try_element_at("messages", F.lit(-1))["content"], "usable": F.coalesce(F.try_element_at("messages", F.lit(-1))["role"] == "assistant", F.lit(False))})


def embeddings(spark: SparkSession, spec: str, column: str = "embedding") -> tuple[DataFrame, int]:
    """A table of embeddings and their dimension, taken from its first row and required of all others."""
    df = read_any(spark, spec)
    first = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    d = first[0] if first else 0
    fits = F.when(F.size(column) == d, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {d} but "), F.size(column).cast("string"))))
    return df.where(F.col(column).isNotNull()).withColumn(column, fits), d
