"""Delimited text in, text out: thin wrappers over Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtrail.operators.keyed import col


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read parquet, csv, json, orc or text; ``path`` may hold globs such as ``part-000[0-4]*``."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


FILE_KEYS = ["__file", "__position"]


def read_parquet_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read parquet with a stable identity per row: its file and its position in that file.

    Register it with ``keys=FILE_KEYS``; the identity needs no shuffle and no copy of the data.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__position"))


def parse_lines(lines: DataFrame, schema: T.StructType, separator: str = ",",
                line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split text lines into typed columns.

    Returns (parsed, rejected).  A line is rejected when a field is missing or does not convert;
    trailing extra fields are ignored.  Other columns of ``lines`` (an id) are kept.
    """
    other = [col(c) for c in lines.columns if c != line]
    fields = F.split(col(line), "\\Q" + separator + "\\E")
    texts = [F.get(fields, F.lit(i)) for i in range(len(schema.fields))]
    values = [t if isinstance(f.dataType, T.StringType) else F.trim(t).try_cast(f.dataType)
              for t, f in zip(texts, schema.fields)]
    typed = lines.select(*other, col(line), *[v.alias(f.name) for v, f in zip(values, schema.fields)])
    complete = F.lit(True)
    for f in schema.fields:
        complete = complete & col(f.name).isNotNull()
    return typed.where(complete).drop(line), typed.where(~complete).select(*other, col(line))


def write_lines(df: DataFrame, path: str, separator: str = ",") -> None:
    """Save rows as delimited text lines."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(separator, *parts).alias("value")).write.text(path)
