"""Writers (S14-S17) over ``DataFrameWriter``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None,
                mode: str = "overwrite") -> None:
    """Parquet (optionally gzip), CSV, TSV without quoting, or text lines
    (a single string column)."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "tsv":
        w.options(sep="\t", quote="", escape="", header=False).csv(path)
    elif fmt == "text":
        w.text(path)
    else:
        raise ValueError(fmt)


def write_freq_tsv(freqs: DataFrame, path: str, n: int = 1) -> None:
    """Frequency file: n tab-separated n-gram parts then the count."""
    parts = F.split("target", " ")
    cols = [F.element_at(parts, i + 1).alias(f"w{i}") for i in range(n)]
    write_table(freqs.select(*cols, F.col("freq").cast("string")), path, fmt="tsv")


def write_lines(df: DataFrame, path: str, array_col: str, compression: str | None = None) -> None:
    """One space-joined line per row (one-sentence-per-line corpora)."""
    write_table(df.select(F.array_join(array_col, " ").alias("value")), path, "text", compression)


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Skip when the output exists."""
    df.write.mode("ignore").format(fmt).save(path)


def write_or_fail(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Raise when the output exists."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S16."""
    df.write.mode("append").format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> None:
    """One output folder per value (period, target, corpus)."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)
