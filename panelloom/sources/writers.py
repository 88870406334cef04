"""Results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_by_key(df: DataFrame, path: str, key: str = "norm_years") -> None:
    """One folder per value of ``key``, the counterpart of one sheet per norm. Only the folders of values in ``df`` are
    written anew; those of other values stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Tidy results ``(spec, norm_years, term, ...)``; reading one norm scans one folder."""
    write_by_key(df, path, "norm_years")
