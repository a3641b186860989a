"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *key: str) -> DataFrame:
    """Count redelivered records once.  A redelivery has the same content, so project to the needed columns first."""
    return df.dropDuplicates(list(key))


def label(c: Column | str) -> Column:
    """One spelling per label: lower case, no outer blanks, separators as ``_``; blank labels become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))), r"-", "_"), F.lit(""))


def split_label(c: Column | str) -> Column:
    """train, validation or test, however abbreviated; anything else is null."""
    s = label(c)
    return (
        F.when(s.startswith("tr"), "train")
        .when(s.startswith("val") | s.isin("dev"), "validation")
        .when(s.startswith("te"), "test")
    )


def number(c: Column | str) -> Column:
    """A double in which NaN and infinities are null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
