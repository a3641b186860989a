"""Merging later versions of pairs into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions import text as T


def last_wins(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The row with the largest ``order`` per key: an aggregate, combined before the shuffle, not a window."""
    cols = df.columns
    return df.groupBy(key.alias("__key")).agg(F.max_by(F.struct(*cols), order).alias("r")).select("__key", "r.*")


def upsert(base: DataFrame, news: DataFrame, match: str, replace: list[str], key: str, order: str) -> DataFrame:
    """Update the last base row of each (trimmed) ``match`` text by the last news row of it, and append texts that are new.

    Returns the base's columns plus ``origin``: kept, updated or appended.  Columns that news lack are null in appended rows.
    Null texts match nothing.
    """
    text = T.strip(F.col(match))
    n = last_wins(news.where(text.isNotNull()).select(match, order, *replace), text, F.col(order)).select("__key", *[F.col(c).alias(f"__{c}") for c in replace])
    last = base.where(text.isNotNull()).groupBy(text.alias("__key")).agg(F.max(key).alias("__last"))
    target = n.join(last, "__key", "left")
    changed = base.join(target.where("__last IS NOT NULL").withColumnRenamed("__last", key), key, "left")
    hit = F.col("__key").isNotNull()
    out = changed.select(*[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in replace else F.col(c) for c in base.columns], F.when(hit, "updated").otherwise("kept").alias("origin"))
    added = target.where("__last IS NULL").select(F.col("__key").alias(match), *[F.col(f"__{c}").alias(c) for c in replace if c != match], F.lit("appended").alias("origin"))
    return out.unionByName(added, allowMissingColumns=True)


def replace_source(base: DataFrame, news: DataFrame, column: str, value: str) -> DataFrame:
    """Drop the rows of one source and add the new ones; a null source is another source."""
    return base.where(~F.col(column).eqNullSafe(value)).unionByName(news, allowMissingColumns=True)
