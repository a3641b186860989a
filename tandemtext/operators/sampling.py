"""Seeded samples and splits: one deterministic order by hash, never a random generator.

Rows are ordered by ``md5(key|seed)``.  Ranks within large strata are found without gathering a stratum: rows are counted by
hash prefix, the prefix in which the wanted rank lies is found from the counts, and only rows in it are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drawn(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def ranked(df: DataFrame, key: str, strata: list[str], seed: int = 42) -> DataFrame:
    """Add ``rank`` (from 1, by drawn order, ties by key) and ``size`` of the stratum.

    The rank is the number of rows in smaller hash prefixes plus the rank within the row's own; a window holds one prefix of
    one stratum (a 4096th of it) at most.  Null strata are strata of their own.
    """
    rows = df.withColumn("__h", drawn(key, seed)).withColumn("__p", F.substring("__h", 1, 3))
    counts = rows.groupBy(*strata, "__p").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    before = counts.select(F.col("__p").alias("__bp"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(strata)], (F.sum("__n").over(w.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("size"))
    on = F.col("__bp") == F.col("__p")
    for i, c in enumerate(strata):
        on = on & F.col(f"__b{i}").eqNullSafe(F.col(c))
    joined = rows.join(before, on).drop("__bp", *[f"__b{i}" for i in range(len(strata))])
    inside = F.row_number().over(W.partitionBy(*strata, "__p").orderBy("__h", key))
    return joined.withColumn("rank", F.col("__before") + inside).drop("__h", "__p", "__before")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of the drawn order (a bounded top-n)."""
    return df.withColumn("__h", drawn(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def split(df: DataFrame, key: str, strata: list[str], seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """train, validation and test of exact sizes per stratum; strata under ten rows are all train."""
    r = ranked(df, key, strata, seed)
    a, b = F.round(F.col("size") * train), F.round(F.col("size") * (train + validation))
    part = F.when((F.col("size") < 10) | (F.col("rank") <= a), "train").when(F.col("rank") <= b, "validation").otherwise("test")
    return r.withColumn("split", part).drop("rank", "size")


def quotas(counts: dict[str, int], n: int) -> dict[str, int]:
    """Whole quotas in proportion to the counts, at least 1 each, that add up to n (or to all rows, if there are fewer)."""
    total = sum(counts.values())
    n = min(n, total)
    q = {k: min(c, max(1, round(n * c / total))) for k, c in counts.items() if c}
    while sum(q.values()) != n:
        if sum(q.values()) > n:
            k = max((k for k in q if q[k] > 1), key=lambda k: (q[k], k), default=None)
            if k is None:
                break
            q[k] -= 1
        else:
            k = max((k for k in q if q[k] < counts[k]), key=lambda k: (counts[k] / (q[k] + 1), k))
            q[k] += 1
    return q


def quota_draw(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """A proportional sample of n rows; the strata (labels, a bounded number) are counted on the driver."""
    rows = df.where(F.col(stratum).isNotNull())
    q = quotas({r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}, n)
    want = F.lit(0)
    for k, v in q.items():
        want = F.when(F.col(stratum) == k, v).otherwise(want)
    return ranked(rows, key, [stratum], seed).where(F.col("rank") <= want).drop("rank", "size")
