"""One ranking of items from several scores on unlike scales.

Every score is replaced by its mid-rank (so only its order counts, whatever its range or distribution), the correlation
matrix of the ranks is one distributed aggregate, and items are sorted by their projection on its first principal
component.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.operators.distributed import numbered, running_sum
from tandemtext.session import checkpointed
from tandemtext.sources.tables import number

#: Distinct values up to which the table of ranks (about 40 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_VALUES = 200_000
#: A value is hot when it holds more than this share of a score's rows; there can be no more than its inverse of them.
HOT_SHARE, SALTS = 0.001, 64


def fraction(c: Column | str) -> Column:
    """A score that should lie in [0, 1]: percentages are brought back to it, impossible values become null."""
    v = number(c)
    return F.when(v.between(0, 1), v).when((v > 1) & (v <= 100), v / 100)


def _long(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).alias("v")) for i, c in enumerate(scores)])
    return df.select(F.col(key), F.inline(pairs)).where("v IS NOT NULL")


def midranks(values: DataFrame) -> DataFrame:
    """(s, v) rows to (s, v, n, u): u is the mid-rank of v among the rows of score s, scaled to (0, 1).

    Equal values are counted before they are sorted, so a value that most rows have is one row here.
    """
    counted = values.groupBy("s", "v").agg(F.count("*").alias("n"))
    summed = checkpointed(running_sum(counted, "before", F.col("n"), F.col("s"), F.col("v")))
    totals = {r["s"]: (r["first"], r["n"]) for r in summed.groupBy("s").agg(F.min("before").alias("first"), F.sum("n").alias("n")).collect()}
    u = F.lit(None).cast("double")
    for s, (first, n) in totals.items():
        u = F.when(F.col("s") == s, (F.col("before") - first + F.col("n") / 2) / n).otherwise(u)
    return summed.select("s", "v", "n", u.alias("u"))


def with_midranks(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """(key, u0, u1, ...): the scaled mid-rank of each score, null where the score is."""
    rows = _long(df, key, scores)
    ranks = checkpointed(midranks(rows.select("s", "v")))
    if ranks.count() <= BROADCAST_VALUES:
        joined = rows.join(F.broadcast(ranks.drop("n")), ["s", "v"])
    else:
        totals = ranks.groupBy("s").agg(F.sum("n").alias("all"))
        hot = ranks.join(F.broadcast(totals), "s").where(F.col("n") > HOT_SHARE * F.col("all")).select("s", "v", F.lit(True).alias("hot"))
        salted = rows.join(F.broadcast(hot), ["s", "v"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(0))
        spread = ranks.join(F.broadcast(hot), ["s", "v"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        joined = salted.drop("hot").join(spread.drop("hot", "n").withColumn("salt", F.col("salt").cast("long")), ["s", "v", "salt"])
    wide = joined.groupBy(key).agg(*[F.max(F.when(F.col("s") == i, F.col("u"))).alias(f"u{i}") for i in range(len(scores))])
    return df.select(key).join(wide, key, "left")


def loadings(ranks: DataFrame, directions: list[int]) -> tuple[list[float], list[float], list[float]]:
    """First principal component of the ranks' correlation matrix: (loadings, means, deviations).

    A missing rank counts as the mean.  An eigenvector has no sign of its own: the whole vector is turned so that it agrees
    with the declared directions, in sum.  A score that runs against its direction keeps its loading; ``v * direction < 0``
    tells such a conflict.
    """
    k = len(directions)
    u = [F.coalesce(F.col(f"u{i}"), F.lit(0.5)) for i in range(k)]
    sums = [F.avg(x) for x in u] + [F.avg(u[i] * u[j]) for i in range(k) for j in range(i, k)]
    got = [float(x) if x is not None else 0.0 for x in ranks.agg(*[s.alias(f"a{n}") for n, s in enumerate(sums)]).first()]
    mean = np.array(got[:k])
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = got[k:]
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    dev = np.sqrt(np.clip(np.diag(cov), 0, None))
    flat = dev < 1e-9
    scale = np.where(flat, 1.0, dev)
    corr = np.where(np.outer(flat, flat) | flat[:, None] | flat[None, :], 0.0, cov / np.outer(scale, scale))
    vector = np.linalg.eigh(corr)[1][:, -1] if not flat.all() else np.ones(k) / np.sqrt(k)
    turn = -1.0 if float(vector @ np.array(directions)) < 0 else 1.0
    return [float(v) * turn for v in vector], mean.tolist(), scale.tolist()


def principal_ranking(df: DataFrame, key: str, scores: Mapping[str, int]) -> DataFrame:
    """Rank items by the first principal component of their rank-transformed scores.

    ``scores`` maps each score column to +1 (more is better) or -1.  Result: key, ``rank_position`` (1 is best, no gaps),
    ``projection``, one ``<score>_rank`` in (0, 1) per score and ``scores_present``.  Null, NaN and infinite scores count
    as an average rank; an item with none of them projects to 0 apart from rounding.  Equal projections are ordered by key.
    Items with a null key are left out; repeated keys count once.  An empty table gives an empty ranking.
    """
    names = list(scores)
    items = df.where(F.col(key).isNotNull()).select(F.col(key), *[number(c).alias(f"__{i}") for i, c in enumerate(names)])
    items = checkpointed(items.groupBy(key).agg(*[F.max(f"__{i}").alias(f"__{i}") for i in range(len(names))]))
    ranks = checkpointed(with_midranks(items, key, [f"__{i}" for i in range(len(names))]))
    load, mean, dev = loadings(ranks, list(scores.values()))
    projection = sum((F.lit(w) * (F.coalesce(F.col(f"u{i}"), F.lit(m)) - F.lit(m)) / F.lit(d) for i, (w, m, d) in enumerate(zip(load, mean, dev))), F.lit(0.0))
    scored = ranks.select(
        key,
        F.round(projection, 9).alias("projection"),
        *[F.col(f"u{i}").alias(f"{c}_rank") for i, c in enumerate(names)],
        sum((F.col(f"u{i}").isNotNull().cast("int") for i in range(len(names))), F.lit(0)).alias("scores_present"),
    )
    return numbered(scored, "rank_position", F.col("projection").desc(), F.col(key).asc())
