"""A sample whose buckets have given shares in several dimensions at once.

Inclusion probabilities come from iterative proportional fitting of the (few) cell counts to the target shares.  Rows are
put in random order inside their cells, the cells in sorted order; along the running sum of probabilities one random start
selects each row in whose interval a whole number falls.  Every cell so gets its expected number of rows up to rounding.
Buckets below their floor are then filled up in the same random order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.operators.distributed import running_sum
from tandemtext.session import checkpointed

FITTING_ROUNDS = 200
#: Achieved shares within this of the target count as met.
TOLERANCE = 0.005


@dataclass(frozen=True)
class Target:
    dimension: str
    bucket: str
    share: float
    floor: int


def _probabilities(cells: dict[tuple, int], dims: list[str], targets: list[Target], size: int) -> dict[tuple, float]:
    """Fit cell masses to the target shares, then turn them into probabilities of at most 1."""
    share = {(t.dimension, t.bucket): t.share for t in targets}
    mass = {c: float(n) for c, n in cells.items() if all(share.get((d, b), 0) > 0 for d, b in zip(dims, c))}
    if not mass or size <= 0:
        return dict.fromkeys(cells, 0.0)
    top = {c: float(cells[c]) for c in mass}
    total = float(min(size, sum(top.values())))
    for _ in range(FITTING_ROUNDS):
        for i, d in enumerate(dims):
            now: dict[str, float] = {}
            for c, m in mass.items():
                now[c[i]] = now.get(c[i], 0.0) + m
            mass = {c: min(top[c], m * share[(d, c[i])] * total / now[c[i]]) if now[c[i]] > 0 else 0.0 for c, m in mass.items()}
    short = total - sum(mass.values())
    for _ in range(FITTING_ROUNDS):  # what capped cells cannot give, the others do
        room = sum(m for c, m in mass.items() if m < top[c])
        if short <= 1e-9 or room <= 0:
            break
        mass = {c: min(top[c], m * (1 + short / room)) if m < top[c] else m for c, m in mass.items()}
        short = total - sum(mass.values())
    return {c: mass.get(c, 0.0) / n for c, n in cells.items()}


def quota_sample(df: DataFrame, key: str, dims: dict[str, Column], targets: list[Target], size: int | None = None, fraction: float = 0.25, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``dims`` names the bucket column of each dimension.  ``size`` defaults to ``fraction`` of the eligible rows.  A row is
    eligible if every dimension gives it a bucket that has a target; rows with a null key or bucket are not, and a key met
    twice counts once.  sample: key, one column per dimension, ``inclusion_probability``, ``selected_by`` (``systematic``
    or ``floor``).  report: one row per target with what was available, taken and missed, and why.  An empty table gives an
    empty sample and a report in which no target is met.
    """
    spark, names = df.sparkSession, list(dims)
    known = {d: {t.bucket for t in targets if t.dimension == d} for d in names}
    rows = df.select(F.col(key).alias("k"), *[c.alias(f"__d{i}") for i, c in enumerate(dims.values())]).where("k IS NOT NULL")
    for i, d in enumerate(names):
        rows = rows.where(F.col(f"__d{i}").isin(*known[d])) if known[d] else rows.where("false")
    d_cols = [f"__d{i}" for i in range(len(names))]
    rows = checkpointed(rows.groupBy("k").agg(F.max(F.struct(*d_cols)).alias("r")).select("k", "r.*"))
    # At most one row per combination of buckets comes to the driver.
    cells = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*d_cols).count().collect()}
    n = sum(cells.values())
    size = int(n * fraction) if size is None else size
    chance = _probabilities(cells, names, targets, size)
    table = spark.createDataFrame([(*c, float(p)) for c, p in chance.items()], T.StructType([*(T.StructField(d, T.StringType()) for d in d_cols), T.StructField("p", T.DoubleType())]))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k").cast("string")))
    rows = rows.join(F.broadcast(table), d_cols).withColumn("drawn", drawn)
    start = (int(seed) * 2654435761 % 2**32) / 2**32
    summed = running_sum(rows, "before", F.col("p"), *[F.col(c) for c in d_cols], F.col("drawn"), F.col("k"))
    crossed = F.floor(F.col("before") + F.col("p") + start) > F.floor(F.col("before") + start)
    marked = checkpointed(summed.withColumn("taken", crossed))
    taken = {tuple(r[:-1]): r[-1] for r in marked.where("taken").groupBy(*d_cols).count().collect()}
    extra, by_floor = [], False
    floors = [t for t in targets if t.floor > 0]
    picked = marked.where("taken").select("k", *d_cols, "p", F.lit("systematic").alias("selected_by"))
    for t in floors:
        i = names.index(t.dimension)
        lack = t.floor - sum(m for c, m in taken.items() if c[i] == t.bucket)
        if lack > 0:
            # No more than a floor's rows are ever needed, so this is a bounded top-k.
            more = marked.where(~F.col("taken") & (F.col(d_cols[i]) == t.bucket))
            for e in extra:
                more = more.join(e.select("k"), "k", "left_anti")
            more = checkpointed(more.orderBy("drawn", "k").limit(lack).select("k", *d_cols, "p", F.lit("floor").alias("selected_by")))
            extra.append(more)
            for r in more.groupBy(*d_cols).count().collect():
                by_floor = True
                taken[tuple(r[:-1])] = taken.get(tuple(r[:-1]), 0) + r[-1]
    sample = reduce(DataFrame.unionByName, extra, picked)
    sample = sample.select(F.col("k").alias(key), *[F.col(c).alias(d) for c, d in zip(d_cols, names)], F.col("p").alias("inclusion_probability"), "selected_by")
    whole, lines = sum(taken.values()), []
    for t in targets:
        i = names.index(t.dimension)
        there = sum(m for c, m in cells.items() if c[i] == t.bucket)
        got = sum(m for c, m in taken.items() if c[i] == t.bucket)
        share = got / whole if whole else 0.0
        floor_met, share_met = got >= t.floor, whole > 0 and abs(share - t.share) <= max(TOLERANCE, 1.0 / max(whole, 1))
        why = None if floor_met and share_met else "no rows" if not there else "too few rows for the floor" if not floor_met else "all rows taken" if got == there else "limited by other targets" if share < t.share else "floors take more" if by_floor else "other targets lack rows"
        lines.append((t.dimension, t.bucket, float(t.share), int(t.floor), int(there), int(got), round(share, 6), bool(floor_met), bool(share_met), why))
    schema = "dimension string, bucket string, target_share double, min_rows int, available long, sampled long, achieved_share double, floor_met boolean, share_met boolean, reason string"
    return sample, spark.createDataFrame(lines, schema)


def read_targets(df: DataFrame) -> list[Target]:
    """Targets from the (fixed, small) table of targets."""
    return [Target(r["dimension"], r["bucket"], float(r["target_share"] or 0), int(r["min_rows"] or 0)) for r in df.collect() if r["dimension"] is not None and r["bucket"] is not None]


def ratio_bucket(c: Column, bounds: list[tuple[str, float | None, float | None]]) -> Column:
    """The bucket from its lower bound (included) to its upper bound (excluded); a null bound is open."""
    out = F.lit(None).cast("string")
    for name, low, high in bounds:
        inside = c.isNotNull()
        if low is not None:
            inside = inside & (c >= F.lit(float(low)))
        if high is not None:
            inside = inside & (c < F.lit(float(high)))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out
