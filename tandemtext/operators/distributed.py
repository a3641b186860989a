"""Sorting, ranking and running sums over whole tables without gathering them in one task.

A table is range-partitioned by a key that is unique (so that no value can be hot), sorted inside its partitions and
checkpointed; after that the partition number and the row's place in it are stable facts.  Only one number per partition
goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtext.session import checkpointed

#: Rows of a smaller side up to which it is broadcast; beyond it the join shuffles, with its keys spread over SALTS parts.
BROADCAST_ROWS, SALTS = 200_000, 32
#: Counts of distinct values up to which a window sums them up.
WINDOW_ROWS = 2_000_000
PARTITION, PLACE = "__partition", "__place"


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """Globally sorted, with the partition's number and the row's place (0, 1, ...) in it."""
    kept = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    return kept.select("*", F.shiftright(at, 33).cast("int").alias(PARTITION), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE))


def _offsets(df: DataFrame, amount: Column) -> Column:
    """For each partition the total of the partitions before it, as a map literal (one entry per partition)."""
    totals = sorted((r[0], r[1]) for r in df.groupBy(PARTITION).agg(F.sum(amount)).collect())
    pairs, before = [], 0
    for part, total in totals:
        pairs += [F.lit(part), F.lit(before)]
        before += total or 0
    if not pairs:
        return F.lit(0)
    return F.element_at(F.create_map(*pairs), F.col(PARTITION))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add the row number (from 1) in the global order."""
    rows = ordered(df, *order)
    return rows.withColumn(name, (_offsets(rows, F.lit(1)) + F.col(PLACE) + 1).cast("long")).drop(PARTITION, PLACE)


def running_sum(df: DataFrame, name: str, amount: Column, *order: Column) -> DataFrame:
    """Add the sum of ``amount`` over all rows before this one in the global order (this row excluded)."""
    rows = ordered(df.withColumn("__amount", amount), *order)
    inside = Window.partitionBy(PARTITION).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("__amount").over(inside) - F.col("__amount")
    return rows.withColumn(name, total + _offsets(rows, F.col("__amount"))).drop(PARTITION, PLACE, "__amount")


def join_small(df: DataFrame, side: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Inner join with a side of unique keys that many rows share: broadcast up to BROADCAST_ROWS rows, else salted.

    ``spread`` is a column of ``df`` by which the rows of one key are spread.
    """
    if side.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), on)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "__salt"]).drop("__salt")


def ranked_in(df: DataFrame, name: str, groups: list[str], key: str, *order: Column) -> DataFrame:
    """Add the row number (from 1) inside each group; a group of any size is sorted over many tasks."""
    rows = checkpointed(numbered(df, "__at", *[F.col(g) for g in groups], *order))
    first = rows.groupBy(*groups).agg(F.min("__at").alias("__first"))
    return join_small(rows, first, groups, key).withColumn(name, F.col("__at") - F.col("__first") + 1).drop("__at", "__first")


def quantiles(df: DataFrame, groups: list[str], points: dict[str, tuple[float, ...]]) -> DataFrame:
    """(groups, one array per metric): exact quantiles, interpolated between neighbours, of the values of each group.

    Equal values are counted first.  Up to WINDOW_ROWS counts are summed up group by group; beyond it they are sorted over many
    tasks, so that neither a group nor its distinct values meet in one.  Null values don't count; a group without values has null for the metric.
    """
    metrics = list(points)
    values = F.array(*[F.struct(F.lit(i).alias("__m"), F.col(m).cast("double").alias("__v")) for i, m in enumerate(metrics)])
    counted = df.select(*groups, F.inline(values)).where("__v IS NOT NULL").groupBy(*groups, "__m", "__v").agg(F.count("*").alias("__n"))
    keys = [*groups, "__m"]
    counted = checkpointed(counted)
    if counted.count() <= WINDOW_ROWS:
        group = Window.partitionBy(*keys)
        placed = counted.withColumn("__upto", F.sum("__n").over(group.orderBy("__v"))).withColumn("__of", F.sum("__n").over(group))
    else:
        summed = checkpointed(running_sum(counted, "__before", F.col("__n"), *[F.col(k) for k in keys], F.col("__v")))
        # One row per group and metric.
        totals = summed.groupBy(*keys).agg(F.min("__before").alias("__first"), F.sum("__n").alias("__of"))
        totals = totals.toDF(*[f"__k{i}" for i in range(len(keys))], "__first", "__of")
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        placed = summed.join(F.broadcast(totals), same).withColumn("__upto", F.col("__before") - F.col("__first") + F.col("__n"))

    def at(p: float) -> Column:
        place = (F.col("__of") - 1) * F.lit(p)
        value = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
        low, high, part = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        return low + (high - low) * part

    every_point = sorted({p for ps in points.values() for p in ps})
    each = placed.groupBy(*keys).agg(*[at(p).alias(f"__p{i}") for i, p in enumerate(every_point)])
    found = each.groupBy(*groups).agg(*[F.array(*[F.max(F.when(F.col("__m") == i, F.col(f"__p{every_point.index(p)}"))) for p in points[m]]).alias(m) for i, m in enumerate(metrics)])
    if not groups:
        return found
    every = df.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups)]).distinct()
    same = [F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(groups)]
    return every.join(found, same, "left").select(*[F.col(f"__k{i}").alias(g) for i, g in enumerate(groups)], *metrics)
