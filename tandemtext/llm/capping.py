"""Limit what one contributor may hold of a group, keeping its best records.

One aggregate gives every contributor's count and extremes, a second one a histogram of its scores in BINS equal bins between
them; both merge before the shuffle.  The bin in which the limit is reached decides all others.  Only the records of that
borderline bin are ranked, in one distributed sort by contributor, score and key, so that no contributor's records meet in
one task, ties and keys of any type included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtext.operators.distributed import join_small, numbered
from tandemtext.session import checkpointed
from tandemtext.sources.tables import number

#: Bins of a contributor's histogram; records without score have one more.
BINS = 256


def over_limit(df: DataFrame, key: str, group: Column, contributor: Column, score: Column | str, share: Column, least: int = 1) -> DataFrame:
    """The records that must go, as (key, group, contributor).

    ``share`` is the largest share of its group's records one contributor may hold: floor(share x n), at least ``least``,
    with n the distinct records of the group.  The best scores stay; null and NaN scores come last; ties stay by smaller key.
    Records without group or key, or in a group without a share, are left out; records without contributor stay, but count
    in n.  A key met twice counts once; keys may be of any type that can be ordered.  An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("k"), group.alias("g"), contributor.alias("c"), number(score).alias("s"), share.cast("double").alias("share"))
    rows = rows.where("k IS NOT NULL AND g IS NOT NULL AND share IS NOT NULL")
    rows = checkpointed(rows.groupBy("k").agg(F.max_by(F.struct("g", "c", "s", "share"), F.struct("g", "c", "s")).alias("r")).select("k", "r.*"))
    per = rows.groupBy("g", "c").agg(F.count("*").alias("n"), F.max("share").alias("share"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    per = per.withColumn("of", F.sum("n").over(Window.partitionBy("g"))).where("c IS NOT NULL")
    # The product of a decimal share and a count may fall short of a whole number by the last bit of a double.
    limits = per.withColumn("left", F.greatest(F.floor(F.col("share") * F.col("of") + 1e-9), F.lit(least)).cast("long")).where("n > left")
    limits = checkpointed(limits.select("g", "c", "left", "lo", "hi"))
    # Bins descend with the score.
    place = F.when(F.col("s").isNull(), BINS).when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor((F.col("hi") - F.col("s")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).cast("int")
    binned = join_small(rows.drop("share").where("c IS NOT NULL"), limits, ["g", "c"], "k").select("k", "g", "c", "s", "left", place.alias("b"))
    histogram = binned.groupBy("g", "c", "b").agg(F.count("*").alias("m"), F.max("left").alias("left"))
    upto = F.sum("m").over(Window.partitionBy("g", "c").orderBy("b"))
    cut = histogram.withColumn("upto", upto).where("upto > left AND upto - m <= left").select("g", "c", F.col("b").alias("cut"), (F.col("left") - F.col("upto") + F.col("m")).alias("open"))
    marked = checkpointed(join_small(binned.drop("left"), checkpointed(cut), ["g", "c"], "k").where("b >= cut"))
    border = numbered(marked.where("b = cut").select("k", "g", "c", "s", "open"), "at", F.col("g"), F.col("c"), F.col("s").desc_nulls_last(), F.col("k"))
    first = border.groupBy("g", "c").agg(F.min("at").alias("first"))
    gone = join_small(border, first, ["g", "c"], "k").where("at - first >= open").select("k", "g", "c")
    out = marked.where("b > cut").select("k", "g", "c").unionByName(gone)
    return out.select(F.col("k").alias(key), F.col("g").alias("group"), F.col("c").alias("contributor"))
