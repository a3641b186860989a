"""Repetition inside one text, measured in one projection without user functions.

A table of thresholds is compiled into a single projection: length, symbols, stop words, repeated lines and the share of
words in passages that came earlier in the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.text import bound

#: Words in a passage that count as said again.
PASSAGE = 4
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it on with as was at by be this from are der die das und ist von zu mit auf für im den nicht "
    "le la les des et est une un que dans pour du en pas el los las y es por con para se del una"
).split()
#: (flag, measure, comparison, threshold).  Each line becomes one Boolean column of the projection.
THRESHOLDS = (
    ("repeated", "repeated_share", ">", 0.3),
    ("too_short", "words", "<", 4),
    ("too_long", "words", ">", 100_000),
    ("symbols", "symbol_ratio", ">", 0.1),
    ("few_stop_words", "stop_ratio", "<", 0.05),
    ("repeated_lines", "repeated_line_ratio", ">", 0.3),
)


def plain_words(text: Column) -> Column:
    """Words in lower case; punctuation separates (an apostrophe does not), every digit is a 0."""
    s = F.lower(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, r"['’]", ""), r"\p{Nd}", "0")
    s = F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def _covered(words: Column) -> Column:
    """Words lying in passages of PASSAGE words whose like starts earlier in the text."""
    grams = bound(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (PASSAGE - 1), F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, *[F.get(h, i + n) for n in range(1, PASSAGE)]).alias("g"), i.alias("p")),
        ),
    )
    again = bound(
        F.sort_array(grams),
        lambda s: F.filter(F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["g"] == x["g"]), x["p"])), lambda p: p.isNotNull()),
    )
    # Sorted places p1 < p2 < ...: each passage adds what the next one does not cover.
    return bound(
        F.sort_array(again),
        lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(PASSAGE)), F.lit(PASSAGE))), F.lit(0), lambda a, x: a + x),
    )


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text, as columns."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = plain_words(text)
    return {
        "words": F.size(words),
        "repeated_words": _covered(words),
        "symbol_ratio": F.regexp_count(t, F.lit(r"[#{}\[\]|<>~\\^*_=]|…|\.{3}")) / F.greatest(F.size(words), F.lit(1)),
        "stop_ratio": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))) / F.greatest(F.size(words), F.lit(1)),
        "repeated_line_ratio": bound(lines, lambda x: 1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))),
    }


def repetition(df: DataFrame, key: str, text: str, only: tuple[str, ...] = ()) -> DataFrame:
    """key, the measures, and one flag per line of THRESHOLDS.

    Null, empty and blank texts have no words, share 0 and no ``repeated`` flag.  Rows that are the same stay apart; the
    result has as many rows as the input.  ``only`` names the measures wanted (others are not computed).
    """
    m = measures(F.col(text))
    need = {x for x in (only or m) if x in m} | ({"words", "repeated_words"} if not only or "repeated_share" in only else set())
    out = df.select(F.col(key), *[m[x].alias(x) for x in m if x in need])
    if "repeated_words" in need:
        out = out.withColumn("repeated_share", F.col("repeated_words") / F.greatest(F.col("words"), F.lit(1)))
    flags = [(F.col(c) > v if op == ">" else F.col(c) < v).alias(flag) for flag, c, op, v in THRESHOLDS if c in out.columns]
    return out.select("*", *flags)
