"""Texts cut off by a field limit or a broken transfer, found with built-in SQL functions only.

Every word trigram of the corpus is counted by whether its last word goes on (internal) or closes a sentence, line or text
(terminal), over distinct texts: copies of a text are one, and a text's own end is no evidence for itself.  A last word that
is only the beginning of longer words after the same two words is internal as often as those are.  The final trigrams of the
texts are joined to these counts.  An end without punctuation is a cut unless its trigram is terminal as a rule (a sign-off);
an end with punctuation is one if its trigram is frequent inside texts but almost never terminal.  Trigrams that stand
nowhere else fall back to their last two words, list entries to these or to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.session import written

#: Distinct final n-grams (about 100 bytes each) up to which they are broadcast to the counting; beyond it all are counted.
BROADCAST_KEYS = 1_000_000
#: Shares of terminal occurrences, the same at every size of the corpus.  Without punctuation an end is whole if its trigram
#: is terminal this often; a list entry if its last words are now and then; with punctuation it is cut if they almost never
#: are (one terminal and one internal occurrence are added to the counts, so fifty internal ones are needed).
ALWAYS, SOMETIMES, NEVER = 0.5, 0.003, 0.02

#: What stands for a missing text, what tools put at a cut, how letters are closed.
PLACEHOLDER = r"(?iU)^\W*(?:n/?a|nan|null|none|nil|empty|missing|placeholder|tbd|todo|no (?:output|answer|response|text|content)|(?:ai|human|rewritten|original|output|humanized) ?(?:text|version|output)?\s*:|<?br\s*/?>?|&?nbsp;?)?\W*$"
MARKER = r"(?iU)(?:…|\.\.\.|\[(?:…|\.{3}|truncated|continued|cut|snip|more)[^\]\w]*\]?|\((?:continued|cont|truncated|more)[^)\w]*\)?|(?:…|\.{3})?\s*\b(?:read more|show more|see more)|<[a-z/]{0,6}|&[a-z#0-9]{0,7}|�)\s*$"
CLOSING = r"(?iU)(?:regards|wishes|thanks|sincerely|cheers|yours|best|grüße|grüßen|gruß|saludos?|atentamente|cordialement|vous|amicalement|cordialmente),?\s+(?:\S+\s*){1,5}$"
SENTENCE_END = r"(?U)[.!?。！？](?:[\"'”’»“)\]*_]|\s)*$"
ADDRESS = r"(?iU)(?:\b(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|\S+@\S+\.[a-z]{2,}|\b\d+\s?[a-z]?,? (?:[\w'-]+ ){1,2}(?:street|road|lane|close|avenue|way|drive|court)|\b[\w-]+(?:straße|strasse|weg|gasse|platz) \d+\s?[a-z]?)$"
EMOJI = r"(?:[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]|[:;]-?[)D(P])+\s*$"
LIST_ITEM = r"(?U)(?:^|\s)(?:[-*•–]|\d{1,2}[.)])\s+[^.!?\n]{1,70}$"

BREAK = "¶"
#: Characters that close a sentence or line, characters that only part words, and invisible ones.
CLOSERS, PARTERS, INVISIBLE = ".!?:;…•*\n\r\u2028\u2029", ",()[]{}<>\"“”„«»_/\\|#+=~^%$€&@\t\u00a0", "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Characters of a text's end that are looked at; the longest sign-off, address or list entry is far shorter.
TAIL = 240


def _bare(text: Column) -> Column:
    """The text without white space and invisible characters at its end."""
    return F.rtrim(text, F.lit(" \t\n\r\f\v\u00a0\u2003\u2009" + INVISIBLE))


def _tidy(tail: Column) -> Column:
    """Entities, line-break tags and invisible characters of a text's end put right; no white space at the end."""
    t = F.translate(tail, INVISIBLE + "\u00a0", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)&hellip;", "…"), r"(?i)&nbsp;|<br\s*/?>", " ")
    return F.regexp_replace(t, r"(?U)\s+$", "")


def _tokens(text: Column) -> Column:
    """Words in lower case with BREAK where a sentence, line or list item ends; two breaks lead, one follows.

    Only plain replacements, no patterns: this runs over every character of the corpus.
    """
    t = F.replace(F.replace(text, F.lit("\n- "), F.lit("\n")), F.lit(" - "), F.lit(BREAK))
    t = F.translate(F.lower(t), CLOSERS + PARTERS + "’" + INVISIBLE, BREAK * len(CLOSERS) + " " * len(PARTERS) + "'")
    t = F.replace(t, F.lit(BREAK), F.lit(f" {BREAK} "))
    return F.array_remove(F.split(F.concat(F.lit(f"{BREAK} {BREAK} "), t, F.lit(f" {BREAK}")), " "), "")


def _state(t: Column, size: Column) -> Column:
    """What the (tidied) end of a text of so many characters says by itself."""
    bare = F.regexp_replace(t, EMOJI, "")
    return (
        F.when(t.isNull() | ((size <= TAIL) & F.rlike(t, F.lit(PLACEHOLDER))), "blank")
        .when(F.rlike(F.right(t, F.lit(8)), F.lit(SENTENCE_END)) & ~F.right(t, F.lit(6)).contains("..."), "closed")
        .when(F.rlike(F.right(t, F.lit(40)), F.lit(MARKER)), "marked")
        .when((bare != t) & (F.length(F.trim(bare)) > 0), "closed")
        .when(F.rlike(t, F.lit(ADDRESS)), "address")
        .when(F.rlike(t, F.lit(LIST_ITEM)), "item")
        .otherwise("open")
    )


def _same(text: Column) -> Column:
    """Equal for texts that differ in case, in blanks and line breaks only."""
    t = F.lower(text)
    for c in (" ", "\n", "\r", "\t"):
        t = F.replace(t, F.lit(c), F.lit(""))
    return F.xxhash64(t)


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are used later on (a projection would repeat them)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _times(said: Column, *words: str) -> Column:
    """How often some words stand at an end in a text of such words."""
    wanted = F.concat(F.lit(" "), F.concat_ws(" ", *words), F.lit(f" {BREAK}"))
    return F.round((F.length(said) - F.length(F.replace(said, wanted, F.lit("")))) / F.length(wanted)).cast("long")


def _start(*before: str) -> Column:
    """The key of all words with the same first letter after the same words."""
    return F.xxhash64(*before, F.left("c", F.lit(1)))


def _grams(texts: DataFrame) -> DataFrame:
    """(part, a, b, c, d): every word c with its neighbours in (text, copies) rows; a text in so many copies counts once."""
    w = texts.select(_tokens(F.col("text")).alias("w"), (1 / F.col("copies")).alias("part"))
    some = lambda n: F.slice("w", n, F.size("w") - 3)
    return w.select("part", F.inline(F.arrays_zip(some(1).alias("a"), some(2).alias("b"), some(3).alias("c"), some(4).alias("d")))).where(F.col("c") != BREAK)


def _summed(rows: DataFrame) -> DataFrame:
    """(h, inside, last) of (h, on, part) rows; ``on`` tells whether the n-gram goes on there."""
    amount = lambda on: F.round(F.sum(F.when(F.col("on") == on, F.col("part")).otherwise(0.0))).cast("long")
    return rows.groupBy("h").agg(amount(True).alias("inside"), amount(False).alias("last"))


def asked_counts(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(h, inside, last) of the final n-grams of ``ends``, which are broadcast: how often each goes on and closes.

    For two and three words, an n-gram whose last word begins longer words goes on where these stand.
    """
    two = ends.select(F.col("s2").alias("s"), F.col("c").alias("begin"), F.col("h2").alias("h"))
    one = ends.where("state = 'item'").select(F.col("s1").alias("s"), F.col("c").alias("begin"), F.col("h1").alias("h"))
    three = ends.select(F.xxhash64("a", "h2").alias("s3"), "h3").distinct()
    words = one.select(F.col("s").alias("s1"), F.lit(True).alias("is1")).distinct()
    grams = _grams(texts).withColumn("s1", F.xxhash64("c")).join(F.broadcast(words), "s1", "left")
    # Plain arrays with nulls: array_compact would leave generated code.
    starts = F.array(_start("b"), F.when(F.col("is1"), F.col("s1")))
    met = grams.select("a", "c", "d", "part", F.explode(starts).alias("s")).join(F.broadcast(two.union(one).distinct()), "s").where(F.startswith("c", "begin"))
    met = met.select("part", "h", F.xxhash64("a", "h").alias("s3"), ((F.col("d") != BREAK) | (F.col("c") != F.col("begin"))).alias("on"))
    met = met.join(F.broadcast(three), "s3", "left")
    return _summed(met.select("part", "on", F.explode(F.array("h", "h3")).alias("h")).where("h IS NOT NULL"))


def all_counts(texts: DataFrame) -> DataFrame:
    """The same of every n-gram of the corpus and every beginning of its last word."""
    level = lambda n, before: F.struct(F.lit(n).alias("level"), before.alias("before"))
    levels = F.array(level(1, F.lit(0).cast("long")), level(2, F.xxhash64("b")), level(3, F.xxhash64("a", "b")))
    counted = _grams(texts).select(F.inline(levels), "c", (F.col("d") != BREAK).alias("on"), "part")
    counted = counted.groupBy("level", "before", "c", "on").agg(F.sum("part").alias("part"))
    more = (F.col("level") > 1) & (F.char_length("c") > 1)
    begins = F.when(more, F.transform(F.sequence(F.lit(1), F.char_length("c") - 1), lambda n: F.struct(F.left("c", n).alias("p"), F.lit(True).alias("on")))).otherwise(F.array().cast("array<struct<p:string,on:boolean>>"))
    spread = counted.select("level", "before", "part", F.inline(F.concat(F.array(F.struct(F.col("c").alias("p"), "on")), begins)))
    return _summed(spread.select(F.xxhash64("level", "before", "p").alias("h"), "on", "part"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """Flag every text in (key, text) rows: (key, state, rule, cut).

    ``key`` may be a struct; equal keys stay apart.  Null, empty, blank and placeholder texts are not cut.  ``state`` is what
    the end looks like: blank, marked, closed, address, item or open; ``rule`` what shows the cut: ``trigram`` (or its last
    words), ``unseen`` (no punctuation, and the last two words stand nowhere else) or ``marker`` (a mark put at the cut, which
    the counts alone don't show).  Numbers at the end of a closed text are no evidence, and a closing formula speaks for a
    signature that is seen once.  An empty table gives an empty result.
    """
    # Whole texts are counted below; for the end itself the end is enough.
    ends = _fixed(texts.select("key", "text"), bare=_bare(F.col("text")))
    ends = _fixed(ends, same=_same(F.col("bare")), size=F.char_length("bare"), t=_tidy(F.right("bare", F.lit(TAIL)))).drop("bare")
    ends = _fixed(ends, state=_state(F.col("t"), F.col("size")))
    said = F.when(F.col("state") == "marked", F.regexp_replace("t", MARKER, "")).otherwise(F.col("t"))
    # What the text says itself, at its end or before, is none of the other terminal occurrences.  A mark is no end, and to a
    # closed end terminal occurrences of its own make no difference.
    whole = F.when(F.col("state").isin("open", "item"), F.concat(F.lit(" "), F.concat_ws(" ", _tokens(F.col("text")))))
    ends = _fixed(ends, w=F.slice(F.concat(F.array(*[F.lit(BREAK)] * 4), _tokens(said)), -6, 6), whole=whole).drop("text")
    # The last word, with the two before it, whatever breaks follow (one by construction, up to two more from the text).
    broken = lambda n: F.get("w", F.size("w") - n) == BREAK
    head = F.when(broken(2) & broken(3), F.slice("w", 1, 3)).when(broken(2), F.slice("w", 1, 4)).otherwise(F.slice("w", 1, 5))
    ends = _fixed(ends, v=F.slice(F.concat(F.array(F.lit(BREAK), F.lit(BREAK)), head), -3, 3))
    ends = _fixed(ends, a=F.get("v", 0), b=F.get("v", 1), c=F.get("v", 2))
    own = {f"own{n}": F.coalesce(_times(F.col("whole"), *"abc"[3 - n :]), F.when(F.col("state") == "closed", 1).otherwise(0)) for n in (1, 2, 3)}
    ends = ends.select(
        "key",
        "same",
        "state",
        F.rlike(F.right("t", F.lit(80)), F.lit(CLOSING)).alias("letter"),
        *[c.alias(n) for n, c in own.items()],
        F.rlike("c", F.lit(r"\d")).alias("digit"),
        F.xxhash64(F.lit(1), F.lit(0).cast("long"), "c").alias("h1"),
        F.xxhash64(F.lit(2), F.xxhash64("b"), "c").alias("h2"),
        F.xxhash64(F.lit(3), F.xxhash64("a", "b"), "c").alias("h3"),
        F.xxhash64("c").alias("s1"),
        _start("b").alias("s2"),
        "a",
        "c",
    )
    ends = written(ends, "ends")
    asked = ends.where("state IN ('open', 'item', 'marked') OR (state = 'closed' AND NOT digit)").select("state", "a", "c", "s1", "s2", "h1", "h2", "h3").distinct()
    asked = written(asked, "asked")
    small = asked.count() <= BROADCAST_KEYS
    copies = written(ends.groupBy("same").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    few = copies.count() <= BROADCAST_KEYS
    once = texts.select("text", _same(_bare(F.col("text"))).alias("same")).join(F.broadcast(copies) if few else copies, "same", "left")
    once = once.select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    counts = asked_counts(once, asked) if small else all_counts(once).join(asked.select(F.explode(F.array("h1", "h2", "h3")).alias("h")).distinct(), "h", "left_semi")
    counts = written(counts, "counts")
    near = counts.count() <= BROADCAST_KEYS
    out = ends
    for n in (1, 2, 3):
        side = counts.toDF(f"h{n}", f"inside{n}", f"last{n}")
        out = out.join(F.broadcast(side) if near else side, f"h{n}", "left")
    for n in (1, 2, 3):
        out = out.withColumn(f"inside{n}", F.coalesce(f"inside{n}", F.lit(0))).withColumn(f"last{n}", F.greatest(F.coalesce(f"last{n}", F.lit(0)) - F.col(f"own{n}"), F.lit(0)))
    seen = {n: F.col(f"inside{n}") + F.col(f"last{n}") > 0 for n in (1, 2, 3)}
    share = {n: F.col(f"last{n}") / F.greatest(F.col(f"inside{n}") + F.col(f"last{n}"), F.lit(1)) for n in (1, 2, 3)}
    rare = {n: (F.col(f"last{n}") + 1) / (F.col(f"inside{n}") + F.col(f"last{n}") + 2) < NEVER for n in (2, 3)}
    # Two texts that break off at the same place are no way of ending texts yet.
    closes = (share[3] >= ALWAYS) & (F.col("last3") >= F.when(F.col("letter"), 1).otherwise(2))
    goes_on = F.when(seen[3], ~closes).when(F.col("letter"), False).otherwise(seen[2])
    entry = F.when(seen[2], (F.col("last2") > 0) & (share[2] >= SOMETIMES)).otherwise((F.col("last1") > 0) & (share[1] >= SOMETIMES))
    closed = ~F.col("digit") & rare[3] & rare[2]
    rule = (
        F.when(F.col("state").isin("open", "marked") & goes_on, "trigram")
        .when(F.col("state") == "marked", "marker")
        .when((F.col("state") == "open") & ~seen[3] & ~F.col("letter"), "unseen")
        .when((F.col("state") == "item") & ~entry, "trigram")
        .when((F.col("state") == "closed") & closed, "trigram")
    )
    return out.select("key", "state", rule.alias("rule"), rule.isNotNull().alias("cut"))
