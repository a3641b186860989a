"""Row metrics over texts, vectors and scores, as column expressions.  Missing texts count as empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandemtext.functions import text as T

# Lexicons and patterns of the style metrics.
INFORMAL = (
    "lol", "lmao", "lmfao", "rofl", "omg", "btw", "idk", "imo", "imho", "tbh", "ngl", "ikr",
    "bruh", "bro", "dude", "yep", "yup", "nah", "nope", "gonna", "wanna", "gotta", "kinda", "sorta",
    "ain't", "lemme", "gimme", "cuz", "coz", "tho", "thx", "pls", "plz", "haha", "hehe", "hahaha",
)
SLANG = ("fr", "rn", "sus", "af", "ong", "istg", "smh", "fyi", "wbu", "hbu", "wyd", "wym", "tf", "lmk", "asap")
PROFANITY = ("fuck", "fucking", "fucked", "shit", "bullshit", "bitch", "asshole", "damn", "crap", "dick", "piss")
CLICHES = (
    "furthermore", "moreover", "consequently", "in conclusion", "landscape", "tapestry", "multifaceted", "paramount",
    "delve", "testament", "pivotal", "foster", "harness", "navigate", "realm", "crucial", "profound", "underscore",
    "symbiotic", "holistic", "unprecedented", "paradigm", "catalyst", "transformative", "intricate", "seamless",
    "vibrant", "ecosystem", "synergy", "steadfast", "cornerstone", "ultimately",
)
# Stems, each followed by any letters; the phrase stands as it is.
CLICHE_STEMS = (
    "navigat", "rigor", "furnish", "accord", "labor", "endeavor", "meticul", "comprehens", "leverag", "robust",
    "nuanc", "intricat", "delv", "underscor", "pivot", "tapestr", "realm", "furthermor", "moreov", "consequent",
    "in conclusion", "multifacet", "paramount", "testament", "foster", "harness", "crucial", "profound", "symbio",
    "holist", "unprecedent", "paradigm", "catalyst", "transform", "seamless", "vibrant", "ecosystem", "synerg",
    "steadfast", "cornerston", "ultimat",
)


def _any_of(terms: tuple[str, ...], rest: str = "") -> str:
    """One of the terms as a whole word or phrase; a look at the first letter passes over most words."""
    first = "".join(sorted({t[0] for t in terms}))
    return rf"(?i)\b(?=[{first}])(?:{'|'.join(t if ' ' in t else t + rest for t in terms)})\b"


CLICHE_PATTERN, CLICHE_STEM_PATTERN = _any_of(CLICHES), _any_of(CLICHE_STEMS, "[A-Za-z0-9_]*")
CONTRACTION = r"(?i)\b[a-z]+'(?:re|ve|d|ll|t|s)\b"
PUNCTUATION_RUN = r"[!?.,;:]{3,}"
# What a collected answer must not begin with.
REFUSAL_MARKERS = ("i cannot", "i can't", "as an ai", "here is the rewritten", "here's the rewritten", "sure, here", "i'm sorry")
VERB_SHAPE = r"(?:is|are|was|were|be|been|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must|[a-z]{2,}(?:ed|ing|ise|ize|ises|izes|ates|ify|ifies))"
RATIO_BINS = ("<0.70", "0.70-0.80", "0.80-0.90", "0.90-0.95", ">0.95")
FACT = r"[0-9][0-9.,:/-]*[0-9]|[0-9]|[A-Z][a-z]+(?: [A-Z][a-z]+)+"


def ratio(human: Column, ai: Column, digits: int = 4) -> Column:
    return F.round(human / F.greatest(ai, F.lit(1)), digits)


def lexicon(words: Column, terms: tuple[str, ...]) -> Column:
    return F.coalesce(F.size(F.filter(words, lambda w: w.isin(*terms))), F.lit(0))


def letter_run(c: Column) -> Column:
    """Longest run of one character; 1 where none repeats, 0 for an empty text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"((?s:.))\1+"), F.lit(0)), lambda x: F.char_length(x)))
    return F.coalesce(longest, F.least(F.coalesce(F.char_length(c), F.lit(0)), F.lit(1)))


def elongation(run: Column) -> Column:
    return F.when(run >= 6, "extreme").when(run >= 4, "strong").when(run >= 3, "mild").otherwise("none")


def burstiness(c: Column) -> Column:
    """Population deviation of words per sentence; 0 below two sentences."""

    def deviation(n: Column) -> Column:
        k, total = F.size(n), F.aggregate(n, F.lit(0), lambda a, x: a + x)
        squares = F.aggregate(n, F.lit(0), lambda a, x: a + x * x)
        return F.when(k >= 2, F.sqrt(F.greatest((squares - total * total / k) / k, F.lit(0.0)))).otherwise(0.0)

    return T.bound(F.transform(T.sentences(c), T.space_words), deviation)


def per(count: Column, words: Column, scale: int) -> Column:
    return F.round(count * scale / F.greatest(words, F.lit(1)), 2)


def contraction_rate(c: Column) -> Column:
    return per(F.coalesce(F.regexp_count(c, F.lit(CONTRACTION)), F.lit(0)), T.space_words(c), 100)


def cliche_density(c: Column) -> Column:
    return per(F.coalesce(F.regexp_count(c, F.lit(CLICHE_PATTERN)), F.lit(0)), T.space_words(c), 1000)


def stem_density(c: Column) -> Column:
    return per(F.coalesce(F.regexp_count(c, F.lit(CLICHE_STEM_PATTERN)), F.lit(0)), T.space_words(c), 1000)


def has_verb(sentence: Column) -> Column:
    """Whether a word of the sentence has a verb's shape (stand-in for a tagger)."""
    return F.coalesce(F.size(F.filter(T.words(sentence), lambda w: F.rlike(w, F.lit(f"^{VERB_SHAPE}$")))) > 0, F.lit(False))


def facts(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FACT), F.lit(0)))


def fact_retention(ai: Column, human: Column) -> Column:
    """Share of the numbers and capitalised phrases of one text that the other has; 1 where there are none."""
    return T.bound(facts(ai), lambda there: F.when(F.size(there) > 0, F.size(F.array_intersect(there, facts(human))) / F.size(there)).otherwise(1.0))


def target_words(n: Column) -> Column:
    return F.bround(n.cast("decimal(20,6)"), -1).cast("int")


def ratio_bin(r: Column) -> Column:
    """The bin of a length ratio; a missing one falls in the last."""
    return F.when(r < 0.7, "<0.70").when(r < 0.8, "0.70-0.80").when(r < 0.9, "0.80-0.90").when(r <= 0.95, "0.90-0.95").otherwise(">0.95")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


def semantic_score(sbert: Column, entail: Column, tfidf: Column) -> Column:
    """Weighted scores, clipped to [0, 1]; the arguments must have no nulls."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * sbert + 0.35 * entail + 0.15 * tfidf))


def quality(sbert: Column, fact: Column, ratio_: Column, copy: Column) -> Column:
    """0 to 100 from similarity, kept facts, closeness of the ratio to 0.85 and how little is copied."""
    close = F.greatest(F.lit(0.0), 1 - F.abs(ratio_ - 0.85))
    return F.round(100 * (0.4 * sbert + 0.3 * fact + 0.2 * close + 0.1 * (1 - copy)), 4)
