"""Frames and SQL that the catalogue's queries start from, and the registry they enter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions import text as T
from tandemtext.sources.tables import label, number, once, split_label, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def enter(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return enter


NUMBERS = ("ai_human_word_ratio", "sbert_similarity", "tfidf_similarity", "nli_entailment_prob", "nli_neutral_prob", "nli_contradiction_prob")
LABELS = ("category", "source_model", "human_source")


def pairs(spark: SparkSession, d: str, name: str = "final_scored", *more: str) -> DataFrame:
    """One row per pair: ``pair_id, ai, hu``, labels in one spelling, scores without NaN."""
    return once(delivered(spark, d, name, *more), "pair_id")


def derived(spark: SparkSession, d: str, *cols) -> DataFrame:
    """Columns made of a pair's own columns, ``pair_id`` among them.

    They are made before redelivered pairs are dropped, so the shuffle carries results and not texts.
    """
    return once(delivered(spark, d).select(*cols), "pair_id")


def delivered(spark: SparkSession, d: str, name: str = "final_scored", *more: str) -> DataFrame:
    """The columns of :func:`pairs` as delivered, some pairs twice."""
    kept = [c for c in NUMBERS if name != "train_filtered" or c not in ("ai_human_word_ratio", "nli_neutral_prob", "nli_contradiction_prob")]
    cols = [F.col("pair_id"), F.col("AI Text").alias("ai"), F.col("Human Text").alias("hu"), *[label(c).alias(c) for c in LABELS], F.col("contributor"), *[number(c).alias(c) for c in kept], *[F.col(c) for c in more]]
    return table(spark, d, name).select(*cols)


def audited(spark: SparkSession, d: str, measured: Callable[[DataFrame], DataFrame] | None = None, *more: str) -> DataFrame:
    """One row per audited pair: labels, split and metrics without NaN.

    ``measured`` adds columns made of the texts; those named in ``more`` are kept, and no text is shuffled.
    """
    cols = [F.col("pair_id"), *[label(c).alias(c) for c in LABELS], split_label("split").alias("split"), *[number(c).alias(c) for c in AUDIT]]
    flags = [F.col(c) for c in ("has_citation", "has_title_leakage", "has_trailing_references")]
    rows = table(spark, d, "audit_scores")
    return once((measured(rows) if measured else rows).select(*cols, *flags, *more), "pair_id")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


AUDIT = ("ratio", "burstiness", "contraction_rate", "human_cliche_density", "ai_cliche_density", "min_cov", "mean_cov", "copy_rate", "sent_count_ratio", "struct_change", "fact_retention", "quality_score", "ai_words", "human_words", "sbert_similarity", "nli_entailment_prob", "nli_contradiction_prob", "tfidf_similarity")


# SQL of the same.
def s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {s(pattern)}, {s(to)}, 'g')"


def sub1(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {s(pattern)}, {s(to)})"


def count(c: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, {s(pattern)})), 0)"


def strip(c: str) -> str:
    return sub(c, rf"^{T.WS}+|{T.WS}+\z")


def collapse(c: str) -> str:
    return f"coalesce({sub(strip(c), T.WS + '+', ' ')}, '')"


def space_words(c: str) -> str:
    return count(c, T.NOT_WS + "+")


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {s(T.WORD)})"


def sents(c: str) -> str:
    parts = sub(f"coalesce({c}, '')", rf"([.!?]){T.WS}+([A-Z0-9\"'])", r"\1" + "\x01" + r"\2")
    return f"list_filter(list_transform(string_split({parts}, '\x01'), lambda x: {strip('x')}), lambda x: x <> '')"


def lab(c: str) -> str:
    return f"nullif(replace(lower({sub(c, r'^[ ]+|[ ]+$')}), '-', '_'), '')"


def num(c: str) -> str:
    # As text: isnan() is folded away where a file's statistics, which leave NaN out, have been read.
    return f"CASE WHEN {c}::DOUBLE::VARCHAR IN ('nan', 'inf', '-inf') THEN NULL ELSE {c}::DOUBLE END"


def pairs_sql(name: str = "final_scored", *more: str) -> str:
    cols = [f"any_value({lab(c)}) AS {c}" for c in LABELS] + ["any_value(contributor) AS contributor"] + [f"any_value({num(c)}) AS {c}" for c in NUMBERS] + [f'any_value({c}) AS {c}' for c in more]
    return f'p AS (SELECT pair_id, any_value("AI Text") AS ai, any_value("Human Text") AS hu, {", ".join(cols)} FROM {name} GROUP BY pair_id)'


SPLIT_SQL = f"CASE WHEN {lab('split')} LIKE 'tr%' THEN 'train' WHEN {lab('split')} LIKE 'val%' OR {lab('split')} = 'dev' THEN 'validation' WHEN {lab('split')} LIKE 'te%' THEN 'test' END"


def strip_artifacts(c: str) -> str:
    c = sub(sub(strip(c), T.TITLE_LINE), T.TRAILING_REFERENCES)
    return strip(sub(sub(c, T.CITATION), r"[ \t]+", " "))


def _density(c: str, pattern: str) -> str:
    return f"round({count(c, pattern)} * 1000 / greatest({space_words(c)}, 1), 2)"


CLICHES_SQL = r"(?i)\b(?:furthermore|moreover|consequently|in conclusion|landscape|tapestry|multifaceted|paramount|delve|testament|pivotal|foster|harness|navigate|realm|crucial|profound|underscore|symbiotic|holistic|unprecedented|paradigm|catalyst|transformative|intricate|seamless|vibrant|ecosystem|synergy|steadfast|cornerstone|ultimately)\b"
STEMS_SQL = (
    r"(?i)\b(?:navigat\w*|rigor\w*|furnish\w*|accord\w*|labor\w*|endeavor\w*|meticul\w*|comprehens\w*|leverag\w*|robust\w*|nuanc\w*|intricat\w*|delv\w*|underscor\w*|pivot\w*|tapestr\w*|realm\w*|furthermor\w*|moreov\w*|consequent\w*|in conclusion|multifacet\w*|"
    r"paramount\w*|testament\w*|foster\w*|harness\w*|crucial\w*|profound\w*|symbio\w*|holist\w*|unprecedent\w*|paradigm\w*|catalyst\w*|transform\w*|seamless\w*|vibrant\w*|ecosystem\w*|synerg\w*|steadfast\w*|cornerston\w*|ultimat\w*)\b"
)
_CLEAN = strip_artifacts("coalesce(any_value(\"Human Text\"), '')")
CLEAN_SQL = (
    f"round({space_words(_CLEAN)} / greatest({space_words('any_value(' + chr(34) + 'AI Text' + chr(34) + ')')}, 1), 4) AS clean_ratio",
    f"{_density(_CLEAN, CLICHES_SQL)} AS clean_cliches",
    f"{_density(_CLEAN, STEMS_SQL)} AS clean_stems",
)


def audited_sql(more: tuple[str, ...] = ()) -> str:
    cols = [f"any_value({lab(c)}) AS {c}" for c in LABELS] + [f"any_value({SPLIT_SQL}) AS split"] + [f"any_value({num(c)}) AS {c}" for c in AUDIT] + [f"any_value({c}) AS {c}" for c in ("has_citation", "has_title_leakage", "has_trailing_references")]
    return f"a AS (SELECT pair_id, {', '.join([*cols, *more])} FROM audit_scores GROUP BY pair_id)"
