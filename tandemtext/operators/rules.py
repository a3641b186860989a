"""Rules as data: ordered threshold lists from which conditions, reasons and sweeps are made.

A condition on a missing value is false unless the rule says otherwise, so a null never drops a row by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions import metrics as M
from tandemtext.functions import text as T


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def or_value(name: str, value: float) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


@dataclass(frozen=True)
class Limits:
    """Thresholds of the filters (fixed values)."""

    min_ratio: float = 0.70
    max_ratio: float = 0.95
    min_cov: float = 0.55
    mean_cov: float = 0.75
    #: Copied share allowed in the categories of STRICT and in others.
    copy_strict: float = 0.60
    copy_loose: float = 0.75
    #: Copied share allowed in regenerated and in collected pairs.
    copy_regenerated: float = 0.50
    copy_collected: float = 0.85
    cliche_factor: float = 2.0
    cliche_floor: float = 4.0
    fact: float = 0.60
    opening: float = 0.40


FIRST = Limits()
FINAL = replace(FIRST, mean_cov=0.65)
#: Categories with a stricter limit on copying, and those without rules on coverage and copying.
STRICT, RELAXED = ("essay", "academic"), ("email", "document")
#: Median of a category without collected pairs: in the audit and in the filters (fixed values).
AUDIT_MEDIAN, FILTER_MEDIAN = 5.0, 0.0
#: What the sweep varies.
SWEEP = {"mean_cov": (0.65, 0.70, 0.75), "fact": (0.60, 0.70, 0.80), "copy_regenerated": (0.50, 0.60), "copy_collected": (0.60, 0.75, 0.85), "cliche_factor": (2.0, 3.0)}
#: How a text may begin and end.
OPENERS, MACHINE_OPENERS, CLOSERS = r"^[A-Z0-9\"“”‘’]", r"^[A-Z0-9\"“”‘’*#]", r"[.!?][\"“”‘’)]?\z"
UNCLOSED_ROUND, UNCLOSED_SQUARE = r"\([^)]*\z", r"\[[^\]]*\z"
#: Phrases that a text of a category must not have.
EXCLUDED = {
    "essay": ("dear sir", "dear madam", "subject:", "sincerely,", "regards,"),
    "academic": ("dear ", "subject:", "sincerely,"),
    "document": ("dear sir", "dear madam", "love,", "xoxo"),
}

SBERT_FLAGS = ((0.55, "LOW"), (0.68, "REVIEW"), (0.78, "MEDIUM"))
REGENERATED_FLAGS = ((0.65, "LOW"), (0.78, "MEDIUM"))
TFIDF_FLAGS = ((0.15, "LOW"), (0.30, "REVIEW"), (0.55, "MEDIUM"))


def banded(c: Column, bands: tuple[tuple[float, str], ...], top: str = "HIGH") -> Column:
    out = F.lit(top)
    for limit, name in reversed(bands):
        out = F.when(c < limit, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def nli_flag(entail: Column, contra: Column) -> Column:
    return F.when(is_true(contra >= 0.5), "CONTRADICTION").when(is_true(entail >= 0.7), "ENTAILMENT").when(is_true(entail < 0.35), "LOW_ENTAILMENT").otherwise("REVIEW")


def tier_by_style(elongation: Column, run: Column, punctuation: Column, profanity: Column, slang: Column, informal: Column, ratio: Column) -> Column:
    odd = is_true((ratio < 0.4) | (ratio > 1.6))
    return F.when((elongation == "extreme") | (run >= 4) | (punctuation >= 2) | (profanity >= 2), "C").when((slang >= 3) | (informal >= 3) | odd, "B").otherwise("A")


def tier_by_scores(sbert: Column, contra: Column, ratio: Column, elongation: Column, informal: Column) -> Column:
    c = (sbert < 0.72) | (contra > 0.25) | elongation.isin("extreme", "strong")
    return F.when(c, "C").when((sbert < 0.80) | (ratio < 0.65) | (ratio > 1.40) | (informal >= 3), "B").otherwise("A")


def semantic_risk(sbert: Column, contra: Column, ratio: Column, ai_words: Column, human_words: Column) -> Column:
    return is_true(sbert < 0.7) | is_true(contra > 0.35) | is_true((ratio < 0.6) | (ratio > 1.6)) | is_true((ai_words < 30) | (human_words < 30))


def semantic_status(sbert: Column, contra: Column, ratio: Column, ai_words: Column, human_words: Column) -> Column:
    odd = is_true((ratio < 0.6) | (ratio > 1.6)) | is_true((ai_words < 30) | (human_words < 30))
    return F.when(is_true(contra > 0.35), "CONTRADICTION").when(is_true(sbert < 0.7), "LOW_SIMILARITY").when(odd, "LENGTH_MISMATCH").when(is_true(sbert >= 0.8), "HIGH_CONFIDENCE").otherwise("ACCEPTABLE")


def consistent(text: Column, category: Column) -> Column:
    """No phrase that is excluded for the category; an unknown category excludes none."""
    bad = F.lit(False)
    for name, phrases in EXCLUDED.items():
        for phrase in phrases:
            bad = bad | ((category == name) & F.contains(F.lower(text), F.lit(phrase)))
    return ~is_true(bad)


def passes_quality(ai: Column, human: Column) -> Column:
    """Both texts there, no refusal, plausible lengths, not the same text; the machine's is cleaned first."""
    clean = T.model_output(ai)
    a, h = T.space_words(clean), T.space_words(human)
    start = F.left(F.lower(F.coalesce(clean, F.lit(""))), F.lit(80))
    refused = F.lit(False)
    for marker in M.REFUSAL_MARKERS:
        refused = refused | F.contains(start, F.lit(marker))
    plausible = (h == 0) | (a / F.greatest(h, F.lit(1))).between(0.55, 1.65)
    return is_true((F.length(ai) > 0) & (F.length(human) > 0) & (F.length(clean) > 0) & ~refused & a.between(30, 640) & plausible & (T.strip(clean) != T.strip(human)))


def valid_pair(ai: Column, human: Column) -> Column:
    ai, human = T.strip(ai), T.strip(human)
    a, h = T.space_words(ai), T.space_words(human)
    ratio = h / F.greatest(a, F.lit(1))
    has = lambda c, p: F.rlike(c, F.lit(p))
    whole = has(human, OPENERS) & has(human, CLOSERS) & has(ai, MACHINE_OPENERS) & has(ai, CLOSERS)
    return is_true((a >= 30) & (h >= 30) & (ratio >= 0.55) & (ratio <= 1.85) & whole & ~has(human, UNCLOSED_ROUND) & ~has(human, UNCLOSED_SQUARE))


def medians(df: DataFrame, metric: str) -> DataFrame:
    """Median of a metric per category over collected (not regenerated) pairs: one row per category."""
    own = df.where(F.col("category").isNotNull() & is_true(F.contains("human_source", F.lit("hf_dataset_import"))))
    return own.groupBy("category").agg(F.percentile(metric, F.lit(0.5)).alias("median"))


def with_median(df: DataFrame, metric: str, default: float) -> DataFrame:
    """``median`` of the row's category; a bounded side (one row per category) is broadcast."""
    return df.join(F.broadcast(medians(df, metric)), "category", "left").withColumn("median", F.coalesce("median", F.lit(default)))


def regenerated() -> Column:
    return is_true(F.contains("human_source", F.lit("llm_regenerated")))


def _reasons(rules: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(is_true(c), name) for name, c in rules])), "; ")


def _copied(limits: Limits) -> Column:
    """More copied than the row's category allows."""
    return F.when(is_true(F.col("category").isin(*STRICT)), F.col("copy_rate") > limits.copy_strict).otherwise(F.col("copy_rate") > limits.copy_loose)


def _copied_by_source(regenerated_cap: Column, collected_cap: Column) -> Column:
    return F.when(regenerated(), F.col("copy_rate") > regenerated_cap).otherwise(F.col("copy_rate") > collected_cap)


def audit_rules(limits: Limits = FIRST) -> list[tuple[str, Column]]:
    """The five audit rules; needs ``median`` beside the audit's columns."""
    return [
        ("coverage", (F.col("min_cov") < limits.min_cov) | (F.col("mean_cov") < limits.mean_cov)),
        ("copying", _copied(limits)),
        ("cliches", F.col("human_cliche_density") > limits.cliche_factor * F.col("median")),
        ("short", F.col("ratio") < limits.min_ratio),
        ("artifacts", F.col("has_title_leakage") | F.col("has_trailing_references")),
    ]


def first_filter(limits: Limits = FIRST) -> list[tuple[str, Column]]:
    """Needs ``clean_ratio`` and ``clean_cliches`` of the text without artifacts."""
    return [
        ("short", F.col("clean_ratio") < limits.min_ratio),
        ("coverage", (F.col("min_cov") < limits.min_cov) | (F.col("mean_cov") < limits.mean_cov)),
        ("copying", _copied(limits)),
        ("cliches", F.col("clean_cliches") > F.greatest(limits.cliche_factor * F.col("median"), F.lit(limits.cliche_floor))),
    ]


def final_filter(limits: Limits = FINAL) -> list[tuple[str, Column]]:
    """Needs ``clean_ratio`` and ``clean_stems`` of the text without artifacts."""
    by_category = ~is_true(F.col("category").isin(*RELAXED))
    return [
        ("ratio", (F.col("clean_ratio") < limits.min_ratio) | (F.col("clean_ratio") > limits.max_ratio)),
        ("cliches", F.col("clean_stems") > F.greatest(limits.cliche_factor * F.col("median"), F.lit(limits.cliche_floor))),
        ("facts", F.col("fact_retention") < limits.fact),
        ("coverage", by_category & (F.col("mean_cov") < limits.mean_cov)),
        ("copying", by_category & _copied_by_source(F.lit(limits.copy_regenerated), F.lit(limits.copy_collected))),
    ]


def opening_rules(limits: Limits = FINAL) -> list[tuple[str, Column]]:
    """Needs ``clean``, its first sentence as ``first``, ``has_verb`` of that and ``opening``, its best cosine (or null)."""
    there = F.col("clean") != ""
    return [
        ("empty", ~there),
        ("lowercase", F.rlike("clean", F.lit(r"^\p{Ll}"))),
        ("fragment", there & ~F.col("has_verb")),
        ("mismatch", there & (F.col("opening") < limits.opening)),
    ]


def filtered(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """All rows with the reasons to drop them; an empty reason passes."""
    return df.withColumn(name, _reasons(rules))


def sweep_grid(df: DataFrame) -> DataFrame:
    """One row per combination of SWEEP, in order, numbered from 1."""
    from itertools import product

    rows = [(i, *map(float, c)) for i, c in enumerate(product(*SWEEP.values()), 1)]
    return df.sparkSession.createDataFrame(rows, "combo int, " + ", ".join(f"t_{n} double" for n in SWEEP))


def sweep(df: DataFrame) -> DataFrame:
    """Survivors of every combination in one pass: a conditional aggregate over rows x grid (108 bounded rows, broadcast).

    Needs ``clean_ratio`` and ``median`` beside the audit's columns.
    """
    relaxed, strict = is_true(F.col("category").isin(*RELAXED)), is_true(F.col("category").isin(*STRICT))
    collected_cap = F.when(strict, F.col("t_copy_collected")).otherwise(FINAL.copy_collected)
    dropped = (
        is_true(F.col("clean_ratio") < FIRST.min_ratio)
        | is_true(F.col("human_cliche_density") > F.greatest(F.col("t_cliche_factor") * F.col("median"), F.lit(FIRST.cliche_floor)))
        | is_true(F.col("fact_retention") < F.col("t_fact"))
        | (~relaxed & is_true((F.col("mean_cov") < F.col("t_mean_cov")) | _copied_by_source(F.col("t_copy_regenerated"), collected_cap)))
    )
    j = df.crossJoin(F.broadcast(sweep_grid(df))).withColumn("kept", ~dropped)
    n = F.count_if("kept")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("kept"), F.col(c))), F.lit(0.0)), 2)
    share = lambda low, high: F.round(F.coalesce(100 * F.count_if(F.col("kept") & is_true((F.col("clean_ratio") >= low) & (F.col("clean_ratio") < high))) / n, F.lit(0.0)), 1)
    return j.groupBy("combo", *[f"t_{n}" for n in SWEEP]).agg(
        n.alias("survivors"),
        *[F.count_if(F.col("kept") & (F.col("category") == c)).alias(f"n_{c}") for c in T.CATEGORIES],
        F.count_if(F.col("kept") & regenerated()).alias("n_regenerated"),
        share(0.7, 0.8).alias("ratio_070_080"),
        share(0.8, 0.9).alias("ratio_080_090"),
        mean("burstiness").alias("mean_burstiness"),
        mean("contraction_rate").alias("mean_contractions"),
        mean("human_cliche_density").alias("mean_cliches"),
        mean("quality_score").alias("mean_quality"),
    )
