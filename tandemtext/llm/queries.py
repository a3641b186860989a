"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.llm import corpus_queries, leaks, overlap, pairs, personal, repetition, tokens, truncation
from tandemtext.sources.tables import label, number, once, split_label, table


def _texts(spark: SparkSession, d: str, name: str, key: str, *texts: str) -> DataFrame:
    return table(spark, d, name).select(key, *texts)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str, list[str]]:
    fields = ["AI Text", "Human Text"]
    held = table(spark, d, "audit_scores").where(split_label("split").isin("validation", "test")).select("pair_id", *fields)
    return held, _texts(spark, d, "train_normalized", "pair_id", *fields), "pair_id", fields


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(*_sides(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("key_a", "key_b").alias("pair_id_a"), F.greatest("key_a", "key_b").alias("pair_id_b")).distinct()


def p2_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records met again in training, per split, source and field."""
    labels = once(table(spark, d, "audit_scores").select("pair_id", split_label("split").alias("split"), label("human_source").alias("human_source")), "pair_id")
    met = _overlaps(spark, d).groupBy(F.col("key_a").alias("pair_id"), "field").agg(F.count_distinct("key_b").alias("links"), F.max("same").alias("same"))
    joined = labels.where("split IN ('validation', 'test')").join(met, "pair_id")
    return joined.groupBy("split", "human_source", "field").agg(F.count("*").alias("records"), F.sum("links").alias("links"), F.count_if(F.col("same") == 1).alias("exact"))


def p2_fractions(spark: SparkSession, d: str) -> DataFrame:
    """For each evaluation text the share of its words in chunks that stand in the training split."""
    return overlap.fractions(*_sides(spark, d))


def p4_measures(spark: SparkSession, d: str) -> DataFrame:
    a = once(_texts(spark, d, "regenerated_cache", "cache_id", "New Human Text").toDF("row_id", "text"), "row_id").withColumn("table_name", F.lit("regenerated_cache"))
    b = once(_texts(spark, d, "train_normalized", "pair_id", "Human Text").toDF("row_id", "text"), "row_id").withColumn("table_name", F.lit("train_normalized"))
    rows = a.unionByName(b).withColumn("key", F.struct("table_name", "row_id"))
    return repetition.repetition(rows, "key", "text").select("key.table_name", "key.row_id", *[F.round(c, 6).alias(c) if c.endswith(("ratio", "share")) else F.col(c) for c in ("words", "repeated_words", "repeated_share", "symbol_ratio", "stop_ratio", "repeated_line_ratio")], *[f for f, *_ in repetition.THRESHOLDS])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for name, key, text in (("regenerated_cache", "cache_id", "New Human Text"), ("train_normalized", "pair_id", "Human Text")):
        flagged = repetition.repetition(_texts(spark, d, name, key, text), key, text, only=("words", "repeated_share"))
        found.append(flagged.where("repeated").select(F.lit(name).alias("table_name"), F.col(key).alias("row_id")))
    return found[0].unionByName(found[1]).distinct()


def _fields(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per text field: (key struct of key and field, text)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("text")) for n in names])
    return df.select(F.col(key), F.inline(pairs)).select(F.struct(key, "field").alias("key"), "text")


def _cut(spark: SparkSession, d: str) -> DataFrame:
    names = ["AI Text", "Human Text"]
    return truncation.cut_texts(_fields(_texts(spark, d, "final_scored", "pair_id", *names), "pair_id", names))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("cut").select("key.pair_id", "key.field").distinct()


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    """Texts by what their end looks like and what shows the cut."""
    return _cut(spark, d).groupBy("key").agg(F.max_by(F.struct("state", "rule"), "state").alias("r")).groupBy("r.state", "r.rule").agg(F.count("*").alias("texts"))


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut records per model, source and field."""
    labels = once(table(spark, d, "final_scored").select("pair_id", label("source_model").alias("source_model"), label("human_source").alias("human_source")), "pair_id")
    cut = _cut(spark, d).groupBy("key").agg(F.max("cut").alias("cut")).select("key.pair_id", "key.field", "cut")
    return labels.join(cut, "pair_id").groupBy("source_model", "human_source", "field").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_texts(spark, d, "train_normalized", "pair_id", "AI Text", "Human Text"), "pair_id", "AI Text", "Human Text")


def p5_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Defects per source, with how often the (not always right) word ratio would have hinted at them."""
    rows = once(table(spark, d, "train_normalized").select("pair_id", label("human_source").alias("human_source"), number("ai_human_word_ratio").alias("ratio")), "pair_id")
    joined = rows.join(p5_found(spark, d), "pair_id", "left")
    odd = F.coalesce((F.col("ratio") < 0.4) | (F.col("ratio") > 1.6), F.lit(True))
    return joined.groupBy("human_source", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"), F.count_if(odd).alias("odd_ratio"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_stitched(spark: SparkSession, d: str) -> DataFrame:
    """The same ids with every text above 64 characters cut, spread and stitched as long ones are."""
    return tokens.encode(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", spread=64, long_chunk=512, long_overlap=64)


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts, encoded and decoded."""
    return tokens.decode(p8_ids(spark, d), "doc_id", "ids")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "held_out"), "item_id", ["text", "human_reference"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", F.col("item").alias("item_id"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item, its reference answer among them, and the longest passage."""
    answered = F.count_if(F.array_contains("fields", "human_reference"))
    return _leaks(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), answered.alias("with_reference"), F.max("words").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {**corpus_queries.QUERIES, "p2_found": p2_found, "p2_by_source": p2_by_source, "p2_fractions": p2_fractions, "p3_found": p3_found, "p3_rules": p3_rules, "p3_sources": p3_sources, "p4_found": p4_found, "p4_measures": p4_measures, "p5_found": p5_found, "p5_by_source": p5_by_source, "p8_ids": p8_ids, "p8_stitched": p8_stitched, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_redacted": p10_redacted}
_WORDS = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[''’]', '', 'g'), '\p{Nd}', '0', 'g'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
SQL: dict[str, str] = {
    **corpus_queries.SQL,
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_measures": f"""
WITH t AS (SELECT 'regenerated_cache' AS table_name, cache_id AS row_id, coalesce(any_value("New Human Text"), '') AS text FROM regenerated_cache GROUP BY cache_id
  UNION ALL SELECT 'train_normalized', pair_id, coalesce(any_value("Human Text"), '') FROM train_normalized GROUP BY pair_id),
w AS (SELECT *, {_WORDS} AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM t),
g AS (SELECT table_name, row_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 1)) AS p FROM w),
k AS (SELECT table_name, row_id, p, row_number() OVER (PARTITION BY table_name, row_id, w[p:p + 3] ORDER BY p) AS k FROM g),
a AS (SELECT *, lead(p) OVER (PARTITION BY table_name, row_id ORDER BY p) AS later FROM k WHERE k > 1),
r AS (SELECT table_name, row_id, sum(least(4, coalesce(later - p, 4))) AS repeated FROM a GROUP BY table_name, row_id),
m AS (SELECT table_name, row_id, len(w) AS words, coalesce(repeated, 0)::INTEGER AS repeated_words, coalesce(repeated, 0) / greatest(len(w), 1) AS share,
  coalesce(len(regexp_extract_all(text, '[#{{}}\\[\\]|<>~\\\\^*_=]|…|\\.{{3}}')), 0) / greatest(len(w), 1) AS symbols,
  len(list_filter(w, lambda x: x IN ('the','of','and','to','in','is','a','that','for','it','on','with','as','was','at','by','be','this','from','are','der','die','das','und','ist','von','zu','mit','auf','für','im','den','nicht',
    'le','la','les','des','et','est','une','un','que','dans','pour','du','en','pas','el','los','las','y','es','por','con','para','se','del','una'))) / greatest(len(w), 1) AS stops,
  1 - len(list_distinct(l)) / greatest(len(l), 1) AS lines FROM w LEFT JOIN r USING (table_name, row_id))
SELECT table_name, row_id, words, repeated_words, round(share, 6) AS repeated_share, round(symbols, 6) AS symbol_ratio, round(stops, 6) AS stop_ratio, round(lines, 6) AS repeated_line_ratio,
  share > 0.3 AS repeated, words < 4 AS too_short, words > 100000 AS too_long, symbols > 0.1 AS symbols, stops < 0.05 AS few_stop_words, lines > 0.3 AS repeated_lines FROM m""",
    "p4_found": f"""
WITH t AS (SELECT 'regenerated_cache' AS table_name, cache_id AS row_id, any_value("New Human Text") AS text FROM regenerated_cache GROUP BY cache_id
  UNION ALL SELECT 'train_normalized', pair_id, any_value("Human Text") FROM train_normalized GROUP BY pair_id),
w AS (SELECT table_name, row_id, {_WORDS} AS w FROM t), g AS (SELECT table_name, row_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 1)) AS p FROM w),
k AS (SELECT table_name, row_id, len(w) AS n, p, row_number() OVER (PARTITION BY table_name, row_id, w[p:p + 3] ORDER BY p) AS k FROM g),
a AS (SELECT *, lead(p) OVER (PARTITION BY table_name, row_id ORDER BY p) AS later FROM k WHERE k > 1)
SELECT table_name, row_id FROM a GROUP BY table_name, row_id HAVING sum(least(4, coalesce(later - p, 4))) > 0.3 * any_value(n)""",
}
