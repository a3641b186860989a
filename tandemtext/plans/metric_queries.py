"""Row metrics, similarity and sentence coverage over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import metrics as M
from tandemtext.functions import text as T
from tandemtext.operators import similarity
from tandemtext.plans.base import CLICHES_SQL, STEMS_SQL, Registry, audited, audited_sql, count, derived, pairs, pairs_sql, s, sents, space_words, tokens
from tandemtext.plans.rule_queries import _VERB_SQL, INFORMAL_SQL, PROFANITY_SQL, SLANG_SQL, _in
from tandemtext.sources.tables import table

R = Registry()
P = f"WITH {pairs_sql()} "
A = f"WITH {audited_sql()} "
CONTRACTION_SQL = r"(?i)\b[a-z]+'(?:re|ve|d|ll|t|s)\b"


@R.add(f"{P} SELECT pair_id, {space_words('ai')} AS ai_words, {space_words('hu')} AS human_words, round({space_words('hu')} / greatest({space_words('ai')}, 1), 4) AS ratio FROM p")
def m01_length_ratio(spark, d):
    a, h = T.space_words(F.col("ai")), T.space_words(F.col("hu"))
    return derived(spark, d, "pair_id", a.alias("ai_words"), h.alias("human_words"), M.ratio(h, a).alias("ratio"))


_RUNS = """, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c), n AS (SELECT doc_id, count(*) AS run FROM g GROUP BY doc_id, ch, g), m AS (SELECT doc_id, max(run) AS run FROM n GROUP BY doc_id)"""


@R.add("WITH z AS (SELECT 1)" + _RUNS + " SELECT d.doc_id, coalesce(m.run, 0) AS longest_run, CASE WHEN m.run >= 6 THEN 'extreme' WHEN m.run >= 4 THEN 'strong' WHEN m.run >= 3 THEN 'mild' ELSE 'none' END AS elongation FROM documents d LEFT JOIN m USING (doc_id)")
def m02_m03_letter_runs(spark, d):
    run = M.letter_run(F.col("text"))
    return table(spark, d, "documents").select("doc_id", run.alias("longest_run")).withColumn("elongation", M.elongation(F.col("longest_run")))


@R.add("WITH z AS (SELECT 1)" + _RUNS.split(", m AS (SELECT doc_id, max(run)")[0].replace("SELECT doc_id, count(*) AS run FROM g", "SELECT doc_id, ch, count(*) AS run FROM g") + ", k AS (SELECT doc_id, count(*) AS runs FROM n WHERE run >= 3 AND regexp_full_match(ch, '[A-Za-z]') GROUP BY doc_id) SELECT d.doc_id, coalesce(runs, 0)::INTEGER AS runs FROM documents d LEFT JOIN k USING (doc_id)")
def m04_repeated_letters(spark, d):
    """How many runs of three or more equal letters each text has (needs back-references)."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_count("text", F.lit(r"([A-Za-z])\1{2,}")), F.lit(0)).alias("runs"))


@R.add(f"{P} SELECT pair_id, {count('hu', '[!?.,;:]{3,}')} AS runs FROM p")
def m05_punctuation_runs(spark, d):
    return derived(spark, d, "pair_id", F.coalesce(F.regexp_count("hu", F.lit(M.PUNCTUATION_RUN)), F.lit(0)).alias("runs"))


@R.add(f"{P} SELECT pair_id, {_in('hu', INFORMAL_SQL)} AS informal, {_in('hu', SLANG_SQL)} AS slang, {_in('hu', PROFANITY_SQL)} AS profanity FROM p")
def m06_lexicons(spark, d):
    w = derived(spark, d, "pair_id", T.words(F.col("hu")).alias("w"))
    return w.select("pair_id", M.lexicon(F.col("w"), M.INFORMAL).alias("informal"), M.lexicon(F.col("w"), M.SLANG).alias("slang"), M.lexicon(F.col("w"), M.PROFANITY).alias("profanity"))


def _burst(c: str) -> str:
    n = f"list_transform({sents(c)}, lambda x: {space_words('x')})"
    return f"CASE WHEN len({n}) >= 2 THEN round(list_stddev_pop({n}), 4) ELSE 0.0 END"


@R.add(f"{P} SELECT pair_id, {_burst('hu')} AS burstiness FROM p")
def m07_burstiness(spark, d):
    return derived(spark, d, "pair_id", F.round(M.burstiness(F.col("hu")), 4).alias("burstiness"))


@R.add(f"{P} SELECT pair_id, {_burst('ai')} AS ai_burstiness FROM p")
def m20_ai_burstiness(spark, d):
    return derived(spark, d, "pair_id", F.round(M.burstiness(F.col("ai")), 4).alias("ai_burstiness"))


@R.add(f"{P} SELECT pair_id, round({count('hu', CONTRACTION_SQL)} * 100 / greatest({space_words('hu')}, 1), 2) AS contraction_rate FROM p")
def m08_contraction_rate(spark, d):
    return derived(spark, d, "pair_id", M.contraction_rate(F.col("hu")).alias("contraction_rate"))


@R.add(f"{P} SELECT pair_id, round({count('ai', CLICHES_SQL)} * 1000 / greatest({space_words('ai')}, 1), 2) AS density FROM p")
def m09_cliche_density(spark, d):
    return derived(spark, d, "pair_id", M.cliche_density(F.col("ai")).alias("density"))


@R.add(f"{P} SELECT pair_id, round({count('ai', STEMS_SQL)} * 1000 / greatest({space_words('ai')}, 1), 2) AS density FROM p")
def m10_stem_density(spark, d):
    return derived(spark, d, "pair_id", M.stem_density(F.col("ai")).alias("density"))


_TITLE, _REFS = r"(?i)^[ \t]*(?:title|subject)[ \t]*:", r"\n[ \t]*(?:Works Cited|References|Bibliography)"


@R.add(f"{P} SELECT pair_id, coalesce(regexp_matches(hu, {s(T.CITATION)}), false) AS has_citation, coalesce(regexp_matches(hu, {s(_TITLE)}), false) AS has_title_leakage, coalesce(regexp_matches(hu, {s(_REFS)}), false) AS has_trailing_references FROM p")
def m11_artifact_flags(spark, d):
    has = lambda p: F.coalesce(F.rlike(F.col("hu"), F.lit(p)), F.lit(False))
    return derived(spark, d, "pair_id", has(T.CITATION).alias("has_citation"), has(_TITLE).alias("has_title_leakage"), has(_REFS).alias("has_trailing_references"))


@R.add(f"{P} SELECT pair_id, len({sents('ai')}) AS ai_sentences, len({sents('hu')}) AS human_sentences, round(len({sents('hu')}) / greatest(len({sents('ai')}), 1), 3) AS sentence_ratio FROM p")
def m12_sentence_counts(spark, d):
    c = derived(spark, d, "pair_id", F.size(T.sentences(F.col("ai"))).alias("ai_sentences"), F.size(T.sentences(F.col("hu"))).alias("human_sentences"))
    return c.withColumn("sentence_ratio", F.round(F.col("human_sentences") / F.greatest("ai_sentences", F.lit(1)), 3))


# Sentence vectors: ten vectors make a pair's machine side, blends with the next pair's make its human side.
_VEC = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT max(vec_id) + 1 AS n FROM e),
ai AS (SELECT vec_id // 10 AS pair_id, vec_id % 10 AS i, v FROM e),
hu AS (SELECT a.vec_id // 10 AS pair_id, a.vec_id % 10 AS j, list_transform(range(1, len(a.v) + 1), lambda t: (1 - 0.12 * ((a.vec_id + a.vec_id // 10) % 7)) * a.v[t] + 0.12 * ((a.vec_id + a.vec_id // 10) % 7) * b.v[t]) AS v
  FROM e a, m, e b WHERE b.vec_id = (a.vec_id + 10) % m.n AND (a.vec_id % 10 <> (a.vec_id // 10) % 10 OR (a.vec_id // 10) % 3 = 0)),
sim AS (SELECT ai.pair_id, i, j, list_dot_product(ai.v, hu.v) / greatest(sqrt(list_dot_product(ai.v, ai.v) * list_dot_product(hu.v, hu.v)), 1e-12) AS sim FROM ai JOIN hu USING (pair_id)),
best AS (SELECT pair_id, i, max(sim) AS best FROM sim GROUP BY pair_id, i)"""


@R.add(_VEC + " SELECT pair_id, round(min(best), 4) AS min_cov, round(avg(best), 4) AS mean_cov, round(avg(CASE WHEN best > 0.9 THEN 1.0 ELSE 0.0 END), 4) AS copy_rate FROM best GROUP BY pair_id")
def m13_m14_coverage(spark, d):
    ai, hu = similarity.sentence_vectors(table(spark, d, "embeddings"))
    return similarity.coverage(similarity.sentence_similarity(ai, hu))


@R.add(
    _VEC
    + """, top AS (SELECT pair_id, i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, j ORDER BY round(sim, 9) DESC, i) AS r FROM sim) WHERE r = 1),
c AS (SELECT *, count(*) OVER (PARTITION BY pair_id, i) AS shared FROM top) SELECT pair_id, round(avg(CASE WHEN shared > 1 OR sim < 0.6 THEN 1.0 ELSE 0.0 END), 4) AS struct_change FROM c GROUP BY pair_id"""
)
def m15_structure_change(spark, d):
    ai, hu = similarity.sentence_vectors(table(spark, d, "embeddings"))
    return similarity.structure_change(similarity.sentence_similarity(ai, hu))


@R.add(_VEC + " SELECT pair_id, j, i FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, j ORDER BY round(sim, 9) DESC, i) AS r FROM sim) WHERE r = 1")
def w05_j04_best_counterpart(spark, d):
    """For every human sentence the machine sentence nearest to it, the first one in a tie."""
    ai, hu = similarity.sentence_vectors(table(spark, d, "embeddings"))
    return similarity.counterparts(similarity.sentence_similarity(ai, hu)).select("pair_id", "j", "i")


@R.add(_VEC + ", f AS (SELECT pair_id, min(j) AS j FROM sim GROUP BY pair_id) SELECT pair_id, round(max(sim), 4) AS opening FROM sim JOIN f USING (pair_id, j) GROUP BY pair_id")
def m16_opening_cosine(spark, d):
    ai, hu = similarity.sentence_vectors(table(spark, d, "embeddings"))
    return similarity.opening(similarity.sentence_similarity(ai, hu))


@R.add()
def m13_m16_audit_from_texts(spark, d):
    """Coverage, copying, structure and opening of every pair from the sentences of its texts (stand-in encoder)."""
    return similarity.audited_sentences(derived(spark, d, "pair_id", "ai", "hu"))


@R.add(f"{P}, f AS (SELECT pair_id, {sents('hu')}[1] AS f FROM p) SELECT pair_id, coalesce(len(list_filter({tokens('f')}, lambda w: regexp_full_match(w, '{_VERB_SQL}'))) > 0, false) AS has_verb, coalesce(regexp_matches(f, {s(chr(94) + chr(92) + 'p{Ll}')}), false) AS lower_start FROM f")
def m17_m18_opening_shape(spark, d):
    """Whether the first sentence has a word of a verb's shape (stand-in for a tagger) and begins in lower case."""
    f = derived(spark, d, "pair_id", F.get(T.sentences(F.col("hu")), 0).alias("f"))
    return f.select("pair_id", M.has_verb(F.col("f")).alias("has_verb"), F.coalesce(F.rlike("f", F.lit(r"^\p{Ll}")), F.lit(False)).alias("lower_start"))


_FACTS = "list_distinct(regexp_extract_all(coalesce({c}, ''), " + s(M.FACT) + "))"


@R.add(f"{P} SELECT pair_id, round(CASE WHEN len({_FACTS.format(c='ai')}) > 0 THEN len(list_intersect({_FACTS.format(c='ai')}, {_FACTS.format(c='hu')})) / len({_FACTS.format(c='ai')}) ELSE 1.0 END, 4) AS fact_retention FROM p")
def m19_fact_retention(spark, d):
    return derived(spark, d, "pair_id", F.round(M.fact_retention(F.col("ai"), F.col("hu")), 4).alias("fact_retention"))


@R.add(A + "SELECT pair_id, round(100 * (0.4 * coalesce(sbert_similarity, 0) + 0.3 * coalesce(fact_retention, 1) + 0.2 * greatest(0.0, 1 - abs(coalesce(ratio, 0) - 0.85)) + 0.1 * (1 - coalesce(copy_rate, 0))), 4) AS quality FROM a")
def m21_quality(spark, d):
    c = lambda n, v: F.coalesce(n, F.lit(v))
    return audited(spark, d).select("pair_id", M.quality(c("sbert_similarity", 0.0), c("fact_retention", 1.0), c("ratio", 0.0), c("copy_rate", 0.0)).alias("quality"))


@R.add(
    P
    + ", m AS (SELECT avg(sbert_similarity) AS a, avg(nli_entailment_prob) AS b, avg(tfidf_similarity) AS c FROM p) "
    + "SELECT pair_id, round(greatest(0.0, least(1.0, 0.5 * coalesce(sbert_similarity, a) + 0.35 * coalesce(nli_entailment_prob, b) + 0.15 * coalesce(tfidf_similarity, c))), 6) AS score FROM p, m"
)
def m22_semantic_score(spark, d):
    p = derived(spark, d, "pair_id", "sbert_similarity", "nli_entailment_prob", "tfidf_similarity")
    # One row of means, joined to every pair.
    means = p.agg(F.avg("sbert_similarity").alias("a"), F.avg("nli_entailment_prob").alias("b"), F.avg("tfidf_similarity").alias("c"))
    j = p.crossJoin(F.broadcast(means))
    return j.select("pair_id", F.round(M.semantic_score(F.coalesce("sbert_similarity", "a"), F.coalesce("nli_entailment_prob", "b"), F.coalesce("tfidf_similarity", "c")), 6).alias("score"))


@R.add("SELECT DISTINCT cache_id, round(sbert_similarity * 0.7 + 0.3, 3) AS score FROM regenerated_cache WHERE sbert_similarity IS NOT NULL AND sbert_similarity::VARCHAR <> 'nan'")
def m23_regenerated_score(spark, d):
    r = table(spark, d, "regenerated_cache").select("cache_id", "sbert_similarity").where(F.col("sbert_similarity").isNotNull() & ~F.isnan("sbert_similarity"))
    return r.select("cache_id", F.round(F.col("sbert_similarity") * 0.7 + 0.3, 3).alias("score")).distinct()


@R.add(f"{P} SELECT pair_id, round_even({space_words('hu')}::DOUBLE, -1)::INTEGER AS target FROM p")
def m24_target_words(spark, d):
    return derived(spark, d, "pair_id", M.target_words(T.space_words(F.col("hu"))).alias("target"))


_BIN = "CASE WHEN {r} < 0.7 THEN '<0.70' WHEN {r} < 0.8 THEN '0.70-0.80' WHEN {r} < 0.9 THEN '0.80-0.90' WHEN {r} <= 0.95 THEN '0.90-0.95' ELSE '>0.95' END"


@R.add(A + f"SELECT {_BIN.format(r='ratio')} AS bin, count(*) AS n FROM a GROUP BY 1")
def m25_ratio_bins(spark, d):
    return audited(spark, d).groupBy(M.ratio_bin(F.col("ratio")).alias("bin")).agg(F.count("*").alias("n"))


@R.add(f"{P} SELECT category, floor(0.15 / 0.85 * count(*) FILTER (WHERE NOT contains(coalesce(human_source, ''), 'llm_regenerated')))::BIGINT AS most FROM p WHERE category IS NOT NULL GROUP BY category")
def m26_most_regenerated(spark, d):
    own = F.count_if(~F.contains(F.coalesce("human_source", F.lit("")), F.lit("llm_regenerated")))
    return pairs(spark, d).where("category IS NOT NULL").groupBy("category").agg(F.floor(F.lit(0.15 / 0.85) * own).alias("most"))


@R.add(
    f"""{P}, n AS (SELECT category, {space_words('ai')} AS w FROM p WHERE category IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM n)
SELECT category, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN w END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN w END) AS p95, max(CASE WHEN i = least(n - 1, floor(n * 0.99)) THEN w END) AS p99, max(w) AS longest, round(avg(w), 4) AS mean FROM k GROUP BY category"""
)
def m27_a16_token_stats(spark, d):
    """Nearest-rank quantiles from counts per length: equal lengths are added up before they are put in order."""
    n = derived(spark, d, "pair_id", "category", T.space_words(F.col("ai")).alias("w")).where("category IS NOT NULL")
    c = n.groupBy("category", "w").agg(F.count("*").alias("k"))
    w = W.partitionBy("category")
    c = c.withColumn("upto", F.sum("k").over(w.orderBy("w"))).withColumn("n", F.sum("k").over(w))
    at = lambda f: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * f)), F.col("w")))
    return c.groupBy("category").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("w").alias("longest"), F.round(F.sum(F.col("k") * F.col("w")) / F.sum("k"), 4).alias("mean"))


@R.add(
    """WITH c AS (SELECT DISTINCT pair_id, cache_id, new_ratio AS r FROM regenerated_cache WHERE new_ratio IS NOT NULL AND new_ratio::VARCHAR <> 'nan' AND pair_id IS NOT NULL)
SELECT pair_id, cache_id AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r BETWEEN 0.7 AND 0.95 DESC, CASE WHEN r BETWEEN 0.7 AND 0.95 THEN 0 ELSE abs(r - 0.85) END, cache_id) AS k FROM c) WHERE k = 1"""
)
def m28_v08_closest_candidate(spark, d):
    """Per pair the first candidate in range, else the one closest to the target ratio."""
    c = table(spark, d, "regenerated_cache").select("pair_id", "cache_id", F.col("new_ratio").alias("r")).where("r IS NOT NULL AND NOT isnan(r) AND pair_id IS NOT NULL").distinct()
    inside = F.col("r").between(0.7, 0.95)
    order = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(F.abs(F.col("r") - 0.85)).alias("far"), F.col("cache_id").alias("id"))
    return c.groupBy("pair_id").agg(F.min(order)["id"].alias("chosen"))


# Term weights of both texts; accents are stripped on both sides alike.
_TERMS = r"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\p{{L}}\p{{N}}_]{{2,}}')"
_TFIDF = (
    P
    + f""", w AS (SELECT pair_id, 'a' AS side, {_TERMS.format(c='ai')} AS w FROM p UNION ALL SELECT pair_id, 'h', {_TERMS.format(c='hu')} FROM p),
t AS (SELECT pair_id, side, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
f AS (SELECT pair_id, side, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT 2 * count(*) AS n FROM p),
x AS (SELECT pair_id, side, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS weight FROM f JOIN df USING (term), n),
l AS (SELECT pair_id, side, sqrt(sum(weight * weight)) AS norm FROM x GROUP BY pair_id, side),
dot AS (SELECT a.pair_id, sum(a.weight * b.weight) AS dot FROM x a JOIN x b ON a.pair_id = b.pair_id AND a.term = b.term AND a.side = 'a' AND b.side = 'h' GROUP BY a.pair_id)
SELECT p.pair_id, round(coalesce(dot / (la.norm * lh.norm), 0.0), 5) AS similarity FROM p LEFT JOIN dot USING (pair_id) LEFT JOIN l la ON la.pair_id = p.pair_id AND la.side = 'a' LEFT JOIN l lh ON lh.pair_id = p.pair_id AND lh.side = 'h'"""
)


@R.add(_TFIDF)
def v01_a17_j05_tfidf(spark, d):
    return similarity.tfidf_pairs(derived(spark, d, "pair_id", "ai", "hu"))


@R.add("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 5) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def v02_vector_similarity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(M.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@R.add()
def v03_j03_encode_distinct(spark, d):
    """Encode each distinct sentence once (hashed stand-in encoder) and join the vectors back."""
    from tandemtext.operators import models

    sent = pairs(spark, d).select("pair_id", F.posexplode(T.sentences(F.col("hu"))).alias("idx", "sentence"))
    vectors = models.encode(sent.select("sentence").distinct(), "sentence")
    return sent.join(vectors, "sentence").select("pair_id", "idx", F.size("vector").alias("dims"))


@R.add()
def v04_entailment(spark, d):
    from tandemtext.operators import models

    return models.entailment(derived(spark, d, "pair_id", "ai", "hu"))


@R.add()
def v05_rewrite(spark, d):
    from tandemtext.operators import models

    return models.rewrite(derived(spark, d, "pair_id", "ai"), "ai")


@R.add()
def v06_f23_encoded_examples(spark, d):
    from tandemtext.operators import models

    return models.encode_examples(derived(spark, d, "pair_id", "ai", "hu"), most=1024).select("pair_id", F.size("example.input_ids").alias("tokens"), F.size(F.filter("example.labels", lambda x: x >= 0)).alias("answer_tokens"))


@R.add()
def v07_padded_batches(spark, d):
    """Examples in batches of 16, padded to the longest of each."""
    from tandemtext.operators import models

    rows = models.collate(models.encode_examples(derived(spark, d, "pair_id", "ai", "hu"), most=1024), 16)
    return rows.select("batch", "pair_id", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("tokens"))
