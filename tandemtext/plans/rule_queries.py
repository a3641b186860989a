"""Classifiers, filters and the threshold sweep over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemtext.functions import metrics as M
from tandemtext.functions import text as T
from tandemtext.operators import rules as U
from tandemtext.operators import similarity
from tandemtext.plans.base import CLEAN_SQL, Registry, audited, audited_sql, collapse, count, delivered, derived, lab, num, pairs, pairs_sql, s, sents, space_words, strip, strip_artifacts, tokens
from tandemtext.plans.text_queries import model_output
from tandemtext.sources.tables import table

R = Registry()
P, A = f"WITH {pairs_sql()} ", f"WITH {audited_sql()} "
# The SQL below has its own copy of every value, so that it tells when the library's is wrong.


def _in(c: str, terms: str) -> str:
    return f"coalesce(len(list_filter({tokens(c)}, lambda w: w IN ({terms}))), 0)"


INFORMAL_SQL = """'lol','lmao','lmfao','rofl','omg','btw','idk','imo','imho','tbh','ngl','ikr','bruh','bro','dude','yep','yup','nah','nope','gonna','wanna','gotta','kinda','sorta',
'ain''t','lemme','gimme','cuz','coz','tho','thx','pls','plz','haha','hehe','hahaha'"""
SLANG_SQL = "'fr','rn','sus','af','ong','istg','smh','fyi','wbu','hbu','wyd','wym','tf','lmk','asap'"
PROFANITY_SQL = "'fuck','fucking','fucked','shit','bullshit','bitch','asshole','damn','crap','dick','piss'"
_PUNCT_SQL = "coalesce(len(regexp_extract_all(hu, '[!?.,;:]{3,}')), 0)"


@R.add(f"{P} SELECT pair_id FROM p WHERE {collapse('ai')} <> '' AND {collapse('hu')} <> ''")
def f01_non_empty(spark, d):
    return pairs(spark, d).where((T.collapse(F.col("ai")) != "") & (T.collapse(F.col("hu")) != "")).select("pair_id")


@R.add(
    f"""{P} SELECT pair_id, left(hu, 500) AS excerpt, category AS assigned, 'excluded phrase' AS reason FROM p WHERE
  (category = 'essay' AND (contains(lower(hu), 'dear sir') OR contains(lower(hu), 'dear madam') OR contains(lower(hu), 'subject:') OR contains(lower(hu), 'sincerely,') OR contains(lower(hu), 'regards,')))
  OR (category = 'academic' AND (contains(lower(hu), 'dear ') OR contains(lower(hu), 'subject:') OR contains(lower(hu), 'sincerely,')))
  OR (category = 'document' AND (contains(lower(hu), 'dear sir') OR contains(lower(hu), 'dear madam') OR contains(lower(hu), 'love,') OR contains(lower(hu), 'xoxo')))"""
)
def f02_snk03_category_rejects(spark, d):
    rows = pairs(spark, d).where(~U.consistent(F.col("hu"), F.col("category")))
    return rows.select("pair_id", F.left(F.col("hu"), F.lit(500)).alias("excerpt"), F.col("category").alias("assigned"), F.lit("excluded phrase").alias("reason"))


_MARKED = " OR ".join(f"contains(left(lower(coalesce(c, '')), 80), {m})" for m in ("'i cannot'", "'i can''t'", "'as an ai'", "'here is the rewritten'", "'here''s the rewritten'", "'sure, here'", "'i''m sorry'"))


@R.add(
    f"{P}, o AS (SELECT pair_id, ai, hu, {model_output('ai')} AS c FROM p), w AS (SELECT *, {space_words('c')} AS aw, {space_words('hu')} AS hw, ({_MARKED}) AS refused FROM o) "
    f"SELECT pair_id, coalesce(length(ai) > 0 AND length(hu) > 0 AND length(c) > 0 AND NOT refused AND aw BETWEEN 30 AND 640 AND (hw = 0 OR aw / greatest(hw, 1) BETWEEN 0.55 AND 1.65) AND {strip('c')} <> {strip('hu')}, false) AS passes FROM w"
)
def f03_quality_gate(spark, d):
    return derived(spark, d, "pair_id", U.passes_quality(F.col("ai"), F.col("hu")).alias("passes"))


@R.add(f'SELECT DISTINCT pair_id FROM train_normalized t WHERE pair_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM regenerated_cache c WHERE c.pair_id = t.pair_id)')
def f04_j06_resume(spark, d):
    done = table(spark, d, "regenerated_cache").select("pair_id").distinct()
    return table(spark, d, "train_normalized").select("pair_id").where("pair_id IS NOT NULL").distinct().join(done, "pair_id", "left_anti")


@R.add(
    f"""{P}, w AS (SELECT pair_id, {strip('ai')} AS a, {strip('hu')} AS h, {space_words('ai')} AS aw, {space_words('hu')} AS hw FROM p)
SELECT pair_id, coalesce(aw >= 30 AND hw >= 30 AND hw / greatest(aw, 1) BETWEEN 0.55 AND 1.85 AND regexp_matches(h, '^[A-Z0-9"“”‘’]') AND regexp_matches(h, '[.!?]["“”‘’)]?\\z')
  AND regexp_matches(a, '^[A-Z0-9"“”‘’*#]') AND regexp_matches(a, '[.!?]["“”‘’)]?\\z') AND NOT regexp_matches(h, '\\([^)]*\\z') AND NOT regexp_matches(h, '\\[[^\\]]*\\z'), false) AS valid FROM w"""
)
def f05_valid_pair(spark, d):
    return derived(spark, d, "pair_id", U.valid_pair(F.col("ai"), F.col("hu")).alias("valid"))


@R.add(
    f"{P}, w AS (SELECT pair_id, {_PUNCT_SQL} AS punct, {_in('hu', INFORMAL_SQL)} AS informal, {_in('hu', SLANG_SQL)} AS slang, {_in('hu', PROFANITY_SQL)} AS profanity, ai_human_word_ratio AS r FROM p) "
    "SELECT pair_id, CASE WHEN punct >= 2 OR profanity >= 2 THEN 'C' WHEN slang >= 3 OR informal >= 3 OR coalesce(r < 0.4 OR r > 1.6, false) THEN 'B' ELSE 'A' END AS tier FROM w"
)
def f06_tier_by_style(spark, d):
    """Letter runs are left out here as in SQL, which has no back-references; :func:`f06_tier_with_runs` has them."""
    w = derived(spark, d, "pair_id", "hu", T.words(F.col("hu")).alias("w"), "ai_human_word_ratio")
    tier = U.tier_by_style(F.lit("none"), F.lit(1), F.coalesce(F.regexp_count("hu", F.lit(M.PUNCTUATION_RUN)), F.lit(0)), M.lexicon(F.col("w"), M.PROFANITY), M.lexicon(F.col("w"), M.SLANG), M.lexicon(F.col("w"), M.INFORMAL), F.col("ai_human_word_ratio"))
    return w.select("pair_id", tier.alias("tier"))


@R.add(
    f"""{P}, c AS (SELECT pair_id, unnest(string_split(hu, '')) AS ch, generate_subscripts(string_split(hu, ''), 1) AS i FROM p WHERE length(hu) > 0), g AS (SELECT pair_id, ch, i - row_number() OVER (PARTITION BY pair_id, ch ORDER BY i) AS g FROM c),
n AS (SELECT pair_id, count(*) AS run FROM g GROUP BY pair_id, ch, g), m AS (SELECT pair_id, max(run) AS run FROM n GROUP BY pair_id),
w AS (SELECT p.pair_id, coalesce(run, 0) AS run, {_PUNCT_SQL} AS punct, {_in('hu', INFORMAL_SQL)} AS informal, {_in('hu', SLANG_SQL)} AS slang, {_in('hu', PROFANITY_SQL)} AS profanity, ai_human_word_ratio AS r FROM p LEFT JOIN m USING (pair_id))
SELECT pair_id, run::INTEGER AS run, CASE WHEN run >= 4 OR punct >= 2 OR profanity >= 2 THEN 'C' WHEN slang >= 3 OR informal >= 3 OR coalesce(r < 0.4 OR r > 1.6, false) THEN 'B' ELSE 'A' END AS tier FROM w"""
)
def f06_tier_with_runs(spark, d):
    w = derived(spark, d, "pair_id", "hu", T.words(F.col("hu")).alias("w"), M.letter_run(F.col("hu")).alias("run"), "ai_human_word_ratio")
    tier = U.tier_by_style(M.elongation(F.col("run")), F.col("run"), F.coalesce(F.regexp_count("hu", F.lit(M.PUNCTUATION_RUN)), F.lit(0)), M.lexicon(F.col("w"), M.PROFANITY), M.lexicon(F.col("w"), M.SLANG), M.lexicon(F.col("w"), M.INFORMAL), F.col("ai_human_word_ratio"))
    return w.select("pair_id", "run", tier.alias("tier"))


@R.add(
    f"WITH p AS (SELECT pair_id, any_value({num('sbert_similarity')}) AS sb, any_value({num('nli_contradiction_prob')}) AS co, any_value({num('ai_human_word_ratio')}) AS r, any_value(human_elongation_level) AS el, any_value(human_informal_count) AS inf FROM final_scored GROUP BY pair_id), "
    "f AS (SELECT pair_id, coalesce(sb, 0) AS sb, coalesce(co, 0) AS co, coalesce(r, 1) AS r, coalesce(el, 'none') AS el, coalesce(inf, 0) AS inf FROM p) "
    "SELECT pair_id, CASE WHEN sb < 0.72 OR co > 0.25 OR el IN ('extreme', 'strong') THEN 'C' WHEN sb < 0.80 OR r < 0.65 OR r > 1.40 OR inf >= 3 THEN 'B' ELSE 'A' END AS tier FROM f"
)
def f07_tier_by_scores(spark, d):
    p = pairs(spark, d, "final_scored", "human_elongation_level", "human_informal_count")
    tier = U.tier_by_scores(U.or_value("sbert_similarity", 0.0), U.or_value("nli_contradiction_prob", 0.0), U.or_value("ai_human_word_ratio", 1.0), F.coalesce("human_elongation_level", F.lit("none")), F.coalesce("human_informal_count", F.lit(0)))
    return p.select("pair_id", tier.alias("tier"))


@R.add(
    f"""{P} SELECT pair_id, CASE WHEN sbert_similarity IS NULL THEN NULL WHEN sbert_similarity < 0.55 THEN 'LOW' WHEN sbert_similarity < 0.68 THEN 'REVIEW' WHEN sbert_similarity < 0.78 THEN 'MEDIUM' ELSE 'HIGH' END AS sbert_flag,
  CASE WHEN sbert_similarity IS NULL THEN NULL WHEN sbert_similarity < 0.65 THEN 'LOW' WHEN sbert_similarity < 0.78 THEN 'MEDIUM' ELSE 'HIGH' END AS regenerated_flag,
  CASE WHEN tfidf_similarity IS NULL THEN NULL WHEN tfidf_similarity < 0.15 THEN 'LOW' WHEN tfidf_similarity < 0.30 THEN 'REVIEW' WHEN tfidf_similarity < 0.55 THEN 'MEDIUM' ELSE 'HIGH' END AS tfidf_flag FROM p"""
)
def f08_f09_f10_similarity_flags(spark, d):
    sb, tf = F.col("sbert_similarity"), F.col("tfidf_similarity")
    return derived(spark, d, "pair_id", U.banded(sb, U.SBERT_FLAGS).alias("sbert_flag"), U.banded(sb, U.REGENERATED_FLAGS).alias("regenerated_flag"), U.banded(tf, U.TFIDF_FLAGS).alias("tfidf_flag"))


@R.add(f"{P} SELECT pair_id, CASE WHEN nli_contradiction_prob >= 0.5 THEN 'CONTRADICTION' WHEN nli_entailment_prob >= 0.7 THEN 'ENTAILMENT' WHEN nli_entailment_prob < 0.35 THEN 'LOW_ENTAILMENT' ELSE 'REVIEW' END AS nli_flag FROM p")
def f11_nli_flag(spark, d):
    return derived(spark, d, "pair_id", U.nli_flag(F.col("nli_entailment_prob"), F.col("nli_contradiction_prob")).alias("nli_flag"))


@R.add(
    f"{P}, w AS (SELECT *, {space_words('ai')} AS aw, {space_words('hu')} AS hw FROM p) SELECT pair_id, coalesce(sbert_similarity < 0.7, false) OR coalesce(nli_contradiction_prob > 0.35, false) OR coalesce(ai_human_word_ratio < 0.6 OR ai_human_word_ratio > 1.6, false) OR aw < 30 OR hw < 30 AS risk, "
    "CASE WHEN nli_contradiction_prob > 0.35 THEN 'CONTRADICTION' WHEN sbert_similarity < 0.7 THEN 'LOW_SIMILARITY' WHEN coalesce(ai_human_word_ratio < 0.6 OR ai_human_word_ratio > 1.6, false) OR aw < 30 OR hw < 30 THEN 'LENGTH_MISMATCH' WHEN sbert_similarity >= 0.8 THEN 'HIGH_CONFIDENCE' ELSE 'ACCEPTABLE' END AS status FROM w"
)
def f12_f13_semantic_status(spark, d):
    sb, co, r = F.col("sbert_similarity"), F.col("nli_contradiction_prob"), F.col("ai_human_word_ratio")
    a, h = T.space_words(F.col("ai")), T.space_words(F.col("hu"))
    return derived(spark, d, "pair_id", U.semantic_risk(sb, co, r, a, h).alias("risk"), U.semantic_status(sb, co, r, a, h).alias("status"))


@R.add(f"{P} SELECT pair_id, coalesce(nullif(concat_ws(',', CASE WHEN {_in('hu', PROFANITY_SQL)} >= 1 THEN 'profanity' END, CASE WHEN {_in('hu', SLANG_SQL)} >= 1 THEN 'slang' END, CASE WHEN {_PUNCT_SQL} >= 2 THEN 'punctuation' END), ''), 'style_noise') AS review_reason FROM p")
def f14_review_reason(spark, d):
    w = derived(spark, d, "pair_id", "hu", T.words(F.col("hu")).alias("w"))
    parts = [F.when(M.lexicon(F.col("w"), M.PROFANITY) >= 1, "profanity"), F.when(M.lexicon(F.col("w"), M.SLANG) >= 1, "slang"), F.when(F.coalesce(F.regexp_count("hu", F.lit(M.PUNCTUATION_RUN)), F.lit(0)) >= 2, "punctuation")]
    return w.select("pair_id", F.coalesce(F.nullif(F.concat_ws(",", *parts), F.lit("")), F.lit("style_noise")).alias("review_reason"))


_MED = """, med AS (SELECT category, quantile_cont(human_cliche_density, 0.5) AS median FROM a WHERE category IS NOT NULL AND contains(human_source, 'hf_dataset_import') GROUP BY category),
b AS (SELECT a.*, coalesce(median, {default}) AS median, coalesce(contains(human_source, 'llm_regenerated'), false) AS regen, coalesce(category IN ('essay', 'academic'), false) AS strict,
  coalesce(category IN ('email', 'document'), false) AS relaxed FROM a LEFT JOIN med USING (category))"""
_AUDITED, _CLEANED = A + _MED.format(default="5.0"), f"WITH {audited_sql(CLEAN_SQL)} " + _MED.format(default="0.0")


@R.add(
    _AUDITED
    + """ SELECT pair_id, coalesce(min_cov < 0.55 OR mean_cov < 0.75, false) AS rule_coverage, coalesce(CASE WHEN strict THEN copy_rate > 0.60 ELSE copy_rate > 0.75 END, false) AS rule_copying,
  coalesce(human_cliche_density > 2.0 * median, false) AS rule_cliches, coalesce(ratio < 0.70, false) AS rule_short, coalesce(has_title_leakage OR has_trailing_references, false) AS rule_artifacts FROM b"""
)
def f15_j02_audit_rules(spark, d):
    return U.with_median(audited(spark, d), "human_cliche_density", U.AUDIT_MEDIAN).select("pair_id", *[U.is_true(c).alias(f"rule_{n}") for n, c in U.audit_rules()])


def _cleaned(spark, d):
    """Audited pairs with length ratio and cliches of the human text without its artifacts, beside the category's median."""
    clean, hu_words, ai_words = T.strip_artifacts(F.coalesce("Human Text", F.lit(""))), T.space_words(F.col("clean")), T.space_words(F.col("AI Text"))
    measured = lambda df: df.withColumn("clean", clean).withColumns({"clean_ratio": M.ratio(hu_words, ai_words), "clean_cliches": M.cliche_density(F.col("clean")), "clean_stems": M.stem_density(F.col("clean"))})
    return U.with_median(audited(spark, d, measured, "clean_ratio", "clean_cliches", "clean_stems"), "human_cliche_density", U.FILTER_MEDIAN)


@R.add(
    _CLEANED
    + """ SELECT pair_id, concat_ws('; ', CASE WHEN clean_ratio < 0.70 THEN 'short' END, CASE WHEN min_cov < 0.55 OR mean_cov < 0.75 THEN 'coverage' END,
  CASE WHEN CASE WHEN strict THEN copy_rate > 0.60 ELSE copy_rate > 0.75 END THEN 'copying' END, CASE WHEN clean_cliches > greatest(2.0 * median, 4.0) THEN 'cliches' END) AS reason FROM b"""
)
def f16_first_filter(spark, d):
    return U.filtered(_cleaned(spark, d), U.first_filter()).select("pair_id", "reason")


@R.add(
    _CLEANED
    + """ SELECT pair_id, concat_ws('; ', CASE WHEN clean_ratio < 0.70 OR clean_ratio > 0.95 THEN 'ratio' END, CASE WHEN clean_stems > greatest(2.0 * median, 4.0) THEN 'cliches' END, CASE WHEN fact_retention < 0.60 THEN 'facts' END,
  CASE WHEN NOT relaxed AND mean_cov < 0.65 THEN 'coverage' END, CASE WHEN NOT relaxed AND CASE WHEN regen THEN copy_rate > 0.50 ELSE copy_rate > 0.85 END THEN 'copying' END) AS reason FROM b"""
)
def f17_final_filter(spark, d):
    return U.filtered(_cleaned(spark, d), U.final_filter()).select("pair_id", "reason")


_VERB_SQL = "(?:is|are|was|were|be|been|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must|[a-z]{2,}(?:ed|ing|ise|ize|ises|izes|ates|ify|ifies))"


def _opened(spark, d):
    """``clean`` human text, its first sentence, whether that has a verb's shape, and the machine text."""
    o = derived(spark, d, "pair_id", "ai", T.strip_artifacts(F.coalesce("hu", F.lit(""))).alias("clean")).withColumn("first", F.get(T.sentences(F.col("clean")), 0))
    return o.withColumn("has_verb", M.has_verb(F.col("first")))


@R.add(
    f"{P}, c AS (SELECT pair_id, {strip_artifacts('hu')} AS clean FROM p), o AS (SELECT pair_id, coalesce(clean, '') AS clean, {sents('clean')}[1] AS first FROM c) SELECT pair_id, concat_ws('; ', CASE WHEN clean = '' THEN 'empty' END, "
    f"CASE WHEN regexp_matches(clean, '^\\p{{Ll}}') THEN 'lowercase' END, CASE WHEN clean <> '' AND coalesce(len(list_filter({tokens('first')}, lambda w: regexp_full_match(w, '{_VERB_SQL}'))), 0) = 0 THEN 'fragment' END) AS reason FROM o"
)
def f18_opening_rules(spark, d):
    """The rules that need no encoder; :func:`f18_opening_mismatch` has the cosine as well."""
    return U.filtered(_opened(spark, d).withColumn("opening", F.lit(None).cast("double")), U.opening_rules()).select("pair_id", "reason")


@R.add()
def f18_opening_mismatch(spark, d):
    """All opening rules, the best cosine of the first sentence with a machine sentence among them (stand-in encoder)."""
    o = _opened(spark, d)
    found = similarity.audited_sentences(o.select("pair_id", "ai", F.col("first").alias("hu"))).select("pair_id", "opening")
    return U.filtered(o.select("pair_id", "clean", "has_verb").join(found, "pair_id", "left"), U.opening_rules()).select("pair_id", F.round("opening", 4).alias("opening"), "reason")


_SWEEP = (
    _CLEANED
    + """, g AS (SELECT row_number() OVER (ORDER BY m, f, r, c, k) AS combo, m AS t_mean_cov, f AS t_fact, r AS t_copy_regenerated, c AS t_copy_collected, k AS t_cliche_factor
  FROM (VALUES (0.65::DOUBLE), (0.70), (0.75)) AS a(m), (VALUES (0.60::DOUBLE), (0.70), (0.80)) AS b1(f), (VALUES (0.50::DOUBLE), (0.60)) AS c1(r), (VALUES (0.60::DOUBLE), (0.75), (0.85)) AS d1(c), (VALUES (2.0::DOUBLE), (3.0)) AS e1(k)),
j AS (SELECT b.*, g.*, NOT (coalesce(clean_ratio < 0.70, false) OR coalesce(human_cliche_density > greatest(t_cliche_factor * median, 4.0), false) OR coalesce(fact_retention < t_fact, false)
  OR (NOT relaxed AND (coalesce(mean_cov < t_mean_cov, false) OR coalesce(CASE WHEN regen THEN copy_rate > t_copy_regenerated WHEN strict THEN copy_rate > t_copy_collected ELSE copy_rate > 0.85 END, false)))) AS kept FROM b, g),
sw AS (SELECT combo::INTEGER AS combo, t_mean_cov, t_fact, t_copy_regenerated, t_copy_collected, t_cliche_factor, count(*) FILTER (WHERE kept) AS survivors,
  count(*) FILTER (WHERE kept AND category = 'academic') AS n_academic, count(*) FILTER (WHERE kept AND category = 'document') AS n_document, count(*) FILTER (WHERE kept AND category = 'email') AS n_email,
  count(*) FILTER (WHERE kept AND category = 'essay') AS n_essay, count(*) FILTER (WHERE kept AND category = 'general') AS n_general, count(*) FILTER (WHERE kept AND regen) AS n_regenerated,
  coalesce(round(100 * count(*) FILTER (WHERE kept AND clean_ratio >= 0.7 AND clean_ratio < 0.8) / nullif(count(*) FILTER (WHERE kept), 0), 1), 0.0) AS ratio_070_080,
  coalesce(round(100 * count(*) FILTER (WHERE kept AND clean_ratio >= 0.8 AND clean_ratio < 0.9) / nullif(count(*) FILTER (WHERE kept), 0), 1), 0.0) AS ratio_080_090,
  round(coalesce(avg(burstiness) FILTER (WHERE kept), 0.0), 2) AS mean_burstiness, round(coalesce(avg(contraction_rate) FILTER (WHERE kept), 0.0), 2) AS mean_contractions,
  round(coalesce(avg(human_cliche_density) FILTER (WHERE kept), 0.0), 2) AS mean_cliches, round(coalesce(avg(quality_score) FILTER (WHERE kept), 0.0), 2) AS mean_quality FROM j GROUP BY ALL) """
)


@R.add(_SWEEP + "SELECT * FROM sw")
def f19_j09_a14_sweep(spark, d):
    return U.sweep(_cleaned(spark, d))


@R.add(_SWEEP + "SELECT combo, survivors FROM sw ORDER BY t_copy_regenerated <= 0.60 AND mean_cliches <= 0.70 DESC, survivors DESC, mean_quality DESC, combo LIMIT 1")
def l01_l02_recommended(spark, d):
    """The best combination with few cliches; without any such the one with most survivors."""
    ok = (F.col("t_copy_regenerated") <= 0.6) & (F.col("mean_cliches") <= 0.7)
    return U.sweep(_cleaned(spark, d)).orderBy(ok.desc(), F.col("survivors").desc(), F.col("mean_quality").desc(), "combo").limit(1).select("combo", "survivors")


@R.add(_SWEEP + "SELECT combo, survivors FROM (SELECT *, row_number() OVER (ORDER BY survivors DESC, combo) AS f, row_number() OVER (ORDER BY survivors, combo DESC) AS l FROM sw) WHERE f <= 5 OR l <= 5")
def l03_best_and_worst(spark, d):
    sw = U.sweep(_cleaned(spark, d)).select("combo", "survivors")
    top = sw.orderBy(F.col("survivors").desc(), "combo").limit(5)
    return top.union(sw.orderBy("survivors", F.col("combo").desc()).limit(5)).distinct()


@R.add(A + "SELECT pair_id FROM a WHERE NOT coalesce(round(human_words / greatest(ai_words, 1), 4) < 0.7, false)")
def f20_short_purge(spark, d):
    return audited(spark, d).where(~U.is_true(M.ratio(F.col("human_words"), F.col("ai_words")) < 0.7)).select("pair_id")


@R.add("SELECT DISTINCT cache_id FROM regenerated_cache WHERE lower(trim(split)) LIKE 'tr%' AND new_ratio >= 0.85 AND sbert_similarity >= 0.7 AND new_ratio::VARCHAR <> 'nan' AND sbert_similarity::VARCHAR <> 'nan'")
def f21_accepted(spark, d):
    from tandemtext.sources.tables import number, split_label

    return table(spark, d, "regenerated_cache").where((split_label("split") == "train") & (number("new_ratio") >= 0.85) & (number("sbert_similarity") >= 0.7)).select("cache_id").distinct()


_T = f"WITH {pairs_sql('train_normalized')} "


@R.add(
    f"{_T}, w AS (SELECT pair_id, {strip('ai')} AS a, {strip('hu')} AS h, {space_words('ai')} AS aw, {space_words('hu')} AS hw FROM p), o AS (SELECT *, coalesce(a, '') <> '' AND coalesce(h, '') <> '' AS full_, row_number() OVER (PARTITION BY coalesce(a, ''), coalesce(a, '') <> '' AND coalesce(h, '') <> '' AND aw >= 25 AND hw >= 25 ORDER BY pair_id) AS k FROM w) "
    "SELECT pair_id, CASE WHEN NOT full_ THEN 'empty' WHEN aw < 25 OR hw < 25 THEN 'too_short' WHEN k > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM o"
)
def f22_a15_training_pairs(spark, d):
    """Duplicates are told by hash groups of the text: the lowest id of a text stays."""
    p = pairs(spark, d, "train_normalized").select("pair_id", F.coalesce(T.strip(F.col("ai")), F.lit("")).alias("a"), F.coalesce(T.strip(F.col("hu")), F.lit("")).alias("h"), T.space_words(F.col("ai")).alias("aw"), T.space_words(F.col("hu")).alias("hw"))
    first = F.when((F.col("a") == "") | (F.col("h") == ""), "empty").when((F.col("aw") < 25) | (F.col("hw") < 25), "too_short")
    p = p.select("pair_id", F.xxhash64("a", F.length("a")).alias("key"), first.alias("r"))
    keep = p.where("r IS NULL").groupBy("key").agg(F.min("pair_id").alias("keep"))
    return p.join(keep, "key", "left").select("pair_id", F.coalesce("r", F.when(F.col("pair_id") == F.col("keep"), "kept").otherwise("duplicate")).alias("reason"))


@R.add(A + ", q AS (SELECT quantile_cont(human_cliche_density, 0.9) AS q FROM a) SELECT pair_id, coalesce(copy_rate > 0.8, false) AS copied, coalesce(min_cov < 0.55, false) AS uncovered, coalesce(human_cliche_density > q, false) AS cliched FROM a, q")
def f24_a04_bins(spark, d):
    a = audited(spark, d)
    q = a.agg(F.percentile("human_cliche_density", F.lit(0.9)).alias("q"))
    return a.crossJoin(F.broadcast(q)).select("pair_id", U.is_true(F.col("copy_rate") > 0.8).alias("copied"), U.is_true(F.col("min_cov") < 0.55).alias("uncovered"), U.is_true(F.col("human_cliche_density") > F.col("q")).alias("cliched"))


@R.add(f"{P} SELECT pair_id, coalesce(contains(human_source, 'llm_regenerated'), false) AS regenerated, coalesce(contains(human_source, 'hf_dataset_import'), false) AS collected FROM p")
def f25_source_test(spark, d):
    return derived(spark, d, "pair_id", U.regenerated().alias("regenerated"), U.is_true(F.contains("human_source", F.lit("hf_dataset_import"))).alias("collected"))


@R.add(
    f"""{P} SELECT pair_id, CASE WHEN category IN ('essay', 'academic') THEN 0.60 ELSE 0.75 END::DOUBLE AS copy_limit, coalesce(category NOT IN ('email', 'document'), true) AS coverage_rule,
  CASE category WHEN 'essay' THEN 5 WHEN 'academic' THEN 3 WHEN 'document' THEN 4 ELSE 0 END AS excluded_phrases FROM p"""
)
def j10_category_rules(spark, d):
    """The rules that hold for each pair's category, looked up in literal maps."""
    strict, relaxed = U.is_true(F.col("category").isin(*U.STRICT)), U.is_true(F.col("category").isin(*U.RELAXED))
    phrases = F.lit(0)
    for name, terms in U.EXCLUDED.items():
        phrases = F.when(F.col("category") == name, len(terms)).otherwise(phrases)
    return derived(spark, d, "pair_id", F.when(strict, U.FIRST.copy_strict).otherwise(U.FIRST.copy_loose).alias("copy_limit"), (~relaxed).alias("coverage_rule"), phrases.alias("excluded_phrases"))


@R.add(f'SELECT DISTINCT t.pair_id, coalesce(length(t."AI Text"), 0) AS own, coalesce(length(a."AI Text"), 0) AS audited FROM train_normalized t JOIN audit_scores a USING (pair_id) WHERE t.pair_id IS NOT NULL')
def j12_alignment(spark, d):
    """Rows of two tables that belong together, by key instead of by place."""
    own = table(spark, d, "train_normalized").select("pair_id", F.coalesce(F.char_length("AI Text"), F.lit(0)).alias("own")).distinct()
    other = table(spark, d, "audit_scores").select("pair_id", F.coalesce(F.char_length("AI Text"), F.lit(0)).alias("audited")).distinct()
    return own.join(other, "pair_id")
