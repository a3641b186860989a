"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemtext.functions import text as T
from tandemtext.plans.base import Registry, collapse, count, derived, pairs, pairs_sql, s, sents, space_words, strip, strip_artifacts, sub, sub1, texts, tokens

R = Registry()
P = f"WITH {pairs_sql()} "


@R.add(f"SELECT doc_id, {collapse('text')} AS clean FROM documents")
def t01_collapse(spark, d):
    return texts(spark, d).select("doc_id", T.collapse(F.col("text")).alias("clean"))


@R.add(f"SELECT doc_id, coalesce({tokens('text')}, []::VARCHAR[]) AS words FROM documents")
def t02_words(spark, d):
    return texts(spark, d).select("doc_id", F.coalesce(T.words(F.col("text")), F.array().cast("array<string>")).alias("words"))


@R.add(f"SELECT doc_id, {count('text', T.WORD)} AS tokens, {space_words('text')} AS words, coalesce(length(text), 0) AS chars FROM documents")
def t03_t04_t05_counts(spark, d):
    t = F.col("text")
    return texts(spark, d).select("doc_id", T.word_count(t).alias("tokens"), T.space_words(t).alias("words"), T.char_count(t).alias("chars"))


def _normalize(c: str) -> str:
    for entity, plain in T.ENTITIES:
        c = f"replace({c}, {s(entity)}, {s(plain)})"
    c = sub(sub(c, r"<[bB][rR] */?>", " "), r"<[^>]+>")
    c = sub(sub(c, T.INVISIBLE), T.BOXES, " ")
    c = sub(c, r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " ")
    return strip(sub(sub(c, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


@R.add(f"SELECT doc_id, {_normalize('text')} AS normal FROM documents")
def t06_normalize(spark, d):
    return texts(spark, d).select("doc_id", T.normalize(F.col("text")).alias("normal"))


@R.add(f"SELECT source, count(*) AS texts, count(*) FILTER (WHERE text IS DISTINCT FROM {_normalize('text')}) AS changed FROM documents GROUP BY source")
def t07_changed_cells(spark, d):
    from tandemtext.sources.tables import table

    docs = table(spark, d, "documents").select("source", "text")
    return docs.groupBy("source").agg(F.count("*").alias("texts"), F.count_if(~F.col("text").eqNullSafe(T.normalize(F.col("text")))).alias("changed"))


@R.add("SELECT doc_id, " + strip(sub(sub(sub("coalesce(text, '')", r"\r\n?", "\n"), r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")) + " AS tidy FROM documents")
def t08_tidy_lines(spark, d):
    return texts(spark, d).select("doc_id", T.tidy_lines(F.col("text")).alias("tidy"))


def _unquote(c: str) -> str:
    return f"""CASE WHEN starts_with({c}, '"') AND ends_with({c}, '"') AND length({c}) > 1 THEN {sub(c, '^"|"' + chr(92) + 'z')} ELSE {c} END"""


def model_output(c: str) -> str:
    c = strip(sub(c, r"(?is)<(?:think|thought)>.*?</(?:think|thought)>"))
    c = sub1(c, r"(?i)^\s*(?:\*\*|##)?\s*(?:here(?:'s| is) (?:the |a )?(?:rewritten|revised|formal|ai-style|modified)?\s*(?:text|version|passage|essay|email|report|document)?[:\-]?\s*(?:\*\*|##)?)\s*")
    c = sub1(c, r"(?i)^\s*(?:\*\*|##)?\s*(?:rewritten|revised|aiified)\s*(?:text|version|passage)?[:\-]?\s*(?:\*\*|##)?\s*")
    c = strip(sub1(c, r"(?i)\n+(?:let me know if|i hope this helps|hope this helps|feel free to ask)[^\n]*\z"))
    return strip(sub1(sub1(c, r'(?s)^"(.*)"\z', r"\1"), r"(?s)^'(.*)'\z", r"\1"))


@R.add(f"{P} SELECT pair_id, {model_output('hu')} AS output FROM p")
def t09_model_output(spark, d):
    return derived(spark, d, "pair_id", T.model_output(F.col("hu")).alias("output"))


@R.add(f"{P}, o AS (SELECT pair_id, {strip('string_split(hu, ' + s('</think>') + ')[-1]')} AS x FROM p) SELECT pair_id, {_unquote('x')} AS output FROM o")
def t10_after_thinking(spark, d):
    return derived(spark, d, "pair_id", T.after_thinking(F.col("hu")).alias("output"))


@R.add(f"{P} SELECT pair_id, {strip_artifacts('hu')} AS stripped FROM p")
def t11_strip_artifacts(spark, d):
    return derived(spark, d, "pair_id", T.strip_artifacts(F.col("hu")).alias("stripped"))


def _repair() -> str:
    c1 = sub("hu", r"([A-Za-z])\?(t|s|re|ve|ll|d|m)\b", r"\1'\2")
    mail = sub(sub("c", r"\n-+ ?(?:Forwarded|Original) (?:by|Message|message)(?s:.)*\z"), r"(?m)^(?:From|To|Cc|Sent|Subject):[^\n]*\n")
    c3 = sub("c", r"\n[ \t]*(?:References|Works Cited|Bibliography|Sources)[ \t]*:?[ \t]*\n(?s:.)*\z")
    site = sub("c", r"\([A-Za-z0-9-]+\.(?:com|org|net)[^)]*\)")
    opener = f"regexp_extract(c, {s(chr(40) + '?:[.!?][ ' + chr(92) + 't' + chr(92) + 'n]+|' + chr(92) + 'n[ ' + chr(92) + 't]*)([A-Z0-9' + chr(34) + '“][^.!?]*[.!?](?s:.)*)' + chr(92) + 'z')}, 1)"
    return f"""
, r1 AS (SELECT pair_id, category, {c1} AS c FROM p), r2 AS (SELECT pair_id, category, CASE WHEN category = 'email' THEN {mail} ELSE c END AS c FROM r1),
r3 AS (SELECT pair_id, category, {c3} AS c FROM r2), r4 AS (SELECT pair_id, CASE WHEN category IN ('essay', 'general') THEN {site} ELSE c END AS c FROM r3),
r5 AS (SELECT pair_id, CASE WHEN regexp_matches(c, '^[a-z]') THEN {opener} ELSE c END AS c FROM r4),
r6 AS (SELECT pair_id, {sub(sub("c", T.UNCLOSED), r"[ \t](?:et al|e\.g|i\.e|vs|cf)\.?\z")} AS c FROM r5)
SELECT pair_id, {strip(f"regexp_extract(c, {s(T.SENTENCE_TAIL)}, 1)")} AS repaired FROM r6"""


@R.add(P + _repair())
def t12_repair(spark, d):
    return derived(spark, d, "pair_id", T.repair(F.col("hu"), F.col("category")).alias("repaired"))


_FIRST = f"regexp_extract(hu, {s('^([^' + chr(92) + 'n]*)')}, 1)"


@R.add(
    f"{P}, f AS (SELECT pair_id, ai, hu, {_FIRST} AS first FROM p) SELECT pair_id, CASE WHEN {space_words('first')} <= 10 AND regexp_matches(lower(first), {s(r'^title:|(?:essay|research paper|paper|report)[ \t]*\z')}) "
    f"AND NOT contains(lower(ai), lower(first)) AND contains(hu, chr(10)) THEN {strip(sub1('hu', '^[^' + chr(92) + 'n]*' + chr(92) + 'n'))} ELSE {strip('hu')} END AS output FROM f"
)
def t13_humanized_output(spark, d):
    return derived(spark, d, "pair_id", T.humanized_output(F.col("hu"), F.col("ai")).alias("output"))


@R.add(f"{P} SELECT pair_id, {sents('hu')} AS sentences FROM p")
def t14_sentences(spark, d):
    return derived(spark, d, "pair_id", T.sentences(F.col("hu")).alias("sentences"))


@R.add(
    f"WITH w AS (SELECT doc_id, list_filter(string_split({collapse('text')}, ' '), lambda x: x <> '') AS w FROM documents), "
    "e AS (SELECT doc_id, w, unnest(range(0, greatest(ceil(len(w) / 120.0), 1)::BIGINT)) AS i FROM w) SELECT doc_id, i::INTEGER AS chunk, array_to_string(w[i * 120 + 1:i * 120 + 120], ' ') AS body FROM e WHERE len(w[i * 120 + 1:i * 120 + 120]) >= 50"
)
def t15_chunks(spark, d):
    w = F.filter(F.split(T.collapse(F.col("text")), " "), lambda x: x != "")
    rows = texts(spark, d).select("doc_id", w.alias("w"))
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / 120).cast("int"), F.lit(1)) - 1)).alias("chunk"))
    return rows.select("doc_id", "chunk", F.slice("w", F.col("chunk") * 120 + 1, F.lit(120)).alias("p")).where(F.size("p") >= 50).select("doc_id", "chunk", F.array_join("p", " ").alias("body"))


@R.add(
    rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM documents),
f(doc_id, ps, i, done, cur, w) AS (SELECT doc_id, ps, 0, []::VARCHAR[], '', 0::BIGINT FROM p UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN w + n > 300 AND w >= 150 THEN list_append(done, cur) ELSE done END, CASE WHEN cur = '' OR (w + n > 300 AND w >= 150) THEN x ELSE cur || chr(10) || chr(10) || x END, CASE WHEN w + n > 300 AND w >= 150 THEN n ELSE w + n END
  FROM (SELECT f.*, ps[i + 1] AS x, {space_words('ps[i + 1]')} AS n FROM f WHERE i < len(ps))),
e AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS l FROM f WHERE i = len(ps))
SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS chunk, unnest(l) AS body FROM e"""
)
def t16_paragraph_chunks(spark, d):
    return texts(spark, d).select("doc_id", F.posexplode(T.paragraph_chunks(F.col("text"))).alias("chunk", "body"))


@R.add(f"{P} SELECT pair_id, lower({collapse('ai')}) AS ai_form, lower({collapse('hu')}) AS hu_form FROM p")
def t17_normal_form(spark, d):
    return derived(spark, d, "pair_id", T.normal_form(F.col("ai")).alias("ai_form"), T.normal_form(F.col("hu")).alias("hu_form"))


_KEY = f"replace(replace(lower({strip('category')}), '-', '_'), ' ', '_')"
_NAMES = "('academic', 'document', 'email', 'essay', 'general', 'auto')"


@R.add(
    f"""WITH c AS (SELECT DISTINCT category AS raw, {_KEY} AS k FROM documents),
m AS (SELECT raw, CASE k WHEN 'academic_writing' THEN 'academic' WHEN 'report' THEN 'document' WHEN 'professional_email' THEN 'email' WHEN 'essay_writing' THEN 'essay' WHEN 'default' THEN 'auto' ELSE k END AS c FROM c)
SELECT raw, CASE WHEN c IN {_NAMES} THEN c ELSE 'auto' END AS category FROM m"""
)
def t18_category(spark, d):
    from tandemtext.sources.tables import table

    return table(spark, d, "documents").select(F.col("category").alias("raw")).distinct().select("raw", T.category_or(F.col("raw"), "auto").alias("category"))


@R.add(f"SELECT DISTINCT category AS raw, CASE WHEN lower({strip('category')}) IN {_NAMES} THEN lower({strip('category')}) ELSE 'general' END AS category FROM documents")
def t19_training_category(spark, d):
    from tandemtext.sources.tables import table

    return table(spark, d, "documents").select(F.col("category").alias("raw")).distinct().select("raw", T.training_category(F.col("raw")).alias("category"))


@R.add(f"SELECT DISTINCT human_source AS raw, replace(lower({strip('human_source')}), '_', '-') AS label FROM final_scored")
def t20_label(spark, d):
    from tandemtext.sources.tables import table

    return table(spark, d, "final_scored").select(F.col("human_source").alias("raw")).distinct().select("raw", T.label_dash(F.col("raw")).alias("label"))


_GUIDE = "CASE " + " ".join(f"WHEN category = '{k}' THEN {s(v)}" for k, v in T.GUIDES.items()) + f" ELSE {s(T.GUIDES['general'])} END"
_TARGET = f"round_even(0.85 * {space_words('ai')}, -1)::INTEGER"


@R.add(f"{P} SELECT pair_id, {s(T.SYSTEM_PROMPT)} AS system_content, {_GUIDE} || ' Aim for about ' || {_TARGET} || ' words.' || chr(10) || chr(10) || ai AS user_content FROM p")
def t21_messages(spark, d):
    target = F.bround(T.space_words(F.col("ai")).cast("decimal(20,4)") * F.lit("0.85").cast("decimal(4,2)"), -1).cast("int")
    m = derived(spark, d, "pair_id", T.messages(F.col("ai"), F.col("category"), target).alias("m"))
    return m.select("pair_id", F.col("m")[0]["content"].alias("system_content"), F.col("m")[1]["content"].alias("user_content"))


@R.add(f"{P} SELECT pair_id, 'Write between ' || floor({space_words('ai')} * 9 / 10.0)::BIGINT || ' and ' || floor({space_words('ai')} * 11 / 10.0)::BIGINT || ' words. ' || {_GUIDE} || chr(10) || chr(10) || ai AS prompt FROM p")
def t22_regeneration_prompt(spark, d):
    return derived(spark, d, "pair_id", T.regeneration_prompt(F.col("ai"), F.col("category"), T.space_words(F.col("ai"))).alias("prompt"))


@R.add(f"{P} SELECT pair_id, replace({_GUIDE} || ' {{text}}', '{{text}}', coalesce(hu, '')) AS prompt FROM p".replace("{{", "{").replace("}}", "}"))
def t23_template_prompt(spark, d):
    return derived(spark, d, "pair_id", T.filled("{task} {text}", task=T.guide(F.col("category")), text=F.coalesce("hu", F.lit(""))).alias("prompt"))


@R.add(f"{P} SELECT pair_id, 'ratio ' || printf('%.2f', round(ai_human_word_ratio::DECIMAL(18, 6), 2)::DOUBLE) AS reason FROM p WHERE ai_human_word_ratio IS NOT NULL")
def t24_reason(spark, d):
    r = pairs(spark, d).where("ai_human_word_ratio IS NOT NULL")
    return r.select("pair_id", F.format_string("ratio %.2f", F.round("ai_human_word_ratio", 2)).alias("reason"))


@R.add("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(replace(text, chr(10), ' '), 60) || '...' ELSE replace(text, chr(10), ' ') END AS snippet FROM documents")
def t25_snippet(spark, d):
    return texts(spark, d).select("doc_id", T.snippet(F.col("text"), 60).alias("snippet"))


@R.add(f"{P} SELECT pair_id, coalesce(ends_with(rtrim(ai), '...') OR ends_with(rtrim(ai), '…'), false) AS truncated FROM p")
def t26_truncated_source(spark, d):
    return derived(spark, d, "pair_id", T.truncated_source(F.col("ai")).alias("truncated"))


def _plain(c: str) -> str:
    return f"list_transform(list_filter(string_split({collapse(c)}, ' '), lambda x: x <> ''), lambda x: {sub('lower(x)', '[^a-z0-9]')})"


@R.add(f"{P} SELECT pair_id, list_sort(list_distinct(list_filter({_plain('hu')}, lambda x: length(x) > 2 AND NOT list_contains({_plain('ai')}, x)))) AS new_words FROM p")
def t27_new_words(spark, d):
    return derived(spark, d, "pair_id", T.new_words(F.col("ai"), F.col("hu")).alias("new_words"))


@R.add(f"SELECT doc_id, greatest(1, round({space_words('text')} / 200.0)::INTEGER) AS minutes FROM documents")
def t28_reading_minutes(spark, d):
    return texts(spark, d).select("doc_id", T.reading_minutes(F.col("text")).alias("minutes"))
