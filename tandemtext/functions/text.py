"""Scalar text functions as column expressions.

Patterns spell out Unicode classes, so they mean the same to any regular-expression engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, word characters, words with inner hyphens and apostrophes.
WS = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_WS = WS.replace("[", "[^", 1)
#: A run of anything but white space, printable ASCII first: three times as fast as the plain class.
NOT_WS_RUN = rf"[!-~]++(?:{NOT_WS}+)?|{NOT_WS}+"
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = rf"{WORD_CHAR}(?:[\p{{L}}\p{{N}}_’'-]*{WORD_CHAR})?"
# Characters that normalisation removes, and glyphs that it turns into blanks.
INVISIBLE_CHARS = "".join(map(chr, [0xFFFD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0xAD, *range(0x01, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))
BOX_CHARS = "\u25a0\u25a1\u25aa\u25ab\u25cf\u25cb\u2022\u00b7"
INVISIBLE = r"[\x{FFFD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{AD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BOXES = r"[\x{25A0}\x{25A1}\x{25AA}\x{25AB}\x{25CF}\x{25CB}\x{2022}\x{00B7}]"
# Entities that normalisation decodes, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))
TITLE_LINE = r"^(?:[^\n]{0,80}[ \t](?:Essay|Research Paper|Report)|(?:Title|Subject)[ \t]*:[^\n]*)\n+"
TRAILING_REFERENCES = r"\n[ \t\n]*(?:Works Cited|References|Bibliography)(?s:.)*\z"
CITATION = r"\([A-Z][^)]*[0-9]{4}\)"
CATEGORIES = ("academic", "document", "email", "essay", "general")
# Other names of categories; what is still unknown after them is ``auto``.
ALIASES = {"academic_writing": "academic", "report": "document", "professional_email": "email", "essay_writing": "essay", "default": "auto"}
# Instructions that prompts are made of.
SYSTEM_PROMPT = "Rewrite the text so that it reads as if a person wrote it. Keep every fact."
GUIDES = {"academic": "Keep the formal register.", "document": "Keep the structure.", "email": "Keep greeting and closing.", "essay": "Keep the argument.", "general": "Keep the tone."}


def lit(s: str) -> Column:
    return F.lit(s)


def strip(c: Column) -> Column:
    return F.btrim(c, lit(WS_CHARS))


def bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it many times; an expression named twice is otherwise evaluated twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(c: Column) -> Column:
    """White space to single blanks, none at the ends; null to the empty string."""
    return F.coalesce(F.regexp_replace(strip(c), rf"{WS}+", " "), lit(""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), lit(WORD), lit(0))


def word_count(c: Column) -> Column:
    """Tokens; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(c, lit(WORD)), lit(0))


def space_words(c: Column) -> Column:
    """Runs between white space; null and blank texts have 0."""
    return F.coalesce(F.regexp_count(c, lit(NOT_WS_RUN)), lit(0))


def char_count(c: Column) -> Column:
    return F.coalesce(F.char_length(c), lit(0))


def normalize(c: Column) -> Column:
    """Decode entities, drop tags and invisible characters, tidy white space; null stays null."""
    for entity, plain in ENTITIES:
        c = F.replace(c, lit(entity), lit(plain))
    c = F.regexp_replace(c, r"<[bB][rR] */?>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.translate(c, BOX_CHARS + INVISIBLE_CHARS, " " * len(BOX_CHARS))
    c = F.regexp_replace(c, r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def tidy_lines(c: Column) -> Column:
    """No blanks at the ends of lines, at most one empty line in a row; null to the empty string."""
    c = F.regexp_replace(F.coalesce(c, lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def unquote(c: Column) -> Column:
    return F.when(c.startswith('"') & c.endswith('"') & (F.char_length(c) > 1), F.regexp_replace(c, r'^"|"$', "")).otherwise(c)


# What a model says before and after its answer.
LEAD_IN = r"(?i)^\s*(?:\*\*|##)?\s*(?:here(?:'s| is) (?:the |a )?(?:rewritten|revised|formal|ai-style|modified)?\s*(?:text|version|passage|essay|email|report|document)?[:\-]?\s*(?:\*\*|##)?)\s*"
HEADING = r"(?i)^\s*(?:\*\*|##)?\s*(?:rewritten|revised|aiified)\s*(?:text|version|passage)?[:\-]?\s*(?:\*\*|##)?\s*"
OFFER = r"(?i)\n+(?:let me know if|i hope this helps|hope this helps|feel free to ask)[^\n]*\z"


def model_output(c: Column) -> Column:
    """Without reasoning blocks, lead-ins, an offer in the last line and quotes around it all."""
    c = strip(F.regexp_replace(c, r"(?is)<(?:think|thought)>.*?</(?:think|thought)>", ""))
    c = F.regexp_replace(F.regexp_replace(c, LEAD_IN, ""), HEADING, "")
    c = strip(F.regexp_replace(c, OFFER, ""))
    return strip(F.regexp_replace(F.regexp_replace(c, r'(?s)^"(.*)"\z', "$1"), r"(?s)^'(.*)'\z", "$1"))


def after_thinking(c: Column) -> Column:
    return unquote(strip(F.element_at(F.split(c, "</think>"), -1)))


def strip_artifacts(c: Column) -> Column:
    """Without title line, reference list and citations."""
    c = F.regexp_replace(strip(c), TITLE_LINE, "")
    c = F.regexp_replace(c, TRAILING_REFERENCES, "")
    c = F.regexp_replace(c, CITATION, "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


SENTENCE_TAIL = r"^((?s:.)*[.!?][\"“”‘’')]?)(?:[ \t\n\r](?s:.)*)?\z"
UNCLOSED = r"[ \t\n]*[(\[][^)\]]*\z"


def repair(c: Column, category: Column) -> Column:
    """Repair what broken sources leave: lost apostrophes, forwarded mails, bibliographies, half sentences at either end.

    A text without a whole sentence becomes empty.
    """
    c = F.regexp_replace(c, r"([A-Za-z])\?(t|s|re|ve|ll|d|m)\b", "$1'$2")
    mail = F.regexp_replace(c, r"\n-+ ?(?:Forwarded|Original) (?:by|Message|message)(?s:.)*\z", "")
    mail = F.regexp_replace(mail, r"(?m)^(?:From|To|Cc|Sent|Subject):[^\n]*\n", "")
    c = F.when(category == "email", mail).otherwise(c)
    c = F.regexp_replace(c, r"\n[ \t]*(?:References|Works Cited|Bibliography|Sources)[ \t]*:?[ \t]*\n(?s:.)*\z", "")
    site = F.regexp_replace(c, r"\([A-Za-z0-9-]+\.(?:com|org|net)[^)]*\)", "")
    c = F.when(category.isin("essay", "general"), site).otherwise(c)
    opener = F.regexp_extract(c, r"(?:[.!?][ \t\n]+|\n[ \t]*)([A-Z0-9\"“][^.!?]*[.!?](?s:.)*)\z", 1)
    c = F.when(F.rlike(c, lit(r"^[a-z]")), opener).otherwise(c)
    c = F.regexp_replace(c, UNCLOSED, "")
    c = F.regexp_replace(c, r"[ \t](?:et al|e\.g|i\.e|vs|cf)\.?\z", "")
    return strip(F.regexp_extract(c, SENTENCE_TAIL, 1))


def humanized_output(gen: Column, source: Column) -> Column:
    """Without a short title line that the source does not have."""
    first = F.regexp_extract(gen, r"^([^\n]*)", 1)
    is_title = (space_words(first) <= 10) & F.rlike(F.lower(first), lit(r"^title:|(?:essay|research paper|paper|report)[ \t]*\z")) & ~F.contains(F.lower(source), F.lower(first)) & F.contains(gen, lit("\n"))
    return F.when(is_title, strip(F.regexp_replace(gen, r"^[^\n]*\n", ""))).otherwise(strip(gen))


def sentences(c: Column) -> Column:
    """Split after . ! ? before white space and a capital, digit or quote; null gives no sentences."""
    parts = F.split(F.regexp_replace(F.coalesce(c, lit("")), rf"([.!?]){WS}+([A-Z0-9\"'])", "$1\x01$2"), "\x01")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def chunks(c: Column, size: int, least: int) -> Column:
    """Windows of ``size`` words in order; one below ``least`` words is left out."""
    w = F.filter(F.split(collapse(c), " "), lambda x: x != "")
    n = F.size(w)
    parts = F.transform(F.sequence(lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, lit(0))), lambda i: F.slice(w, i * size + 1, lit(size)))
    return F.transform(F.filter(parts, lambda x: F.size(x) >= least), lambda x: F.array_join(x, " "))


def paragraph_chunks(c: Column, most: int = 300, least: int = 150) -> Column:
    """Fold paragraphs into chunks, closing one when the next would take it over ``most`` and it has ``least`` words."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(c, lit("")), r"\n[ \t]*\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), lit("").alias("cur"), lit(0).alias("w"))

    def step(acc: Column, p: Column) -> Column:
        n = space_words(p)
        close = (acc["w"] + n > most) & (acc["w"] >= least)
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], lit("\n\n"), p))
        return F.struct(
            F.when(close, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]).alias("out"),
            F.when(close, p).otherwise(joined).alias("cur"),
            F.when(close, n).otherwise(acc["w"] + n).alias("w"),
        )

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["cur"] != "", F.array_append(a["out"], a["cur"])).otherwise(a["out"]))


def normal_form(c: Column) -> Column:
    return F.lower(collapse(c))


def category_or(c: Column, default: str) -> Column:
    """Canonical category: separators to ``_``, aliases resolved; others become ``default``."""
    k = F.translate(F.lower(strip(c)), "- ", "__")
    out = k
    for alias, name in ALIASES.items():
        out = F.when(k == alias, name).otherwise(out)
    return F.when(out.isin(*CATEGORIES, "auto"), out).otherwise(default)


def training_category(c: Column) -> Column:
    """Canonical category of a training row: no aliases, only case and outer white space; others become general."""
    k = F.lower(strip(c))
    return F.when(k.isin(*CATEGORIES, "auto"), k).otherwise("general")


def label_dash(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), lit("_"), lit("-"))


def guide(category: Column, guides: dict[str, str] | None = None, default: str = "general") -> Column:
    """The instruction of a category; ``guides`` gives the caller's own, ``default`` names the one of other categories."""
    guides = guides or GUIDES
    out = lit(guides[default])
    for name, text in guides.items():
        out = F.when(category == name, text).otherwise(out)
    return out


#: The user's part of a message; {style}, {target}, {task} and {text} are filled in.
USER_TEMPLATE = "{task} Aim for about {target} words.\n\n{text}"
REGENERATION_TEMPLATE = "Write between {low} and {high} words. {task}\n\n{text}"


def filled(template: str, **parts: Column) -> Column:
    """A template with its {names} replaced; what replaces one is not looked into again."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest), default=None)
        if at is None:
            out.append(lit(rest))
            break
        out += [lit(rest[: at[0]])] * (at[0] > 0) + [parts[at[1]].cast("string")]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out)


def messages(text: Column, category: Column, target: Column, system: str = SYSTEM_PROMPT, template: str = USER_TEMPLATE, guides: dict[str, str] | None = None, default: str = "general") -> Column:
    """System and user message of a training example; prompts are the caller's, the defaults are short ones."""
    user = filled(template, style=category, target=target, task=guide(category, guides, default), text=text)
    part = lambda role, content: F.struct(lit(role).alias("role"), content.alias("content"))
    return F.array(part("system", lit(system)), part("user", user))


def regeneration_prompt(text: Column, category: Column, count: Column, template: str = REGENERATION_TEMPLATE, guides: dict[str, str] | None = None, default: str = "general") -> Column:
    """A prompt that asks for nine to eleven tenths of ``count`` words."""
    low, high = F.floor(count * 9 / 10), F.floor(count * 11 / 10)
    return filled(template, low=low, high=high, count=count, task=guide(category, guides, default), text=text)


def snippet(c: Column, n: int) -> Column:
    flat = F.replace(c, lit("\n"), lit(" "))
    return F.when(F.char_length(flat) > n, F.concat(F.left(flat, lit(n)), lit("..."))).otherwise(flat)


def truncated_source(c: Column) -> Column:
    t = F.rtrim(c)
    return F.coalesce(t.endswith("...") | t.endswith("…"), lit(False))


def new_words(a: Column, b: Column) -> Column:
    """Words of b of more than two characters whose lower-case letters and digits do not occur in a."""
    plain = lambda c: F.transform(F.filter(F.split(collapse(c), " "), lambda x: x != ""), lambda w: F.regexp_replace(F.lower(w), r"[^a-z0-9]", ""))
    return F.array_sort(F.filter(F.array_except(plain(b), plain(a)), lambda w: F.char_length(w) > 2))


def reading_minutes(c: Column) -> Column:
    return F.greatest(lit(1), F.round(space_words(c) / 200).cast("int"))
