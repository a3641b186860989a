"""Broken prompt and answer pairs, one defect each.

Copies show in the length of the answer compressed with its prompt as zstandard dictionary; refusals and other languages in
dictionaries; answers that break off in the terminal-context model of :mod:`truncation`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.llm import truncation

#: An answer is a copy if, given its prompt, it compresses to less than this share of what it takes alone, and is at least
#: COPY_LENGTH as long; or if the prompt does, given the answer, and makes up more than FRAMED of it.  (Copies with slight
#: changes come to 0.10 and less; answers that take over every other sentence to 0.16 and more.)
COPY_RATE, COPY_LENGTH, FRAMED = 0.13, 0.6, 0.5
#: Bytes of a compressed frame that say nothing about the text.
FRAME_BYTES = 12
#: A task is declined in the first sentences; up to BRIEF words an answer says little else.
OPENING, BRIEF = 2, 70
#: Words that say cannot or will not, what is asked for, and the thing it is asked for.
CANNOT = r"(?:can ?not|can'?t|could not|couldn'?t|am not able to|'?m not able to|am unable to|'?m unable to|won'?t|will not|would not|wouldn'?t|must not|mustn'?t|may not|shouldn'?t|should not|have to decline|must decline|need to decline|decline to|decline|refuse to|do not feel comfortable|don'?t feel comfortable|am not comfortable|'?m not comfortable|am not allowed to|'?m not allowed to|am not permitted to|am only allowed to|'?m only allowed to)"
ASKED = r"(?:help(?! (?:but|\w+ing\b))|assist|do (?:that|this|so|it)|comply|rewrit|re-?word|rephras|paraphras|humani[sz]|summari[sz]|translat|answer|respond|process|fulfil|complete|continue|proceed|provid|produc|generat|creat|writ|discuss|engage|support|share|work on|offer)"
THING = r"(?:request|task|text|passage|content|prompt|question|query|material|instruction|topic|rewrite|version|input|one\b|that\b|this\b)"
#: Ways to decline a task in one sentence.
REFUSALS = (
    rf"\b(?:i|we)(?: must| do)? ?{CANNOT}\b.{{0,40}}?\b{ASKED}",
    rf"\b(?:i|we)(?: must| do)? ?{CANNOT} {THING}",
    r"\bas an? (?:ai|artificial|language model|large language)\b.*\b(?:not|can'?t|cannot|unable|decline)\b",
    rf"\b{ASKED}\w*\b.{{0,30}}\b(?:is|that'?s|'s) (?:not )?something (?:i'?m|i am|that i|i) (?:unable|not able|can'?t|cannot|won'?t)\b",
    r"\bsomething (?:that )?(?:i'?m|i am|i) (?:unable to|not able to|can'?t|cannot|won'?t) do\b",
    r"\b(?:request|task|query|prompt) (?:was |is |has been |must be )?(?:refused|declined|denied|rejected)\b",
    r"\b(?:can ?not|can'?t|could not|will not|won'?t) be (?:processed|rewritten|reworded|answered|completed|fulfilled|provided)\b",
    r"\b(?:request|task|text|passage|content|prompt|this|that|it)\b.{0,20}\b(?:goes|go|is|are) against\b.{0,30}\b(?:polic|guideline|rule|principle)|\bviolates?\b.{0,30}\b(?:polic|guideline)",
    r"\b(?:my|our|the) (?:guidelines|policy|policies|rules|instructions) (?:do not|don'?t|does not|doesn'?t) (?:let|allow|permit)\b|\b(?:guidelines|policy|policies|rules) (?:prevent|prohibit|forbid)",
    r"\b(?:unable to (?:do|help|assist|comply|process|rewrite|provide|fulfil|complete))\b",
    r"\bno (?:rewritten|reworded|new|such) (?:version|text|answer)\b.{0,20}\b(?:given|provided|possible)\b",
    r"\b(?:kann|darf|werde|möchte) ich\b.{0,60}\bnicht\b|\bich (?:kann|darf|werde|möchte)\b.{0,60}\bnicht\b|\bleider (?:ist es mir|kann|darf)\b|\bes ist mir nicht (?:möglich|erlaubt)\b|\bich muss .{0,30}ablehnen\b",
    r"\bje (?:ne (?:peux|puis|suis|pourrai|saurais)|refuse|dois refuser|dois décliner)\b|\bil m'est impossible\b",
    r"\b(?:no (?:puedo|podré|me es posible|estoy autorizad[oa])|me (?:niego|es imposible)|debo (?:rechazar|declinar))\b",
    r"\bnon (?:posso|sono in grado|mi è possibile)\b|\bnão (?:posso|consigo|me é possível)\b|\b(?:ik kan|ik mag|kan ik|mag ik|ik zal)\b.{0,60}\bniet\b",
    r"\bnie (?:mogę|jestem w stanie)\b|\b(?:jag kan|kan jag|jag får|jeg kan|kan jeg|jeg må) (?:tyvärr |desværre |dessverre )?(?:inte|ikke)\b|\ben (?:voi|pysty)\b|\b(?:nemohu|nemůžu|nem tudok|nem tudom|nu pot)\b|\b(?:yapamam|edemem|olamam|tidak dapat|tidak bisa)\b",
    r"не (?:могу|в состоянии|имею права)|не можу|δεν μπορώ|无法|不能|不便|無法|できません|できかねます|할 수 없습니다|드릴 수 없|لا (?:أستطيع|يمكنني|يمكن)|नहीं (?:कर|दे|लिख) सक|אינני יכול|לא יכול|ไม่สามารถ",
)
#: How a refusal may begin; in a brief answer this and a denial are enough.
REGRETS = r"^(?:sorry|apologies|unfortunately|regrettably|i'?m sorry|i am sorry|i'?m afraid|i am afraid|i apologi[sz]e|es tut mir leid|tut mir leid|leider|entschuldigung|je suis désolée?|désolée?|malheureusement|je regrette|lo siento|lamento|lamentablemente|mi dispiace|purtroppo|desculpe|sinto muito|infelizmente|het spijt me|helaas|przepraszam|niestety|tyvärr|desværre|dessverre|beklager|valitettavasti|bohužel|omlouvám|sajnos|îmi pare rău|üzgünüm|maalesef|maaf|извините|к сожалению|вибачте|на жаль|λυπάμαι|抱歉|很遗憾|对不起|申し訳|すみません|죄송|عذر|آسف|للأسف|क्षमा|माफ़|ขออภัย|מצטער)"
DENIALS = r"\b(?:not|cannot|can'?t|unable|only allowed|decline|won'?t|nicht|pas|peux|no|non|não|niet|nie|inte|ikke|en)\b|n't\b"
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be at from have has not they which their will we you our".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über wir ab mehr".split(),
    "fr": "le la les des et du une que est pour dans qui par sur pas plus ne au ce il sont avec aux ont cette nous vous leur à être mais ou où".split(),
    "es": "el los las y del que en un una por con para se no su al lo como más pero sus ya está han muy son sobre hay este esta fue".split(),
    "it": "il di che è un per non una sono della con gli alla nel dei più anche ha delle questo".split(),
    "pt": "o os que do da em um para é com não uma no na por mais dos como mas foi ao ele das".split(),
    "nl": "het van een en is dat op te zijn voor met niet aan er ook als bij naar maar om dan nog".split(),
}
#: The same of further languages; of these only words that none above has are used.
FURTHER_WORDS = {
    "pl": "się nie jest że dla przez ale jak czy może które który tego są był była będzie oraz także tylko przed po od".split(),
    "sv": "och att det är som för inte på av till har ett jag kan vi från var så hon eller".split(),
    "da": "og det er ikke på af til som har vi jeg fra kan skal blev efter være".split(),
    "fi": "ja on ei että se hän oli mutta kun tai ovat myös niin kuin tämä".split(),
    "cs": "je že není ale pro jako jsou byl který také při nebo aby bylo".split(),
    "hu": "az és hogy nem egy van volt meg csak ez már mint vagy kell".split(),
    "ro": "și este nu că pentru cu din care sunt mai fost sau la pe".split(),
    "tr": "ve bir bu için ile değil olarak daha çok gibi ama kadar sonra".split(),
    "id": "yang dan untuk dengan tidak ini itu dari adalah akan pada juga".split(),
}
#: Writing systems by their letters; a text is in the one that most of its letters have.
SCRIPTS = (("latin", r"A-Za-zÀ-ɏ"), ("cyrillic", r"Ѐ-ӿ"), ("greek", r"Ͱ-Ͽ"), ("arabic", r"؀-ۿ"), ("hebrew", r"֐-׿"), ("devanagari", r"ऀ-ॿ"), ("thai", r"฀-๿"), ("hangul", r"가-힯"), ("kana", r"぀-ヿ"), ("han", r"一-鿿"))

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _LANGUAGES[_w] = (*_LANGUAGES.get(_w, ()), _lang)
_KNOWN = frozenset(_LANGUAGES)
for _lang, _words in FURTHER_WORDS.items():
    for _w in _words:
        if _w not in _KNOWN:
            _LANGUAGES[_w] = (*_LANGUAGES.get(_w, ()), _lang)
_REFUSAL, _REGRET, _DENIAL = re.compile("|".join(REFUSALS)), re.compile(REGRETS), re.compile(DENIALS)
_OF_THING = re.compile(THING + r"|assist|comply|مساعد|помо|переп|改写|协助|手伝|도와|मदद|help with")
_LETTERS = [(name, re.compile(f"[{letters}]")) for name, letters in SCRIPTS]


def _hits(words: list[str]) -> dict[str, float]:
    """Function words by language; a word of several languages counts in part for each."""
    got: dict[str, float] = {}
    for w in words:
        if (langs := _LANGUAGES.get(w)) is not None:
            for lang in langs:
                got[lang] = got.get(lang, 0.0) + 1 / len(langs)
    return got


def language(words: list[str]) -> str | None:
    """The language with the most function words, if it has at least two."""
    hits = _hits(words)
    best = max(hits, key=lambda x: (hits[x], x), default=None)
    return best if best is not None and hits[best] >= 2 else None


def script(text: str) -> str | None:
    """The writing system of most letters; kana and han together are Japanese."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else None
    n = {name: len(letters.findall(text)) for name, letters in _LETTERS}
    if n["kana"] * 5 > n["han"]:
        n["kana"] += n["han"]
    best = max(n, key=lambda x: n[x])
    return best if n[best] else None


def is_refusal(answer: str, words: list[str]) -> bool:
    """Whether the first sentences decline the task; in a long answer they must name it."""
    low = re.sub(r"^\W*(?:note|hello|hi|hallo|bonjour|hola)\b\W*", "", answer.lower().replace("’", "'"))
    opening = [x for x in re.split(r"(?<=[.!?。！？])\s*|\n+", low, maxsplit=OPENING + 1) if x.strip()][:OPENING]
    for sentence in opening:
        if _REFUSAL.search(sentence) and (len(words) <= BRIEF or _OF_THING.search(sentence)):
            return True
        if len(words) <= BRIEF and (regret := _REGRET.match(sentence)) and (not sentence[: regret.end()].isascii() and script(sentence) != "latin" or _DENIAL.search(sentence)) and (_OF_THING.search(sentence) or len(words) <= BRIEF // 2):
            return True
    return False


def _size(text: bytes, given: bytes | None) -> int:
    import zstandard

    bare = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    known = {} if given is None else {"dict_data": zstandard.ZstdCompressionDict(given, dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
    return max(1, len(zstandard.ZstdCompressor(**known, **bare).compress(text)) - FRAME_BYTES)


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """Whether the answer says the prompt again: what it adds to the prompt, or to the prompt in a frame, is next to nothing."""
    if len(answer) < 8 or len(prompt) < 8:
        return bool(answer) and answer == prompt
    given, said = " ".join(prompt).encode(), " ".join(answer).encode()
    if len(said) < COPY_LENGTH * len(given):
        return False  # a few sentences of the prompt
    new = _size(said, given) / _size(said, None)
    if new < COPY_RATE:
        return True
    # A prompt that is most of the answer leaves little of it new.
    return len(given) > FRAMED * len(said) and new < 0.75 and _size(given, said) < COPY_RATE * _size(given, None)


def is_other_language(prompt: list[str], answer: str, words: list[str]) -> bool:
    """Whether most of the answer is written in another script, or its words stand in sentences of another language."""
    if not prompt or not words:
        return False
    own, other_script = script(" ".join(prompt)), script(answer)
    if own is not None and other_script is not None and own != other_script:
        return True
    asked = language(prompt)
    if asked is None:
        return False
    hits = _hits(words)
    total = sum(hits.values())
    if total < 3 or hits.get(asked, 0.0) >= 0.8 * total:
        return False
    same = other = 0
    for sentence in re.split(r"[.!?\n]+", answer.lower()):
        part = _WORD.findall(sentence)
        found = _hits(part)
        if not found:
            continue
        best = max(found.values())
        if found.get(asked, 0.0) >= best:
            same += len(part)
        else:
            other += len(part)
    return other > same


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = []
        for prompt, answer in zip(batch.column("prompt").to_pylist(), batch.column("answer").to_pylist()):
            words, given = _WORD.findall(answer.lower()), _WORD.findall((prompt or "").lower())
            labels.append("refusal" if is_refusal(answer, words) else "copied" if is_copy(given, words) else "other_language" if is_other_language(given, answer, words) else None)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(labels, pa.string())], ["key", "defect"])


def defects(df: DataFrame, key: str, prompt: str, answer: str) -> DataFrame:
    """(key, defect) of every defective pair; the first of empty, refusal, copied, other_language, truncated that holds.

    A null or blank prompt can be neither copied nor tell a language.  A key met twice counts once; rows with a null key are
    left out.  An empty table gives an empty result.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(answer).alias("answer"))
    kind = rows.schema["key"].dataType.simpleString()
    cut = truncation.cut_texts(rows.select("key", F.col("answer").alias("text")))
    by_end = cut.groupBy("key").agg(F.bool_or(F.col("state") == "blank").alias("empty"), F.bool_or("cut").alias("cut"))
    labelled = rows.where(F.length(F.trim("answer")) > 0).mapInArrow(_label, f"key {kind}, defect string")
    labelled = labelled.where("defect IS NOT NULL").groupBy("key").agg(F.max("defect").alias("defect"))
    joined = by_end.join(labelled, "key", "left")
    return joined.select(F.col("key").alias(key), F.when(F.col("empty"), "empty").when(F.col("defect").isNotNull(), F.col("defect")).when(F.col("cut"), "truncated").alias("defect")).where("defect IS NOT NULL")
