"""Personal information in free text: found, and replaced by typed placeholders.

Patterns propose spans; checksums confirm or weaken those that have them; words near a span raise or lower its score.  A span
counts from ``ACCEPT`` on.  A card or account number counts only with the right checksum; a national number without it only
next to words that speak for it.  A name is a run of capitalised words whose score comes from known given names, from titles,
roles and naming words before it, and from what persons do after it; words of places and organisations speak against it.
Each text is handled by itself in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.6
#: Characters before a span in which words count as its context.
CONTEXT = 80
TYPES = ("email", "id_number", "phone", "address", "name")

# Given names, by which a full name is told from a place or an organisation.
GIVEN = frozenset(
    """adam adrian agnes albert alice amelie ana andre andrea anna anne anton antonio arthur astrid barbara beatriz bernard bruno
    camille carla carlos carmen caroline cecilia charles charlotte chloe christian clara claire daniel david diego dominik edith
    eduardo elena elias elisabeth emil emily emma erik eva felix fernando florence francisco frank frida gabriel george grace greta
    hanna hannah hans heinz helen helena henri henrik hugo ida ines ingrid irene isabel isabelle jakob jan javier jean johan john
    jonas jorge jose joseph juan judith julia julie karin karl katharina kevin klara laura lena leo leon linda lisa louis louise
    lucas lucia lukas manuel marco maria marie mario marta martin mary mateo max michael miguel miriam monika nadia nicolas nina
    noah nora olga oliver oscar oskar pablo pascal patricia paul paula pedro peter philip pierre rafael raquel rebecca renata
    richard robert rosa ruth samuel sandra sara sarah sebastian simon sofia sonja sophie stefan susanne sven teresa theo thomas
    tomas ursula valentin vera victor victoria walter werner yvonne""".split()
)
# Words after a given name that make it a place or an organisation.
PLACES = frozenset(
    """bay bridge brook court cross farm ferry field fields forest garden gardens gate green grove hall harbour heath hill hollow house
    island lake library lodge mill moor park point port quay ridge river road sands shore square station street valley view village
    wood woods college institute foundation council trust clinic school university church centre center museum society association
    authority board union group office service cooperative january february march april may june july august september october
    november december monday tuesday wednesday thursday friday saturday sunday""".split()
)
# Words right before a name that give one, stand for a person, or lead to a person; the last also to other things.
NAMING = frozenset("named called contact attn attention dear heiße heißt llamo llama appelle nommé nommée chiamo ansprechpartner ansprechpartnerin kontakt contacto signed author".split())
NAMING_PAIRS = frozenset(("name is", "names are", "name ist", "nombre es", "nom est", "this is", "i am", "signed by", "written by", "yours sincerely"))
ROLES = frozenset(
    """applicant tenant respondent claimant defendant plaintiff witness patient client customer employee manager director teacher nurse
    doctor editor chair chairman chairwoman secretary treasurer officer colleague friend neighbour neighbor landlord mieter mieterin
    antragsteller antragstellerin kollege kollegin kunde kundin patientin leiter leiterin locataire demandeur demandeuse patiente collègue
    inquilino inquilina solicitante cliente paciente colega señor señora madame monsieur herr frau mr mrs ms miss dr prof""".split()
)
TITLES = frozenset("dr prof mr mrs ms sr sra mme mlle st".split())
# Words that begin or end capitalised phrases which are no names.
NO_NAMES = frozenset("""the this that these those it we you they he she i a an in on at for with from of and or my our your their his her if when please kind best many der die das le la les el los las un une una ein eine
    desk front team staff crew department hiring training programme program support sales committee steering help customer human resources
    project report policy plan system data abteilung vorstand verein büro équipe service équipes equipo oficina""".split())
LEADING = frozenset(("thanks to", "again to", "thank you", "we met", "i met", "can reach", "may reach", "forms to", "papers to", "letter to", "letters to", "speak to", "talk to", "write to", "sich an", "merci à", "gracias a", "danke an", "dank an", "contactar con", "hablar con", "pouvez joindre", "contacter avec", "rückfragen nimmt", "nummer von", "number of", "ausweisnummer von", "identité de", "identidad de", "identity of"))
# What follows the name of a person.
AFTER_PERSON = re.compile(r"\s*,?\s*(?:\(ID\b|(?:gave|said|says|wrote|writes|lives|asked|signed|collected|told|agreed|thanked|joined|phoned|rang|explained|replied|who|whose|wohnt|schrieb|schreibt|sagte|unter|entgegen|vive|dijo|escribió|par|por|pour)\b|can be reached|est joignable|(?:\r?\n)+\s*(?:tel|phone|mail|e-mail|mobile)\b)", re.I)
TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Sra?|Señora?|Don|Doña|Madame|Monsieur)\b\.?\s+)*"
PARTICLE = r"(?:(?:von|van|de|del|della|di|da|zu|la|le|der|den|ter|VON|VAN|DE|DEL|DI|DA|ZU)\s+){0,2}"
FAMILY = r"[A-ZÀ-Þ][^\W\d_]+(?:['’-][A-ZÀ-Þ]?[^\W\d_]+)*"
GAP = r"(?:[ \t]+(?:\r?\n)?|\r?\n)[ \t]*"

# Words before a number or name that speak for a kind, or against any personal number.
FOR_PHONE = re.compile(r"(?i)\b(?:tel|tél|phone|call|text me|number is|mobile|mobil|fax|whatsapp|or on|reach|joindre|au|llame|teléfono|en el|unter|oder|erreichbar|rufen|anrufen|contact|dial|ring)\b[^\n]{0,25}$")
FOR_ID = re.compile(r"(?i)(?:\bID\b|identi|social security|\bssn\b|insurance|ausweis|personalausweis|steuer|sécurité sociale|\bdni\b|\bnie\b|documento|passport|passeport|pasaporte|tax)[^\n]{0,60}$")
AGAINST = re.compile(r"(?i)\b(?:lot|order|ref|reference|doi|isbn|issn|invoice|ticket|serial|case|article|version|batch|part|model|section|rechnung|bestell\w*|commande|facture|pedido|factura)\b[^\n.!?]{0,16}$")
FOR_ADDRESS = re.compile(r"(?i)(?:anschrift|adresse|address|wohnt|lives|home|drop by|parcel|envoyer|dirección|domicilio)[^\n]{0,20}$")

_EMAIL = re.compile(
    r"[\w.%+-]*\w(?:\s?@\s?|\s*[\[({]\s*(?:at|ät|a|@)\s*[\])}]\s*)\w[\w-]*(?:(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto|\.)\s*[\])}]\s*)\w[\w-]*)*(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto|\.)\s*[\])}]\s*)[^\W\d_]{2,}(?![\w-])"
    r"|\w[\w.%+-]*\s+(?:at|arroba|arobase)\s+\w[\w-]*(?:\s+(?:dot|punto|point|punkt)\s+\w[\w-]*)*\s+(?:dot|punto|point|punkt)\s+[^\W\d_]{2,}(?![\w-])",
    re.I,
)
_DIGITS = re.compile(r"(?<![\w@])(?:\+|\()?\d[\d \t().\-/‑–]{6,24}\d(?![\w@])")
_SSN = re.compile(r"\d{3}([ -])\d{2}\1\d{4}")
_NIR = re.compile(r"\d ?\d{2} ?\d{2} ?\d[\dABab] ?\d{3} ?\d{3}(?: ?\d{2})?")
_LETTERED = re.compile(r"(?<![\w-])(?:[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|[A-Za-z]\d{8,9}[A-Za-z]?|\d{8}[ -]?[A-Za-z]|[XYZxyz][ -]?\d{7}[ -]?[A-Za-z])(?![\w])")
_US = re.compile(r"(?:(?:\+|00)?1[ .‑-]?)?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}[ .‑-]?)\d{3}[ .‑-]?\d{4}")
_ABROAD = re.compile(r"(?:\+|00)[1-9]\d{0,2}[ ./‑-]?(?:\(0\)[ ]?)?\d[\d ./()‑-]{5,14}\d")
_TRUNK = re.compile(r"\(?0[1-9]\d{0,3}\)?(?:[ ./‑-]?\d{2,5}){2,5}")
_NINE = re.compile(r"[6-9]\d{2}[ .‑-]?\d{3}[ .‑-]?\d{3}|[6-9]\d{2}(?:[ .‑-]?\d{2}){3}")
_CAP = r"[A-ZÀ-Þ][\w'’-]*"
_HOUSE = re.compile(r"(?<![\w.,/-])\d{1,4}(?:\s?[A-Za-z])?(?!\w)")
_NUMBER_FIRST = re.compile(
    rf"\s+(?:{_CAP}\s+){{1,3}}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Drive|Dr|Crescent|Cres|Court|Ct|Way|Place|Square|Sq|Terrace|Grove|Row|Walk|Mews|Boulevard|Blvd|Parade|STREET|ST|ROAD|RD|LANE|AVENUE|AVE|CLOSE|DRIVE|CRESCENT|COURT|WAY|PLACE|SQUARE|TERRACE|GROVE)\b(?!\w)"
    rf"|(?:\s+(?:bis|ter|quater))?,?\s+(?i:rue|avenue|av\.|bd\.?|boulevard|place|chemin|impasse|quai|allée|cours|route)\s+(?:(?i:de la|de l['’]|du|des|de|d['’])\s*)?{_CAP}(?:[ -]{_CAP})*"
)
_NUMBER_LAST = re.compile(
    rf"(?:\b(?:{_CAP}[ -])?[A-ZÀ-Þ][^\W\d_]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|ring|damm|STRASSE|STRAßE|STR\.|WEG|GASSE|PLATZ)\s+"
    rf"|\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|AM|IM|ZUM)\s+{_CAP}\s+"
    rf"|(?<![\w])(?i:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|ronda)\s*(?:(?i:de la|de los|de las|del|de)\s+)?{_CAP}(?:\s+{_CAP}){{0,2}},?\s+(?:n[º°]\.?\s*)?)\Z"
)
_BESIDE_POSTCODE = re.compile(r",?\s+\d{4,5}\b")
_CAPITAL = re.compile(r"(?<![^\W_])[A-ZÀ-Þ][^\W\d_]+")
_AFTER_GIVEN = re.compile(rf"(?:{GAP}(?!(?:[A-Z]\.)?\Z)[A-ZÀ-Þ]\.)*{GAP}{PARTICLE}({FAMILY})")
_INITIALS = re.compile(rf"(?:{GAP}[A-ZÀ-Þ]\.)*")
_FAMILY_FIRST = re.compile(rf"(?:(?<=\s)|^)({PARTICLE})({FAMILY}),{GAP}\Z")
_PREPOSITION = re.compile(r"(?i)(?:identidad|identité|nummer|gracias|merci)\s+\Z")
_NO_PERSON = re.compile(r"(?i)\b(?:saint|st\.?|san|santa|sankt|project|the)\s+\Z")
_PLACE_NEXT = re.compile(rf"{GAP}(?:{'|'.join(sorted(w.capitalize() for w in PLACES))})\b")
_GIVEN_FORMS = frozenset(f(w) for w in GIVEN for f in (str.capitalize, str.upper))
_SIX_DIGITS = re.compile(r"\d\d ?\d\d ?\d\d")
#: Shapes of a name that no given name vouches for; a comma only where the family name stands first.
_SHAPE = re.compile(rf"(?!(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Sra?|Señora?|Don|Doña|Madame|Monsieur)\b)({FAMILY}(?:{GAP}[A-ZÀ-Þ]\.)*{GAP}{PARTICLE}{FAMILY}(?![\w])|{PARTICLE}{FAMILY},{GAP}{FAMILY}(?:{GAP}[A-ZÀ-Þ]\.)*(?![\w]))")
_LETTERS = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")
_LEADING_PARTICLE = re.compile(r"(?:(?<=\s)|^)(?:von|van|de|del|della|di|da|zu|la|le|der|den|ter)\s+(?:(?:der|den|la|los)\s+)?\Z", re.I)
_PARTICLES = frozenset("von van de del della di da zu la le der den ter los".split())
_SPEAKING = NAMING | ROLES | {p.rpartition(" ")[2] for p in NAMING_PAIRS} | {p.rpartition(" ")[2] for p in LEADING}
_CARD = re.compile(r"[3-6]\d{3}(?:([ -]?)\d{4}\1\d{4}\1\d{1,7}|([ -]?)\d{6}\2\d{5})")
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IBAN_HEAD = re.compile(r"[A-Z]{2}\d\d ?[A-Z0-9]{4}")
_INVISIBLE = re.compile("[​‌‍⁠﻿­‎‏]")


def mod97(nir: str) -> bool:
    """Whether the two last digits are 97 less the rest modulo 97 (with 2A and 2B as 19 and 18)."""
    body = nir[:-2].upper().replace("2A", "19").replace("2B", "18")
    return body.isdigit() and int(nir[-2:]) == 97 - int(body) % 97


def iban97(code: str) -> bool:
    """Whether the account number, its first four characters moved to the end, is 1 modulo 97 (letters from A = 10)."""
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def letter23(number: str) -> bool:
    """Whether the last letter is the one the number modulo 23 asks for."""
    body = number[:-1].upper().translate(str.maketrans("XYZ", "012"))
    return body.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23] == number[-1].upper()


def weighted731(code: str) -> bool:
    """Whether the last digit is the sum of the others weighted 7, 3, 1 (letters from A = 10) modulo 10."""
    return code[-1].isdigit() and sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(code[:-1])) % 10 == int(code[-1])


def _score_number(span: str, before: str) -> tuple[str, float] | None:
    """The kind of a run of digits and its score."""
    digits = re.sub(r"\D", "", span)
    against = 0.8 if AGAINST.search(before) else 0.0
    cue_id, cue_phone = FOR_ID.search(before) is not None, FOR_PHONE.search(before) is not None
    if _SSN.fullmatch(span):
        return "id_number", 0.7 + 0.3 * cue_id - against
    if _CARD.fullmatch(span) and luhn(digits):
        return "id_number", 0.8 - against
    if len(digits) in (13, 15) and _NIR.fullmatch(span) and (span[0] in "1234789"):
        return "id_number", 0.4 + 0.4 * (len(digits) == 15 and mod97(digits)) + 0.5 * cue_id - against
    if cue_id and not cue_phone and 8 <= len(digits) <= 12 and not re.search(r"[+(/]", span):
        # A number of no known kind: its checksum decides unless the words for it stand close by.
        return "id_number", 0.45 + 0.2 * luhn(digits) + 0.2 * (FOR_ID.search(before[-30:]) is not None) - against
    if _ABROAD.fullmatch(span) and 9 <= len(digits) <= 15:
        return "phone", 0.8 + 0.2 * cue_phone - against
    parted = re.search(r"[ ().-]", span) is not None
    if _US.fullmatch(span):
        return "phone", (0.7 if parted else 0.35) + 0.3 * cue_phone - against
    if _TRUNK.fullmatch(span) and 9 <= len(digits) <= 12:
        return "phone", (0.6 if parted else 0.45) + 0.3 * cue_phone - against
    if _NINE.fullmatch(span):
        return "phone", (0.5 if parted else 0.35) + 0.3 * cue_phone - against
    return None


def _lettered_score(span: str, before: str) -> float:
    code = re.sub(r"[ -]", "", span)
    cue, against = FOR_ID.search(before) is not None, AGAINST.search(before) is not None
    if re.fullmatch(r"[A-Za-z]{2}\d{6}[A-Da-d]", code):
        score = 0.7
    elif re.fullmatch(r"[A-Za-z]\d{8,9}[A-Za-z]?", code):
        score = 0.2 + 0.4 * weighted731(code.rstrip("Dd").upper())
    else:
        score = 0.2 + 0.4 * letter23(code)
    return score + 0.5 * cue - 0.8 * against


def _numbers(text: str) -> list[tuple[float, int, int, str]]:
    got = []
    for m in _LETTERED.finditer(text) if _SIX_DIGITS.search(text) else ():
        if (score := _lettered_score(m.group(), text[max(0, m.start() - CONTEXT) : m.start()])) >= ACCEPT:
            got.append((score, m.start(), m.end(), "id_number"))
    for m in _IBAN.finditer(text) if _IBAN_HEAD.search(text) else ():
        if iban97(m.group()) and not AGAINST.search(text[max(0, m.start() - CONTEXT) : m.start()]):
            got.append((0.9, m.start(), m.end(), "id_number"))
    for m in _DIGITS.finditer(text):
        # A bracket that closes nothing, or a full stop and what follows, is not part of the number.
        start, span = m.start(), m.group()
        tries = [span]
        if ")" in span and "(" not in span:
            tries = [span[: span.index(")")]]
        elif "(" in span and ")" not in span:
            tries = [span[: span.index("(")]]
        for sep in (". ", " (", ") (", "  ", " - "):
            if sep in span:
                tries.append(span.split(sep)[0])
        for t in tries:
            t = t.rstrip(" .-/(\t")
            if (kind := _score_number(t.strip(), text[max(0, start - CONTEXT) : start])) and kind[1] >= ACCEPT:
                got.append((kind[1], start, start + len(t), kind[0]))
                break
    return got


def _addresses(text: str) -> list[tuple[float, int, int, str]]:
    got = []
    for m in _HOUSE.finditer(text):
        if after := _NUMBER_FIRST.match(text, m.end()):
            got.append((0.7, m.start(), after.end(), "address"))
            continue
        low = max(0, m.start() - CONTEXT)
        if not text[m.start() - 1 : m.start()].isspace() or not (street := _NUMBER_LAST.search(text[low : m.start()])):
            continue
        start, score = low + street.start(), 0.7
        if re.match(r"(?i)(?:am|an|im|in|zum|zur|auf|unter|hinter)\b", street.group()):
            score = 0.3 + 0.3 * (FOR_ADDRESS.search(text[max(0, start - CONTEXT) : start]) is not None) + 0.3 * (_BESIDE_POSTCODE.match(text, m.end()) is not None)
        if score >= ACCEPT:
            got.append((score, start, m.end(), "address"))
    return got


def _is_family(word: str) -> bool:
    return len(word) > 1 and word.lower() not in PLACES


def _names(text: str) -> list[tuple[float, int, int, str]]:
    got, done = [], 0
    for m in _CAPITAL.finditer(text):
        if m.group() not in _GIVEN_FORMS:
            if m.start() >= done and (other := _unlisted(text, m.start())):
                got.append(other)
                done = other[2]
            continue
        before = text[max(0, m.start() - CONTEXT) : m.start()]
        if _NO_PERSON.search(before):
            continue
        if after := _AFTER_GIVEN.match(text, m.end()):
            last = after.group(1)
            if _is_family(last) and (m.group().isupper() or not last.isupper()) and not _PLACE_NEXT.match(text, after.end()):
                got.append((0.9, m.start(), after.end(), "name"))
            # A given name before a capital that is no family is part of a place or an organisation.
            continue
        if (first := _FAMILY_FIRST.search(before)) and _is_family(first.group(2)):
            start = m.start() - (len(before) - first.start(1))
            particle = first.group(1)
            if particle and _PREPOSITION.search(before[: first.start(1)]):
                start = m.start() - (len(before) - first.start(2))
            got.append((0.8, start, _INITIALS.match(text, m.end()).end(), "name"))
    return got


def _last(bare: str) -> str:
    return bare[max(bare.rfind(" "), bare.rfind("\n")) + 1 :].strip("([\"“„").lower()


def _unlisted(text: str, start: int) -> tuple[float, int, int, str] | None:
    """A name that begins with a capitalised word no given name vouches for, by its shape and the words around it."""
    # Without a word before it that speaks for a name no other score is enough.
    bare = text[max(0, start - 40) : start].rstrip(" \t\r\n:,")
    last = _last(bare)
    if last in _PARTICLES and (lead := _LEADING_PARTICLE.search(text[max(0, start - 40) : start])):
        start = max(0, start - 40) + lead.start()
        bare = text[max(0, start - 40) : start].rstrip(" \t\r\n:,")
        last = _last(bare)
    if last not in _SPEAKING and not (last[-1:] == "." and last[:-1] in TITLES):
        return None
    m = _SHAPE.match(text, start)
    if not m:
        return None
    words = [w.lower() for w in _LETTERS.findall(m.group())]
    if any(w in PLACES or w in NO_NAMES or w in ROLES for w in words) or _PLACE_NEXT.match(text, m.end()):
        return None
    # Between capitals, capitals are no sign of a name.
    if m.group().isupper() and bare[-12:].isupper():
        return None
    pair = " ".join(w.lower() for w in _LETTERS.findall(bare)[-2:])
    last, score = last.rstrip("."), 0.2
    if last in NAMING or last in ROLES or pair in NAMING_PAIRS:
        score += 0.5
    elif pair in LEADING:
        score += 0.4
    if AFTER_PERSON.match(text, m.end()):
        score += 0.3
    return (score, start, m.end(), "name") if score >= ACCEPT else None


def find(text: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """(the text without invisible characters, [(start, end, type)]) in order, without overlaps."""
    if not text:
        return "", []
    text = _INVISIBLE.sub("", text).replace(" ", " ") if not text.isascii() else text
    low = text.lower()
    spelled = "@" in text or any(w in low for w in ("at)", "at]", "at}", "(a)", "[a]", "ät)", " dot ", "arroba", "arobase"))
    spans = [(1.0, m.start(), m.end(), "email") for m in _EMAIL.finditer(text)] if spelled else []
    spans += _numbers(text) + _addresses(text) + _names(text)
    order = {t: i for i, t in enumerate(TYPES)}
    taken: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(spans, key=lambda s: (order[s[3]], -s[0], s[1] - s[2], s[1])):
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))
    return text, sorted(taken)


def value(span: str) -> str:
    """An item as it is compared: lower case, only letters and digits."""
    return "".join(c for c in span.lower() if c.isalnum())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, kinds, values = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            text, spans = find(text)
            for kind, v in sorted({(k, value(text[a:b])) for a, b, k in spans}):
                at.append(i)
                kinds.append(kind)
                values.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["key", "pii_type", "value"])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, counts = [], []
        for original in batch.column("text").to_pylist():
            text, spans = find(original)
            parts, last = [], 0
            for a, b, kind in spans:
                parts += [text[last:a], f"[{kind.upper()}]"]
                last = b
            out.append(original if not spans else "".join([*parts, text[last:]]))
            counts.append(len(spans))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["key", "text", "replaced"])


def _run(df: DataFrame, key: str, text: str, how, columns: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(how, f"key {rows.schema['key'].dataType.simpleString()}, {columns}").withColumnRenamed("key", key)


def personal(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, pii_type, value) of the items in each text.

    Null, empty and blank texts have none.  Rows that are the same count once.  An empty table gives an empty result.
    """
    return _run(df, key, text, _find, "pii_type string, value string").distinct()


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, replaced): each text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in place
    of its items, one row per row; null stays null, and a text without items stays as it is."""
    return _run(df, key, text, _redact, "text string, replaced int")
