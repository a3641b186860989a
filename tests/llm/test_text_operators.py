"""Text operators: brute force, round trips and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tandemtext.llm import leaks, overlap, pairs, personal, repetition, tokens, truncation

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "po", "ra", "su", "te", "vi") for b in ("den", "fer", "gan", "hol", "jun", "kes", "lam", "mor", "nis", "pat")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


# Overlaps ------------------------------------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def edited(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        if not w:
            break
        i = rnd.randrange(len(w))
        kind = rnd.choice("cad")
        if kind == "c":
            w[i] = rnd.choice(WORDS)
        elif kind == "a":
            w.insert(i, rnd.choice(WORDS))
        else:
            del w[i]
    return w


def test_same_words_is_the_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a = [rnd.choice(WORDS[:12]) for _ in range(rnd.randrange(1, 60))]
        b = edited(rnd, a, rnd.randrange(0, 9)) or a
        want, most = lcs(a, b), max(len(a), len(b))
        got = overlap.same_words(a, b)
        if 5 * (most - want) < most:
            assert got == want
        else:
            assert got == -1 or 5 * (most - got) >= most


@pytest.mark.parametrize("frequent, broadcast", [(4, 0), (4, 10**6), (100, 10**6)])
def test_overlaps_equal_brute_force(spark, monkeypatch, frequent, broadcast):
    monkeypatch.setattr(overlap, "FREQUENT", frequent)
    monkeypatch.setattr(overlap, "BROADCAST_CHUNKS", broadcast)
    monkeypatch.setattr(overlap, "BROADCAST_DOCS", broadcast)
    rnd = random.Random(4)
    boiler = prose(rnd, 30)
    train = [(i, prose(rnd, rnd.choice([25, 60, 90, 200])), boiler if i % 3 == 0 else prose(rnd, 40)) for i in range(60)]
    held = [(1000 + i, " ".join(edited(rnd, train[i][1].split(), max(1, len(train[i][1].split()) * (i % 3) // 30))).upper(), boiler + "!" if i % 4 == 0 else None) for i in range(30)]
    held += [(2000, "too short", ""), (2001, None, None), (5, train[6][1], "x")]
    schema = "id long, a string, b string, doc string"
    df = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], schema)
    got = {(r.key_a, r.key_b, r.field) for r in overlap.overlaps(df(held + held[:3]), df(train), "id", ["a", "b"]).collect()}
    want = set()
    for h in held:
        for t in train:
            for k, f in ((1, "a"), (2, "b")):
                x, y = overlap.words_of(h[k]), overlap.words_of(t[k])
                if min(len(x), len(y)) >= 20 and h[0] != t[0] and 5 * (max(len(x), len(y)) - lcs(x, y)) < max(len(x), len(y)):
                    want.add((h[0], t[0], f))
    assert got == want and len(want) > 100


@pytest.mark.parametrize("side, broadcast", [(20_000, 10**6), (37, 10**6), (37, 0)])
@pytest.mark.parametrize("words, changed, held, copies", [(60, 1, 1, 400), (80, 1, 20, 20), (120, 3, 30, 30), (100, 9, 40, 40)])
def test_overlaps_of_many_near_copies(spark, monkeypatch, words, changed, held, copies, side, broadcast):
    """Groups of near copies, all of whose chunks are frequent, come out whole."""
    monkeypatch.setattr(overlap, "SIDE", side)
    monkeypatch.setattr(overlap, "BROADCAST_CHUNKS", broadcast)
    rnd = random.Random(6)
    text = prose(rnd, words).split()

    def version(k):
        w = list(text)
        for i in rnd.sample(range(words), changed):
            w[i] = f"new{k}x{i}"
        return k, " ".join(w)

    train = [version(k) for k in range(copies)] + [(5000 + k, prose(rnd, words)) for k in range(20)]
    asked = [(9000, " ".join(text))] if held == 1 else [version(9000 + k) for k in range(held)]
    df = lambda rows: spark.createDataFrame(rows, "id long, a string")
    got = {(r.key_a, r.key_b) for r in overlap.overlaps(df(asked), df(train), "id", ["a"]).collect()}
    assert got == {(a, b) for a, _ in asked for b in range(copies)}


def test_overlaps_of_a_thousand_near_copies_on_either_side(spark):
    rnd = random.Random(8)
    text = prose(rnd, 60).split()
    rows = [(k, " ".join([*text[: k % 60], f"new{k}", *text[k % 60 + 1 :]])) for k in range(2000)]
    df = lambda part: spark.createDataFrame(part, "id long, a string")
    got = overlap.overlaps(df(rows[:1000]), df(rows[1000:]), "id", ["a"])
    assert got.select("key_a", "key_b").distinct().count() == 1000 * 1000


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([], "id long, a string")
    assert overlap.overlaps(none, none, "id", ["a"]).count() == 0


def test_typography_makes_no_difference():
    assert overlap.words_of("It’s “Fine” — OK\xa0now") == overlap.words_of("it's \"fine\" - ok now")


# Truncation ----------------------------------------------------------------------------------------------------------

WHOLE = [
    "The town council met on Monday. It was late.", "We left early.\n\nMany thanks,\nYour allotment team", "We left late.\n\nMany thanks,\nYour allotment team", "Done at last. Many thanks, Your allotment team",
    "Bring these.\n- film nights\n- rain barrels", "We like film nights. We like rain barrels.", "More at notes.example.org/guide", "All good 🙂", "All good. 🙂", "N/A", "", "   ", "(no output)", "<br/>", "...", "He said \"yes.\"",
]
CUT = ["The town council met on", "The town cou", "The town council met on...", "We left ear<b", "It was la [truncated]", "Many thanks, Your allotment", "Bring these.\n- film nights\n- rain", "It was a ... Read more", "One went (continued", "The council&hellip;"]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_cut_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(truncation, "BROADCAST_KEYS", limit)
    rows = [(i, t) for i, t in enumerate(WHOLE + CUT)] + [(999, None), (0, WHOLE[0])]
    df = spark.createDataFrame(rows, "id long, text string").select(F.struct("id").alias("key"), "text")
    got = [(r.key.id, r.cut) for r in truncation.cut_texts(df).collect()]
    assert len(got) == len(rows)
    wrong = [(rows[i][1]) for i, c in dict(got).items() if i != 999 and c != (i >= len(WHOLE))]
    assert not wrong
    assert dict(got)[999] is False


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("copies", [1, 2, 3, 40])
def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark, monkeypatch, limit, copies):
    monkeypatch.setattr(truncation, "BROADCAST_KEYS", limit)
    cut = ["They met at the old mill and went to the riv", "Bring these.\n- film nights\n- rain barr", "Go by the lak\nand then by the lak\nthen go by the lak"]
    rows = [(f"{i} {k}", t if k % 2 else t.upper() + " ") for i, t in enumerate(cut) for k in range(copies)] + [(f"w{k}", f"All is well here for {k} days. It was late.") for k in range(60)]
    got = {r.key for r in truncation.cut_texts(spark.createDataFrame(rows, "key string, text string")).where("cut").collect()}
    assert got == {k for k, _ in rows if k[0] != "w"}


@pytest.mark.parametrize("others", [300, 3000, 9000])
def test_the_same_ends_are_cut_at_every_size_of_the_corpus(spark, others):
    rnd = random.Random(5)
    asked = {
        "signature": "It all went well in the end.\n\nKind regards,\nOttilie Brandreth",
        "fragment": "We met at the mill and took the barg",
        "phrase": "It was late and we had to take the",
        "closed phrase": "It was late and we had to take the.",
        "closed": "It was late and we had to take the barge.",
        "sign-off": "We met at the mill.\nYours ever the mill crew",
    }
    rows = list(asked.items()) + [(f"w{k}", f"{prose(rnd, 8)} and we had to take the barge to the {prose(rnd, 1)}. It was {prose(rnd, 1)} late." + (" They sold the barge." if k % 5 == 0 else "") + ("\nYours ever the mill crew" if k % 7 == 0 else "")) for k in range(others)]
    got = {r.key for r in truncation.cut_texts(spark.createDataFrame(rows, "key string, text string")).where("cut").collect()}
    assert got == {"fragment", "phrase", "closed phrase"}


def test_cut_of_nothing_and_of_a_very_long_text(spark):
    empty = spark.createDataFrame([], "key long, text string")
    assert truncation.cut_texts(empty).count() == 0
    long = spark.createDataFrame([(1, "a word or two. " * 30_000 + "and then"), (2, "a word or two. " * 30_000)], "key long, text string")
    assert {r.key: r.cut for r in truncation.cut_texts(long).collect()} == {1: True, 2: False}


# Repetition ----------------------------------------------------------------------------------------------------------


def brute_repeated(text):
    import re

    w = re.sub(r"[^\w]+|_", " ", re.sub(r"\d", "0", re.sub("['’]", "", (text or "").lower()))).split()
    seen, covered = set(), set()
    for i in range(len(w) - 3):
        g = tuple(w[i : i + 4])
        if g in seen:
            covered.update(range(i, i + 4))
        seen.add(g)
    return len(w), len(covered)


def test_repetition_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, "  "), (3, "one two three"), (4, "la la la la la la la"), (5, "We met 12 men. We met 34 men. We met 56 men!")]
    for i in range(6, 60):
        part = prose(rnd, rnd.randrange(1, 12))
        rows.append((i, " ".join(rnd.choice([part + ".", prose(rnd, 5)]) for _ in range(rnd.randrange(1, 15)))))
    df = spark.createDataFrame([(*r, 7) for r in rows], "id long, text string, words int")
    got = {r.id: r for r in repetition.repetition(df, "id", "text").collect()}
    for i, t in rows:
        n, repeated = brute_repeated(t)
        assert (got[i].words, got[i].repeated_words) == (n, repeated), t
        assert got[i].repeated == (repeated > 0.3 * n)
    assert repetition.repetition(df.limit(0), "id", "text").count() == 0


def test_repetition_of_a_very_long_text(spark):
    rnd = random.Random(6)
    text = prose(rnd, 40_000)
    got = repetition.repetition(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", only=("words", "repeated_share")).first()
    assert (got.words, got.repeated_words) == brute_repeated(text)


# Pairs ---------------------------------------------------------------------------------------------------------------


def test_defects(spark):
    rnd = random.Random(7)
    ask = "The committee has decided that the old library will be closed for the winter, and the books are to be kept in the town hall until it opens again. Nobody knew when that would be."
    answers = {
        1: (ask, None, "empty"), 2: (ask, " \n", "empty"), 3: (ask, "Human Text:", "empty"),
        4: (ask, "I'm sorry, but I can't rewrite this passage.", "refusal"), 5: (ask, "Leider darf ich bei dieser Anfrage nicht helfen.", "refusal"),
        6: (ask, "Here is the rewritten text:\n\n" + ask, "copied"), 7: (ask, ask.replace("old", "new").upper(), "copied"),
        8: (ask, "Der Ausschuss hat beschlossen, dass die alte Bibliothek im Winter geschlossen wird und die Bücher im Rathaus sind. Niemand weiß, wann es wieder so weit ist.", "other_language"),
        9: (ask, "They are shutting the library over winter. The books go to the town ha", "truncated"),
        10: (ask, "They are shutting the library over winter. The books go to the town hall. I can't help thinking it came too early, and we had to decline the offer of a van, but that is how it is with these things and there is not much that we can do about it now. " + prose(rnd, 40) + ".", None),
        11: (None, "The books go to the town hall.", None), 12: ("", "", "empty"),
    }
    df = spark.createDataFrame([(i, a, b, "clash") for i, (a, b, _) in answers.items()] + [(4, *answers[4][:2], "clash"), (None, "a", "b", "c")], "id long, q string, a string, key string")
    got = {r.id: r.defect for r in pairs.defects(df, "id", "q", "a").collect()}
    assert got == {i: d for i, (_, _, d) in answers.items() if d}
    assert pairs.defects(df.limit(0), "id", "q", "a").count() == 0


# Tokens --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk,overlap_", [(1 << 17, 1 << 12), (40, 20), (200, 50)])
@pytest.mark.parametrize("spread", [30, 1 << 20])
def test_ids_equal_those_of_the_whole_text(spark, chunk, overlap_, spread):
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    texts = [None, "", "  \n\n  ", "<|endoftext|> don't we'll", "a" * 500, " " * 300 + "x", "été 東京 🙂\r\n\r\n" * 40, "\n\n \t x" * 100]
    texts += ["word " * 30 + "a" * 300 + " don't..'start'll 12" * 20, "12345" * 60 + " x", "...'s..'" * 60, "一二三四" * 80]
    texts += ["".join(rnd.choice(["word", " ", "\n", "  ", "'re", "'", "12", "...", "ß", "\n\n", "A"]) for _ in range(300)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    whole = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap_, spread=spread, long_chunk=chunk, long_overlap=overlap_).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (whole.encode(t, add_special_tokens=False).ids if t else [])
        if t:
            assert "".join(tokens.pieces_of(t, chunk, overlap_)) == t
    back = tokens.decode(spark.createDataFrame([*got.items(), (-1, None)], "doc_id long, ids array<int>"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {-1: "", **{i: t or "" for i, t in enumerate(texts)}}
    assert tokens.encode(df.limit(0), "doc_id", "text", chunk=chunk, overlap=overlap_).count() == 0


# Leaks ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("index_words", [2_000_000, 300])
def test_leaks(spark, monkeypatch, index_words):
    monkeypatch.setattr(leaks, "INDEX_WORDS", index_words)
    rnd = random.Random(9)
    vocabulary = [f"{w}{i}" for w in WORDS for i in "abcdefgh"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(80)), None if i % 2 else " ".join(rnd.choice(vocabulary) for _ in range(40))) for i in range(20)]
    filler = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs, want = [], set()
    for i in range(20):
        w = items[i][1].split()
        docs.append((i, f"{filler(60)} <b>{' '.join(w[10:45]).upper()}</b>, {filler(30)}"))
        want.add((i, i))
        z = w[5:40]
        z[8], z[20] = "changed", "words"
        del z[30]
        docs.append((100 + i, filler(20) + "\n" + ".\n".join(z) + filler(5)))
        want.add((100 + i, i))
        docs.append((200 + i, filler(30) + " " + " ".join(w[10:28]) + " " + filler(30)))  # a short quotation
        if items[i][2]:
            docs.append((300 + i, items[i][2]))
            want.add((300 + i, i))
    docs += [(900, None), (901, ""), (902, filler(5000)), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item string")
    h = spark.createDataFrame(items + [items[0], (None, "x", "y"), (77, "short", None)], "item_id long, text string, ref string")
    got = {(r.doc_id, r.item) for r in leaks.leaks(d, "doc_id", "text", h, "item_id", ["text", "ref"]).collect()}
    assert got == want
    assert leaks.leaks(d.limit(0), "doc_id", "text", h, "item_id", ["text", "ref"]).count() == 0
    assert leaks.leaks(d, "doc_id", "text", h.limit(0), "item_id", ["text", "ref"]).count() == 0


@pytest.mark.parametrize("index_words", [2_000_000, 4000])
def test_leaks_of_edited_runs(spark, monkeypatch, index_words):
    monkeypatch.setattr(leaks, "INDEX_WORDS", index_words)
    rnd = random.Random(10)
    items = [(i, " ".join(f"w{rnd.randrange(4000)}" for _ in range(120 + i))) for i in range(60)]
    docs, want = [], set()
    for i, text in items:
        for every in (4, 6, 8, 12):
            for lead in (3, 11, 20):
                z = text.split()[30 + every : 55 + every]
                for k in range(every - 1, len(z) - 2, every):
                    z[k] = "changed"
                docs.append((len(docs), " ".join([f"x{k}" for k in range(lead)] + z + ["end"])))
                want.add((docs[-1][0], i))
    d, h = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item) for r in leaks.leaks(d, "doc_id", "text", h, "item_id", ["text"]).collect()} == want


def test_leaks_of_items_that_share_text(spark):
    rnd = random.Random(11)
    shared = " ".join(f"w{rnd.randrange(4000)}" for _ in range(40))
    own = lambda: " ".join(f"w{rnd.randrange(4000)}" for _ in range(60))
    items = [(i, f"{own()} {shared} {own()}") for i in range(40)] + [(100 + i, own()) for i in range(60)]
    items += [(200 + i, items[50][1]) for i in range(12)]
    docs = [(1, " ".join(shared.split()[5:30])), (2, items[50][1]), (3, " ".join(shared.split()[5:29]))]
    d, h = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item) for r in leaks.leaks(d, "doc_id", "text", h, "item_id", ["text"]).collect()}
    assert got == {(1, i) for i in range(40)} | {(2, 110)} | {(2, 200 + i) for i in range(12)}


# Personal information ------------------------------------------------------------------------------------------------

FOUND = [
    ("Write to anna.berg@example.net or call 020 7946 0018.", {("email", "annabergexamplenet"), ("phone", "02079460018")}),
    ("Mail: rosa[at]pellan[dot]example", {("email", "rosaatpellandotexample")}),
    ("My name is Lorvane, Julia and my number is +44 (0)20 7946 0029.", {("name", "lorvanejulia"), ("phone", "4402079460029")}),
    ("Prof. Henrik K. von Kelgrave (ID 666-47-9832) came.", {("name", "henrikkvonkelgrave"), ("id_number", "666479832")}),
    ("We met Ingrid\nPelldenby at home (75B Ashgill\nLane) today.", {("name", "ingridpelldenby"), ("address", "75bashgilllane")}),
    ("Die Anschrift lautet Am Corvanebach 139, 00700 Mistralton.", {("address", "amcorvanebach139")}),
    ("La dirección es C/ Pellan 28, 00435 Dunroseton. Llame al 900-000-068.", {("address", "cpellan28"), ("phone", "900000068")}),
    ("Le dossier est à envoyer au 16 bis, rue du Selwick, 00578 Velderton.", {("address", "16bisrueduselwick")}),
    ("Die Ausweisnummer von Nimwick, Jonas lautet T99726369D.", {("name", "nimwickjonas"), ("id_number", "t99726369d")}),
    ("Lot 2020 1145 0983 held 1,204 parts; order no. 48-2291-07 of 2021-03-14.", set()),
    ("Meet @ 10.30 in Florence Heath, hall 2. The Victoria Sands Library and @quernforum.", set()),
    ("In Saint Helen Bridge and Grace Harbour it rained. An office on Larkspur Lane.", set()),
    ("", set()), (None, set()), ("   ", set()),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_personal_items(text, want):
    clean, spans = personal.find(text)
    assert {(k, personal.value(clean[a:b])) for a, b, k in spans} == want


def test_checksums():
    assert personal.mod97("2550814168025" + f"{97 - 2550814168025 % 97:02d}") and not personal.mod97("255081416802500")
    assert personal.luhn("79927398713") and not personal.luhn("79927398710")
    assert personal.letter23("12345678Z") and not personal.letter23("12345678A")


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, FOUND[0][0], "c"), (2, None, "c"), (3, "Nothing here.", "c"), (1, FOUND[0][0], "c")], "doc_id long, text string, key string")
    got = sorted((r.doc_id, r.text or "", r.replaced) for r in personal.redacted(df, "doc_id", "text").collect())
    assert got == [(1, "Write to [EMAIL] or call [PHONE].", 2)] * 2 + [(2, "", 0), (3, "Nothing here.", 0)]
    assert personal.personal(df, "doc_id", "text").count() == 2
    assert personal.personal(df.limit(0), "doc_id", "text").count() == 0


def test_a_very_long_text_is_searched_to_its_end():
    text = "There is nothing in it. " * 20_000 + "Write to anna.berg@example.net."
    assert [k for *_, k in personal.find(text)[1]] == ["email"]


def test_queries_run(spark):
    from tandemtext.llm import queries

    small = "/root/testdata/sf0.001"
    shape = {
        "p2_found": ["pair_id_a", "pair_id_b"], "p3_found": ["pair_id", "field"], "p4_found": ["table_name", "row_id"], "p5_found": ["pair_id", "defect"],
        "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "pii_type", "value"],
    }
    for name, f in queries.QUERIES.items():
        df = f(spark, small)
        assert df.count() >= 0
        if name in shape:
            assert df.columns == shape[name]


# Checksums and names without a list -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, found",
    [
        ("Pay with 4111 1111 1111 1111 today.", {("id_number", "4111111111111111")}),
        ("Pay with 4111 1111 1111 1112 today.", set()),
        ("Order 4111 1111 1111 1111 is on its way.", set()),
        ("IBAN DE89 3704 0044 0532 0130 00, please", {("id_number", "de89370400440532013000")}),
        ("IBAN DE89 3704 0044 0532 0130 01, please", set()),
        ("It ended in the 1997/2012 season, see the ID 5.", set()),
        ("We spoke to the manager Priya Natarajan about it.", {("name", "priyanatarajan")}),
        ("My name is Hiroshi Tanaka and I live here.", {("name", "hiroshitanaka")}),
        ("Contact: Kwame Mensah\nbefore noon.", {("name", "kwamemensah")}),
        ("Please ask Dr. Wei Chen.", {("name", "weichen")}),
        ("Contact: von Brelow, Aiko", {("name", "vonbrelowaiko")}),
        ("Meet me at Mensah Bridge with Tanaka Council.", set()),
        ("The applicant Saltby Library gave it.", set()),
        ("Contact: Front Desk\nbefore noon.", set()),
        ("Dear Hiring Manager, the teacher Training Programme begins.", set()),
        ("Signed: Zainab Al-Hassan", {("name", "zainabalhassan")}),
        ("Herr Özgür Yıldız wohnt hier.", {("name", "özgüryıldız")}),
        ("THE TENANT SURVEYS ROSE AND THE TENANT WENT", set()),
        ("İİİ. My name is Hiroshi Tanaka.", {("name", "hiroshitanaka")}),
    ],
)
def test_checksums_decide_and_names_need_no_list(text, found):
    clean, spans = personal.find(text)
    assert {(k, personal.value(clean[a:b])) for a, b, k in spans} == found


# Defects in more languages ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "answer, refused",
    [
        ("I'm sorry, but I can't help with that request. " + "There are many other things that we could talk about instead of it. " * 7, True),
        ("К сожалению, я не могу выполнить эту просьбу.", True),
        ("很抱歉，我无法协助您改写这段文字。", True),
        ("申し訳ありませんが、お手伝いできません。", True),
        ("Przepraszam, ale nie mogę pomóc.", True),
        ("Tyvärr kan jag inte hjälpa till med det.", True),
        ("عذرا، لا أستطيع مساعدتك في هذا الطلب.", True),
        ("मुझे खेद है, मैं यह नहीं कर सकता।", True),
        ("I can't help thinking the plan came too early.", False),
        ("I'm sorry, but I can't make Thursday's meeting. " + "We should meet on Friday to go through the plans for the new depot. " * 7, False),
        ("We will not open on Monday. The shop stays shut.", False),
        ("", False),
    ],
)
def test_refusals(answer, refused):
    assert pairs.is_refusal(answer, pairs._WORD.findall(answer.lower())) is refused


@pytest.mark.parametrize(
    "answer",
    [
        "Отчёт совета готов вовремя и все довольны.",
        "董事会的报告已经按时完成。",
        "تقرير المجلس جاهز في الوقت المحدد",
        "बोर्ड की रिपोर्ट समय पर तैयार है",
        "Sprawozdanie zarządu jest gotowe i nie ma się czym martwić, że tego dnia było późno oraz może jak zawsze.",
        "Rapporten från styrelsen är klar och det är inte för sent att läsa den som vi har på bordet.",
    ],
)
def test_answers_in_other_languages(answer):
    prompt = "the report of the board is that it was on time and they have it in hand".split()
    assert pairs.is_other_language(prompt, answer, pairs._WORD.findall(answer.lower()))
    assert not pairs.is_other_language(prompt, "The report was on time and the board has it in hand.", "the report was on time and the board has it in hand".split())


def test_copies_are_told_by_compression_alone():
    rnd = random.Random(9)
    prompt = prose(rnd, 60).split()
    frame = "here you can find what was asked for".split()
    assert pairs.is_copy(prompt, prompt) and pairs.is_copy(prompt, edited(rnd, prompt, 2))
    assert pairs.is_copy(prompt[:20], [*prose(rnd, 8).split(), *prompt[:20], *frame])
    assert not pairs.is_copy(prompt, prose(rnd, 60).split()) and not pairs.is_copy(prompt, prompt[:12])
    half = [w for i, w in enumerate(prompt) if i // 10 % 2 == 0] + prose(rnd, 30).split()
    assert not pairs.is_copy(prompt, half)


def test_leaks_by_text_of_the_item_and_with_any_key(spark):
    rnd = random.Random(12)
    question, answer = prose(rnd, 60), " ".join(f"w{rnd.randrange(4000)}" for _ in range(60))
    h = spark.createDataFrame([("one", question, answer), ("two", answer, "short"), ("three", None, None)], "item string, q string, a string")
    d = spark.createDataFrame([("x", f"{question} and then {answer}"), ("y", answer), ("z", "short")], "doc string, text string")
    got = {(r.doc, r["item"]): list(r.fields) for r in leaks.leaks(d, "doc", "text", h, "item", ["q", "a"]).collect()}
    assert got == {("x", "one"): ["a", "q"], ("x", "two"): ["q"], ("y", "one"): ["a"], ("y", "two"): ["q"]}


@pytest.mark.parametrize("words", [22, 30, 60, 100, 180])
def test_heavily_edited_texts_meet_even_if_all_their_shared_chunks_are_frequent(spark, words):
    """Groups of versions of one text, each with nearly a tenth of its words changed, so that two differ in under a fifth."""
    rnd = random.Random(words)
    text = [f"v{rnd.randrange(3000)}" for _ in range(words)]

    def version(k):
        w = list(text)
        for i in rnd.sample(range(words), (words - 1) // 10):
            w[i] = f"new{k}x{i}"
        return k, " ".join(w)

    train, asked = [version(k) for k in range(60)], [version(9000 + k) for k in range(60)]
    df = lambda rows: spark.createDataFrame(rows, "id long, a string")
    got = {(r.key_a, r.key_b) for r in overlap.overlaps(df(asked), df(train), "id", ["a"]).collect()}
    want = {(a, b) for a, x in asked for b, y in train if 5 * (words - lcs(x.split(), y.split())) < words}
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 3000


def test_overlap_fractions(spark):
    rnd = random.Random(13)
    a, b = [f"v{rnd.randrange(3000)}" for _ in range(120)], [f"u{rnd.randrange(3000)}" for _ in range(120)]
    schema = "id long, a string, b string"
    held = spark.createDataFrame([(1, " ".join(a), None), (2, " ".join(a[:60] + b[:60]), "short"), (3, " ".join(b), ""), (None, " ".join(a), None)], schema)
    held = held.union(held.where("id = 2"))
    train = spark.createDataFrame([(9, " ".join(a).upper() + ".", " ".join(b))], schema)
    got = {(r.id, r.field): (r.words, r.fraction) for r in overlap.fractions(held, train, "id", ["a", "b"]).collect()}
    assert set(got) == {(1, "a"), (2, "a"), (3, "a")}
    assert got[(1, "a")] == (120, 1.0) and got[(3, "a")] == (120, 0.0)  # another field's text is no match
    assert 0.35 < got[(2, "a")][1] <= 0.5
    assert overlap.fractions(held.limit(0), train, "id", ["a"]).count() == 0
    assert {r.fraction for r in overlap.fractions(held, train.limit(0), "id", ["a"]).collect()} == {0.0}
