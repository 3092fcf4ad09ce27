import pytest

from strata.llm import sentences as S

# A bar ends a unit.
CASES = [
    "It works. |It is good! |Really?! |Yes.",
    "Mr. and Mrs. Zamorin have one. |Dr. Pell agreed.",
    "It weighs approx. 5.4 kg, i.e. less. |It cost $8.20 incl. tax. |Readings went from .72 to 17.43 here.",
    "Model no. 22 fits, no. 11 does not. |Is it cheap? |No. |Fine.",
    "See www.stolan.example/faq.html or help@a.example now. |Bye.",
    "It came at 3 p.m. on a Sunday. |It stopped at 6 a.m. |We left.",
    "Hooks, tape, etc. are in the box. |It has pins, etc. |After that it broke.",
    "We bought it in the U.S. and used it. |J. R. Ovarre has one.",
    'He shouted "Stop! It is hot!" when I touched it. |"It works." |That was all.',
    "“Never again,” she said. |(The lid was wet when it came.) |Capt. Ovarre (ret.) likes it.",
    "Well... the app works. |Meh… |It is old... |The end",
    "in hindsight, it is fine. |so far, so good! |well... it works.",
    'HE SHOUTED "STOP! IT IS HOT!" WHEN I TOUCHED IT. |WOW!',
    "The sound is good.|The grip fits.|Why?|Because.",
    "A fine bag 👍 |I like it. 😡 |It is good!🎉🎉 |Bye ⭐⭐⭐",
    "A line\nbreak ends nothing. |Next one\n\n|After a blank line",
    "Good.\n\n|Pros:\n|- light\n|- fits in a bag\n\n|Bye.",
    "Cons:\n|1. wobbly\n|2. no spare lid\n\n|Bye.",
    "Geliefert wurde am 5. |Niemand war da. |Am 8. Mai kam es an, z. B. mit Haken, Kabel usw. |Gut.",
    "„Nie wieder!“, sagte meine Tante. |Es kostet 54,38 € inkl. MwSt. und Versand.",
    "¡Genial! |¿En serio? |«¡Nunca más!», dijo mi jefa. |Lo compré en EE. UU. y va bien.",
    "Vraiment ? |« Plus jamais ! » a dit mon oncle. |Selon M. Drumond, p. ex. le câble, c'est bon.",
    "Купил на ул. Ovarre в доме 5. |В наборе крючки и т. д. на все случаи. |Он спросил: «Что случилось?» — и ушёл.",
    "Γιατί χρειάζονται 29 βίδες; |Βλ. σελ. 8 στο φυλλάδιο. |Ο κ. Bexley έχει τον ίδιο, π.χ. εδώ.",
    "嗯……开关能用。|真的吗？！|“再也不买了！”我爸笑着说。|“很舒服。”|同事只说了这一句。|（有点湿。）|固件v5.14.0很好！",
    "うーん……ふたはまあまあです。|「もう買わない。」と父が言いました。|「もう動かない。」|上司はそれだけ言いました。|1,440円です。",
    "लगभग 3.3 कि.ग्रा. है। |डॉ. Pell के अनुसार ठीक है। |“फिर कभी नहीं!” पड़ोसी ने कहा।",
    "انظر ص. 63 في الدليل. |حقا؟ |«لن أكرر ذلك!» قالت أختي ضاحكة. |رائع!",
    "Mr. and Mr\u200bs. Pell ha\u200bve one\u200b. |Nr\u00ad. 4 ni\u00adcht\u00ad. |J\u2060. R. Pell. |It stopped at 6 а.m. |Cарt. Pell. |Ｄｒ. Ｐｅｌｌ.",
    "ในกล่องมี 5 ชิ้นกับถุงเล็ก |ดร. Hestle บอกว่าดี |หนัก 20.17 กก. เบากว่า |ไม่คุ้ม",
]


def units(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.start_pos, r.end_pos, r.sentence) for r in S.sentences(df).orderBy("start_pos").collect()]


def test_scripts(spark):
    texts = [c.replace("|", "") for c in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in S.sentences(df).orderBy("doc_id", "start_pos").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for i, c in enumerate(CASES):
        assert got[i] == [p.strip() for p in c.split("|")], texts[i]


@pytest.mark.parametrize("case", [
    'He shouted "Stop! Dr. Pell is here!" when I came. |Bye.',
    "“Wait! J. R. Ovarre has one,” she said. |Bye.",
    "Er rief „Halt! Am 8. Mai kommt er!“, als ich kam. |Gut.",
    "The lid (it broke! Mr. Pell saw it) was wet. |Bye.",
    "The lid (it broke! J. R. Ovarre saw it) was wet. |Bye.",
    "Der Deckel (er brach! Am 8. Mai war das) ist nass. |Gut.",
    'The lid (it broke! He said "Stop! Go!" and left) was wet. |Bye.',
    'I asked Dr. Pell. |It broke. |Mr. Pell said "Stop! Mrs. Pell is here!" and left.',
])
def test_held_dots_within_quotes_and_brackets(spark, case):
    assert [u[2] for u in units(spark, case.replace("|", ""))] == [p.strip() for p in case.split("|")]


LONG = "a word or two " * 60


@pytest.mark.parametrize("case", [
    f"He said “Stop! {LONG}is long. Bye!” when I came. |Bye.",
    f"The lid (it broke! {LONG}it is!) was wet. |Bye.",
    f"Er rief „Halt! {LONG}kam er!“, als ich kam. |Gut.",
    f"Pros:\n|1. {LONG}first\n|2. {LONG}second\n|11. third\n|112. last\n\n|Bye.",
    "Pros:" + " " * 9 + "\n|1. one\n|2. two",
    "嗯" + "…" * 40 + "开关能用。|真的" + "！" * 40 + "|好。",
    "Well" + "." * 30 + " the app works. |Bye" + "." * 30 + " |Next.",
    f"It is so{'!' * 90} |“Never{'!' * 90}” she said. |Bye.",
])
def test_no_length_changes_an_answer(spark, case):
    assert [u[2] for u in units(spark, case.replace("|", ""))] == [p.strip() for p in case.split("|")]


def test_recall_on_made_up_texts(spark):
    """Texts put together from units of several languages that no given document holds: nearly all units are found."""
    import random

    rnd = random.Random(5)
    words = {
        "en": ("the otter crosses a frozen bridge", "nobody at the harbour saw it", "Dr. Quill paid 3.75 for it", "we met at 7 p.m. by the gate", "is the lantern lit", "she said “run! now!” and left"),
        "de": ("der Otter überquert die Brücke", "niemand im Hafen sah ihn", "Dr. Quill zahlte 3,75 dafür", "wir kamen am 3. Mai zum Tor", "ist die Laterne an", "sie rief „lauf! jetzt!“ und ging"),
        "es": ("la nutria cruza el puente", "nadie en el puerto la vio", "el Sr. Quill pagó 3,75", "llegamos a la puerta tarde", "está encendida la luz"),
        "fr": ("la loutre traverse le pont", "personne au port ne l'a vue", "M. Quill a payé 3,75", "nous sommes venus à la porte"),
        "ru": ("выдра идёт по мосту", "никто в порту её не видел", "это стоит 3,75 руб. за штуку", "мы пришли к воротам"),
        "zh": ("水獭走过了桥", "港口没有人看见", "灯已经亮了", "我们在门口见面"),
        "ja": ("カワウソが橋を渡った", "港では誰も見なかった", "灯りがついている"),
        "hi": ("ऊदबिलाव पुल पार करता है", "बंदरगाह पर किसी ने नहीं देखा", "डॉ. क्विल ने पैसे दिए"),
    }
    texts, want = [], {}
    for i in range(400):
        lang = rnd.choice(sorted(words))
        ends = {"zh": "。！？", "ja": "。！？", "hi": "।!?"}.get(lang, ".!?")
        text, spots = "", []
        for _ in range(rnd.randrange(1, 9)):
            unit = rnd.choice(words[lang])
            unit = unit[0].upper() + unit[1:] + rnd.choice(ends) + rnd.choice(("", "", "", " 🦦"))
            spots.append((len(text), len(text) + len(unit)))
            text += unit + ("" if lang in ("zh", "ja") else rnd.choice((" ", " ", "\n", "\n\n", "  ")))
        texts.append((i, text))
        want[i] = set(spots)
    got = {i: set() for i in want}
    for r in S.sentences(spark.createDataFrame(texts, "doc_id long, text string"), sentence=False).collect():
        got[r.doc_id].add((r.start_pos, r.end_pos))
    both = sum(len(got[i] & want[i]) for i in want)
    recall, precision = both / sum(map(len, want.values())), both / sum(map(len, got.values()))
    assert recall >= 0.99 and precision >= 0.99, (recall, precision)


def test_every_character_lies_in_one_unit(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = {i: [] for i in docs}
    for r in S.sentences(spark.read.parquet(f"{small}/documents.parquet")).collect():
        assert docs[r.doc_id][r.start_pos : r.end_pos] == r.sentence
        seen[r.doc_id].append((r.start_pos, r.end_pos))
    for i, text in docs.items():
        covered = [0] * len(text or "")
        for a, b in seen[i]:
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            for p in range(a, b):
                covered[p] += 1
        assert all(c == 1 or c == 0 and ch.isspace() for c, ch in zip(covered, text or ""))


def test_nothing_to_split(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t　 ", "x"), (None, "Ok.", "x"), (4, "A. ", "x"), (4, "A. ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _w string")
    got = sorted(((r.doc_id, r.start_pos, r.end_pos, r.sentence) for r in S.sentences(df).collect()), key=str)
    assert got == sorted([(None, 0, 3, "Ok."), (4, 0, 2, "A."), (4, 0, 2, "A.")], key=str)
    assert S.sentences(df.where("false")).count() == 0


def test_placeholders_and_wide_characters_of_the_text(spark):
    text = "a b. 𝒳😀 c!"
    assert [u[2] for u in units(spark, text)] == ["a b. 𝒳😀", "c!"] or "".join(u[2] for u in units(spark, text)).replace(" ", "") == text.replace(" ", "")
    assert all(text[a:b] == s for a, b, s in units(spark, text))


@pytest.mark.parametrize("text", ["Fine. " * 60_000, ")" * 50_000, "😀 " * 20_000, "!" * 50_000, '"' * 20_000, "a" * 200_000, "« a ! » " * 20_000, "- a\n" * 20_000])
def test_very_long_texts(spark, text):
    got = units(spark, text)
    assert sum(b - a for a, b, _ in got) >= sum(not c.isspace() for c in text)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
