import random

import pytest

from strata.llm import leaks as L

WORDS = "the keeper quietly moved seven brass lamps along a narrow stair before dawn while two clerks copied every page of the green ledger and nobody in Oldmere noticed".split()
TEXT = " ".join(WORDS)
ITEM = f"Read the passage.\n{TEXT}.\nWhat was moved?"
OTHER = "Read the passage.\nIn Karst the old miller sold nine grey geese at noon because winter had come early and the river froze over near the mill.\nWho sold them?"
ZH = "阅读短文并回答问题。\n1843年，在石桥天文台后面，新来的钟表匠悄悄修好了三十座旧钟，那是5月12日，因为冬天来得太早。\n谁修好了钟？"


@pytest.fixture(scope="module")
def index():
    return L.Index([(1, ITEM), (2, OTHER), (3, ZH), (4, None), (5, "one line")])


def found(index, text):
    return {f[0] for f in L.find(index, text)}


@pytest.mark.parametrize("change", [
    lambda w: " ".join(w),
    lambda w: " ".join(w).upper(),
    lambda w: ", ".join(w),
    lambda w: "\n\n".join(w),
    lambda w: " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)),
    lambda w: "&nbsp;".join(w),
    lambda w: "".join(x + "​" + " " for x in w),
    lambda w: " ".join(chr(ord(x[0]) + 0xFEE0) + x[1:] if x[0].isascii() else x for x in w),
    lambda w: " ".join(w).replace("a", "а"),
    lambda w: " ".join(x for i, x in enumerate(w) if i not in (5, 14)),
    lambda w: " ".join(w[:6] + ["extra"] + w[6:18] + ["word"] + w[18:]),
    lambda w: " ".join(w).replace("narrow", "narorw").replace("clerks", "clerk").replace("ledger", "ledgar"),
    lambda w: "Nice kettle. " + " ".join(w[4:17]) + " and it works well.",
])
def test_forms_and_edits_are_found(index, change):
    assert found(index, change(WORDS)) == {1}


@pytest.mark.parametrize("text", [
    None, "", "   ", "Read the passage.", "What was moved?", "Read the passage. What was moved?",
    " ".join(WORDS[:8]), " ".join(WORDS[3:12]), "x" * 100_000,
    " ".join(random.Random(4).sample(WORDS, len(WORDS))),
])
def test_what_is_no_case(index, text):
    assert found(index, text) == set()


def test_characters(index):
    p = L.passage(ZH)
    assert found(index, "很好。" + p[:24] + "真的。") == {3}
    assert found(index, " ".join(p)) == {3} and found(index, p.replace("，", "").replace("。", "")) == {3}
    assert found(index, p[:14]) == set()


def test_two_items_and_the_place(index):
    text = "Good. " + TEXT + " Fine! " + L.passage(OTHER)
    assert found(index, text) == {1, 2}
    place = next(f for f in L.find(index, text) if f[0] == 1)
    assert text[place[1] : place[2]] == TEXT and place[3] == len(WORDS)


def test_shared_phrases_are_no_leak():
    phrases = ["in the winter of the great {} frost", "and kept the receipt for decades", "in {} the widow of the miller", "sold {} crates of dried plums"]
    rnd = random.Random(2)
    make = lambda: " ".join(rnd.choice(phrases).format(rnd.randrange(1000, 9999)) for _ in range(8))
    index = L.Index([(i, f"a\n{make()}\nb") for i in range(30)])
    texts = [make() for _ in range(60)]
    longest = lambda t, k: max((s[4] for s in L.stretches(index, L.units(t)[0], k, L.Index.hits(index, L.units(t)[0], False).get(k, []))), default=0)
    for t in texts:
        for k, *_ in L.find(index, t):
            assert longest(t, k) >= L.LEAST_WORDS  # only a stretch that really is in the passage


def test_table(spark):
    docs = [(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (None, TEXT, "x"), (4, "clean " * 50_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (None, ITEM), (8, None), (9, ITEM.replace("Read", "Now read"))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in L.leaks(df, items).collect()), key=str)
    assert got == sorted([(1, 7), (1, 7), (1, 9), (1, 9), (None, 7), (None, 9)], key=str)
    one_by_one = L.leaks(df, items, block_chars=1)  # a pass for each item
    assert sorted(((r.doc_id, r.item_id) for r in one_by_one.collect()), key=str) == got
    assert L.leaks(df, items.where("false")).count() == 0 and L.leaks(df.where("false"), items).count() == 0


def test_removal(spark):
    df = spark.createDataFrame([(1, f"Good. {TEXT} Bye.", "x"), (2, "clean", "y"), (3, None, None)], "doc_id long, text string, _cuts0 string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    hits = L.leaks(df, items)
    assert {r.doc_id: r.text for r in L.without_leaks(df, hits).collect()} == {1: "Good.  Bye.", 2: "clean", 3: None}
    assert {r.doc_id for r in L.without_leaks(df, hits, spans=False).collect()} == {2, 3}


def test_every_stretch_is_removed(spark):
    far = " ".join(f"far{i}" for i in range(150))
    part = " ".join(WORDS[3:18])
    texts = [f"Good. {TEXT} {far} {TEXT} Bye.", f"{part} {far} {TEXT} {far} {part}", f"{TEXT} near {TEXT}", " ".join([TEXT] * 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.text for r in L.without_leaks(df, L.leaks(df, items)).collect()}
    assert got[0] == f"Good.  {far}  Bye." and got[1] == f" {far}  {far} " and got[2] == " near " and got[3].strip() == ""
    pairs = L.leaks(df, items, every=False).collect()
    assert sorted((r.doc_id, r.item_id, r.size) for r in pairs) == [(i, 7, len(WORDS)) for i in range(4)]


def test_stretches_that_share_words(index):
    item = L.Index([(1, "Read.\nin the old town of Karst a miller sold nine grey geese and left in the old town\nWho?")])
    text = "in the old town of Karst a miller sold nine grey geese and left in the old town of Karst a miller sold nine grey geese"
    found = sorted(f[1:3] for f in L.find(item, text))
    assert found[0][0] == 0 and max(f[1] for f in found) == len(text)


@pytest.mark.parametrize("words", [
    WORDS[:11] + ["basement"] + WORDS[12:23],
    WORDS[:11] + ["deep", "basement"] + WORDS[13:24],
    WORDS[5:14] + ["tow"] + WORDS[15:24],  # two
])
def test_replaced_words_are_bridged(index, words):
    assert found(index, " ".join(words)) == {1}


def _typo(word, rnd):
    """A word of four letters or more with one letter wrong."""
    i = rnd.randrange(1, len(word) - 1)
    return rnd.choice((word[:i] + word[i + 1 :], word[:i] + "q" + word[i:], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]))


@pytest.mark.parametrize("every", [4, 3, 2])
def test_an_edit_in_every_few_words_hides_nothing(index, every):
    rnd = random.Random(every)
    words = [_typo(w, rnd) if i % every == 0 and len(w) >= 4 else w for i, w in enumerate(WORDS)]
    assert found(index, " ".join(words)) == {1}


@pytest.mark.parametrize("tag", ['<p style="' + "x" * 3000 + '">', "<|" + "z" * 300 + "|>"])
def test_long_markup_interrupts_nothing(index, tag):
    assert found(index, " ".join(WORDS[:7]) + f" {tag} " + " ".join(WORDS[7:14])) == {1}


def test_a_misspelt_word_between_two_that_it_may_stand_for():
    words = "some grey cover fell over that old clover field while seven rooks flew south".split()
    index = L.Index([(1, "i\n" + " ".join(words) + "\nq"), (2, "i\na lover of maps rode a rover home\nq")])
    assert found(index, " ".join(words).replace("cover", "cuver").replace("clover", "cloverr")) == {1}


def test_blocks_change_no_answer(spark):
    rnd = random.Random(9)
    phrase = WORDS[:9]
    items = [(i, "Do.\n" + " ".join([*phrase, *(f"w{i}x{rnd.randrange(40)}" for _ in range(14)), *phrase]) + "\nWhy?") for i in range(12)]
    texts = [(i, " ".join(t.split("\n")[1].split()[rnd.randrange(8) :][:22]).replace("brass", "brsas")) for i, t in items]
    texts += [(90, " ".join([*phrase, "odd", *phrase])), (91, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(tuple, L.leaks(docs, items, block_chars=n).collect())) for n in (1 << 20, 500, 1)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) >= 12


def test_recall_of_planted_passages():
    """Invented passages, planted whole or in part in invented texts with edits, against where they were planted."""
    rnd = random.Random(11)
    letters = "abcdefghijklmnoprstuvw"
    vocabulary = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 10))) for _ in range(3000)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(25, 60))] for _ in range(60)]
    index = L.Index([(i, "Read this.\n" + " ".join(p) + ".\nWhy?") for i, p in enumerate(passages)])
    want, got = set(), set()
    for d in range(600):
        filler = lambda: [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40))]
        words, truth = filler(), set()
        if d % 3:
            k = rnd.randrange(60)
            p, n = passages[k], rnd.randrange(7, len(passages[k]) + 1)
            start = rnd.randrange(len(p) - n + 1)
            part = p[start : start + n]
            if n >= 18:  # edits that leave a stretch of more than 12 words
                part = [_typo(w, rnd) if len(w) >= 4 and rnd.random() < 0.15 else w for w in part]
                if rnd.random() < 0.5:
                    at = rnd.randrange(4, n - 4)
                    part[at:at] = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 4))]
                if rnd.random() < 0.3:
                    del part[rnd.randrange(5, n - 5)]
            words += part
            truth = {k} if n >= 12 else set()
        words += filler()
        text = rnd.choice((" ", "\n", ", ", " <br/> ")).join(rnd.choice((w, w, w.upper(), f"«{w}»")) for w in words)
        want |= {(d, k) for k in truth}
        got |= {(d, k) for k in found(index, text)}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    assert recall >= 0.97 and precision >= 0.99, (recall, precision)  # measured: 0.979 and 1.0
