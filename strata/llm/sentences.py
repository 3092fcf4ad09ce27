"""Sentence units across languages and scripts (problem 8), in SQL expressions alone.

The text is rewritten by a chain of regular expressions. Each step that hides or tells apart
a character puts one private-use character in its place, so lengths stay; a last kind of
step inserts a mark after every unit. The text is then split at the marks, the lengths of
the pieces give the places of the units, and the units themselves are cut out of the
untouched text, which restores everything that was hidden. Private-use characters of the
text that could be taken for placeholders are hidden first.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import apart

# Placeholders. Terminators, closers and openers each have a range of their own, so that a
# class of them is one comparison.
HOLD = "\ue000"  # a terminator that ends nothing
MARK = "\ue001"  # inserted: a unit ends here
DOT, ELLIPSIS, BANG, QUERY = "\ue010", "\ue011", "\ue012", "\ue013"
STOP = "\ue01d"  # a dot of an abbreviation that also ends the sentence
CLOSE_Q, GAP, ZERO = "\ue034", "\ue03e", "\ue03f"  # directed ", space before a guillemet, character without width
OPEN_Q = "\ue045"
T, FIRM, WIDE, FULL, LOUD = r"\ue010-\ue024", r"\ue012-\ue024", r"\ue020-\ue024", r"\ue022-\ue024", r"\ue020\ue021"
CLOSE, QUOTED, BRACKETED = r"\ue030-\ue03f", r"\ue030-\ue034", r"\ue035\ue036"
OPEN = r"\ue040-\ue050"  # first quotation marks, then brackets
CALM = r"\ue010\ue011\ue015-\ue017\ue01d"  # dots and full stops, but those of Chinese and Japanese
HIDE = (
    ".…!?؟۔।॥\u037e‼⁇⁈⁉" + "！？。｡．" + "”»」』" + ")）]}】》›’'" + "\u200b\u200c\u2060\ufeff\u00ad\u200e\u200f" + "“«「『„" + "(（[{【《‹‘‚¿¡",
    "\ue010\ue011\ue012\ue013\ue014\ue015\ue016\ue017\ue018\ue019\ue01a\ue01b\ue01c" + "\ue020\ue021\ue022\ue023\ue024" + "\ue030\ue031\ue032\ue033"
    + "\ue035\ue036\ue037\ue038\ue039\ue03a\ue03b\ue03c\ue03d" + ZERO * 7 + "\ue040\ue041\ue042\ue043\ue044"
    + "\ue046\ue047\ue048\ue049\ue04a\ue04b\ue04c\ue04d\ue04e\ue04f\ue050",
)
LIST = "\ue002"  # inserted for a while: the next line is an item of a list
# Private-use characters of the text that could be taken for placeholders, and the one in their place.
FOREIGN = ("".join(map(chr, range(0xE000, 0xE060))), "\uf8ff" * 0x60)

# Fullwidth letters and digits, and the ordinary ones in their place.
WIDE_FORMS = tuple("".join(chr(shift + ord(c)) for r in ("09", "AZ", "az") for c in map(chr, range(ord(r[0]), ord(r[1]) + 1))) for shift in (0xFEE0, 0))

WS = r"[\s\u0085\u001c-\u001f\p{Z}]"
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the characters of WS
HS = r" \t\u00a0\u3000\u2009\u202f"
NL = r"(?>\r\n|[\n\r\u0085\u2028\u2029])"
NO_NL = r"[^\n\r\u0085\u2028\u2029]"
EMO = r"\x{1F000}-\x{1FAFF}☀-❚❟-➿⬀-⯿⌀-⏿\ufe0f\u200d\u20e3"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
THAI = r"฀-๿"

# Abbreviations, chosen by hand for the eleven languages. Those of the first list never end a sentence.
NEVER = (
    "mr mrs ms messrs dr prof capt lt sgt st approx vs incl excl ret "
    "hr fr bzw ca inkl zzgl evtl ggf vgl bspw sog abb str nr tel "
    "mme mlle env ex "
    "sr sra srta dra ud uds ej pág págs núm aprox avda ee "
    "ул см стр рис им проф напр тел просп корп "
    "βλ σελ δηλ κα αρ εικ τηλ "
    "डॉ कि ग्रा रु पृ श्री सं"
).split()
# These may, if the next word begins one; · stands for a dot and a possible space.
MAYBE = "etc usw mwst uu u·s u·k a·m p·m т·д т·п др руб коп κ·λπ κτλ min hrs inc ltd corp co jr mm".split()
# Only before a number.
NUMBERED = "no nos p pp fig figs vol s n ch sec art".split()
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez".split()
# Words that go on after an abbreviation, where capitals do not tell.
GOES_ON = "are is was were and or but on in at for to of with which from und oder sind auf für dans et sont y o para и на или для και".split()

# Letters that look alike.
ALIKE = ("aа", "cс", "eе", "oо", "pр", "xх", "yу", "iі", "sѕ", "mм", "tт", "kк", "hһ", "wԝ", "dԁ", "vѵν", "uυ")


def _any(words: list[str]) -> str:
    """Any of the words, in either case, also with look-alike letters, or characters without width after a letter.

    Words that begin alike share their beginning, so that few letters are tried at a place.
    """
    alike = {c: pair for pair in ALIKE for c in pair}

    def letter(c: str) -> str:
        if c == "·":
            return rf"{DOT}\s?"
        forms = "".join(dict.fromkeys(x for y in alike.get(c, c) for x in (y, y.upper()) if len(x) == 1))
        return f"{f'[{forms}]' if len(forms) > 1 else forms}{ZERO}?"

    def branch(rests: list[str]) -> str:
        heads = dict.fromkeys(alike.get(r[0], r[0]) for r in rests if r)
        parts = [letter(h[0]) + branch([r[1:] for r in rests if r and r[0] in h]) for h in heads]
        return f"(?:{'|'.join(parts)}){'?' if '' in rests else ''}" if parts else ""

    return branch([w.lower() for w in words])


def _chars(ranges: str) -> list[str]:
    """The placeholders of a class."""
    return [chr(c) for c in range(0xE000, 0xE060) if re.match(f"[{ranges}]", chr(c))]


def _sub(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(by))


def marked(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the text with placeholders, and a mark after each unit.

    A step is a projection of its own, so that no expression is computed, or written into
    the plan, more than once, and is left out for texts that lack what it is about: most
    texts have no list, no quotation and letters of one script. No step looks back or ahead
    further than a word, a run of marks or a quotation that it passes once, so the time is
    in proportion to the text and no length changes an answer.
    """
    t = F.col(text)
    has = lambda *words: reduce(Column.__or__, [t.contains(w) for w in words])
    beyond = F.length(t) != F.octet_length(t)  # not ASCII alone
    # Texts in which capitals do not tell where sentences begin.
    begin = rf"(?:^|[.!?…][”»)\"']*{WS}+)[“‘'«„(¿¡\"]*\p{{Lu}}"
    flags = {
        "_flat": ~t.rlike(begin) | ~t.rlike(r"\p{Ll}{2}"),
        "_lines": has("\n", "\r") | beyond & t.rlike("[\u0085\u2028\u2029]"),
        # Ranges with all of CJK's and EMO's characters, and some more, are told faster.
        "_cjk": beyond & t.rlike(r"[\u3002-\u9fff\uf900-\ufaff\uff01-\uff9f\x{16f00}-\x{1b2ff}\x{20000}-\x{3ffff}]"),
        "_thai": beyond & t.rlike(f"[{THAI}]"),
        "_emoji": beyond & t.rlike(r"[\u200d\u20e3\u2300-\u2bff\ufe0f\x{1F000}-\x{1FAFF}]"),
        "_quote": has('"') | beyond & t.rlike("[“”„«»「」『』]"),
        "_bracket": has(")", "）"),
        "_dot": has("."),
        "_dots": has("..", "…"),
        "_firm": has("!", "?") | beyond & t.rlike("[;؟۔।॥\u037e‼⁇⁈⁉！？。｡．]"),
    }
    df = df.withColumns(flags)
    flat, lines, cjk, thai, with_emoji, quote, bracket, with_dot, with_dots, with_firm = map(F.col, flags)

    def step(when: Column | None, pattern: str, by: str, where_flat: tuple[str, str] | None = None) -> None:
        """Replace in the texts that `when` tells, in those without usable capitals by where_flat."""
        nonlocal df
        col = F.col(out)
        new = _sub(col, pattern, by)
        if where_flat is not None:
            new = F.when(flat, _sub(col, *where_flat)).otherwise(new)
        df = df.withColumn(out, new if when is None else F.when(when, new).otherwise(col))

    df = df.withColumn(out, F.translate(t, *(a + b + c for a, b, c in zip(HIDE, WIDE_FORMS, FOREIGN))))
    step(beyond & has(";"), r";(?<=[Ͱ-Ͽἀ-῿];)", "\ue018")  # the Greek question mark

    # Lines: a blank line ends a unit; a list item is one, and so is what stands before the list.
    space = rf"[{HS}]*+"
    number = rf"\d++[{DOT}\ue024\ue035]"  # of an item
    step(lines, rf"({NL}{space})(?={NL})", rf"$1{MARK}")
    # The line after a colon, also after a blank one, or after an item.
    numbered = lines & t.rlike(rf"[\n\r][{HS}]*\d")
    step(
        numbered,
        rf"(?m)((?:^{MARK}?{space}{number}[{HS}]++{NO_NL}*+\r?\n|[:：]{space}\r?\n(?:{space}{MARK}?{space}\r?\n)?))(?={space}{number}[{HS}])",
        rf"$1{LIST}",
    )
    step(numbered, rf"{LIST}({space}\d++)[{DOT}\ue024\ue035]([{HS}]++{NO_NL}*+)", rf"{MARK}$1{HOLD}$2{MARK}")
    bullet = rf"({space}[-*•·‣▪●○◦–][{HS}]++{NO_NL}*+)"
    step(lines | t.rlike(rf"^{bullet}"), rf"(?m)^{bullet}", rf"{MARK}$1{MARK}")

    # Dots of abbreviations, initials, ordinals.
    before = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?<![\p{{L}}\p{{M}}\p{{N}}]{ZERO})"
    after = rf"\p{{L}}\p{{N}}"
    begins = rf"(?={WS}*+(?:$|[{OPEN}\"{EMO}\p{{Lu}}{MARK}]))"
    goes_on = rf"(?={WS}*+(?:$|[{OPEN}\"{EMO}{MARK}])|{WS}++(?!{_any(GOES_ON)}(?![\p{{L}}\p{{M}}]))[{after}])"
    single = rf"{DOT}(?!{DOT})"
    maybe = rf"{single}(?<={before}{_any(MAYBE)}{DOT})"
    step(with_dot, maybe + begins, STOP, (maybe + goes_on, STOP))
    held = (
        rf"(?<={before}{_any(NEVER + MAYBE)}{DOT})",
        rf"(?<={before}{_any(NUMBERED)}{DOT})(?=(?:{WS}|{ZERO}|&nbsp;)*+\d)",
        rf"(?<={before}(?<![:：][{HS}])(?![{CJK}])\p{{L}}\p{{M}}{{0,3}}{ZERO}?{DOT})",
        rf"(?<=\d{DOT})(?=(?:{WS}|&nbsp;)++{_any(MONTHS)}(?!\p{{L}}))",
        rf"(?<=[{THAI}]{DOT})",
    )
    step(with_dot, rf"{single}(?:{'|'.join(held)})", HOLD)

    # Quotation marks that open and close alike, or the other way round.
    step(has('"'), rf"\"(?<![^\s\p{{Z}}{OPEN}—–;>-]\")(?=[^\s\p{{Z}}])", OPEN_Q)
    step(has('"'), r"\"", CLOSE_Q)
    step(beyond & has("„"), r"(\ue044[^\ue040\ue044\ue030\n]++)\ue040", rf"$1{CLOSE_Q}")
    step(beyond & has("»"), r"[ \u00a0\u202f](?=\ue031)", GAP)

    # What is quoted or bracketed ends nothing before its last marks: the text is cut behind its quotation
    # marks, and what a closing one ends is a stretch whose marks are held. With openers it must begin at one.
    def hold_within(when: Column, stops: str, closers: str, openers: str | None = None) -> None:
        nonlocal df
        df = df.withColumn("_cut", F.when(when, F.split(F.col(out), f"(?<=[{stops}])", -1)))
        at_end = lambda p, c: F.substring(p, -1, 1).isin(_chars(c))

        def settled(p: Column, i: Column) -> Column:
            inner = F.rtrim(p, F.lit("".join(_chars(T + GAP + ZERO + closers))))
            inside = at_end(p, closers) & inner.rlike(f"[{T}]")
            if openers is not None:
                inside = inside & at_end(F.get("_cut", i - 1), openers)
            marks = _chars(T)
            held = F.translate(inner, "".join(marks), HOLD * len(marks))
            return F.when(inside, F.concat(held, F.substring(p, F.length(inner) + 1, F.length(p)))).otherwise(p)

        df = df.withColumn(out, F.when(when, F.array_join(F.transform("_cut", settled), "")).otherwise(F.col(out)))

    hold_within(quote, rf"{MARK}\ue030-\ue034\ue040-\ue045", QUOTED)
    hold_within(bracket, rf"{MARK}\ue035\ue036\ue046\ue047", BRACKETED, r"\ue046\ue047")

    # A run of marks is tried from its beginning only, else long runs cost the square of their length.
    firm = rf"(?:(?=[{T}])(?<![{T}])[{DOT}{ELLIPSIS}]*+[{FIRM}][{T}]*+)"
    emoji = rf"(?:[{HS}]*+[{EMO}](?:[{EMO}{HS}]*[{EMO}])?)?+"  # possessive: emoji are never cut off
    end = rf"{WS}*+(?:$|{MARK})"
    small = rf"(?={end}|{WS}++[^\p{{Ll}}\s\p{{Z}}])"

    def dots(behind: str = "") -> str:
        return rf"(?:(?=[{DOT}{ELLIPSIS}])(?<![{T}]){behind}(?:{DOT}{{2,}}+|{ELLIPSIS}[{DOT}{ELLIPSIS}]*+)(?![{T}]))"

    new = r"[\p{Lu}\ue040\ue041\ue044\ue045\ue04f\ue050]"
    df = df.withColumns(
        {
            "_closed": F.col(out).rlike(rf"[{T}][{CLOSE}]"),
            "_tight": F.col(out).rlike(rf"[{T}](?:[{HS}]*+[{EMO}][{EMO}{HS}]*+)?(?:{new}|&nbsp;)"),
            "_letter": beyond & F.col(out).rlike(rf"[{T}](?:[{HS}]*+[{EMO}][{EMO}{HS}]*+)?[\p{{Lo}}&&[^{CJK}]]"),
        }
    )
    closed, tight, letter = map(F.col, ("_closed", "_tight", "_letter"))

    # Chinese and Japanese: marks end without a space; dots after a hesitation go on.
    step(cjk & with_dots, rf"((?:(?<=嗯|呃|ええと|えーと)|(?<=う ?ー ?ん)|(?!\A)\G) *+){ELLIPSIS}", rf"$1{HOLD}")
    step(cjk & with_dots, rf"({dots(rf'(?<=[{CJK}])')}{emoji})(?![{CLOSE}])", rf"$1{MARK}")
    step(cjk, rf"([{WIDE}][{T}]*+{emoji})(?![{CLOSE}{T}])", rf"$1{MARK}")
    step(cjk, rf"([{BANG}{QUERY}](?<=[{CJK}\p{{N}}].)[{BANG}{QUERY}]*+{emoji})(?=[{CJK}\ue040\ue042\ue047{OPEN_Q}])", rf"$1{MARK}")
    step(cjk & closed, rf"([{FULL}][{T}]*+[{CLOSE}]++{emoji})(?!と|って|との|とか)", rf"$1{MARK}")
    step(cjk & closed, rf"([{LOUD}][{T}]*+[{CLOSE}]++{emoji})(?={end}|{WS}*+[{OPEN}]|{WS}++\p{{Lu}})", rf"$1{MARK}")

    # Marks before a space or the end.
    step(with_firm | F.col(out).contains(STOP), rf"({firm}[{ZERO}]*+{emoji})(?={WS}|$)", rf"$1{MARK}")
    dot = rf"({DOT}(?<![{T}]{DOT})(?![{T}]){emoji})"
    step(with_dot, dot + small, rf"$1{MARK}", (rf"{dot}(?={WS}|$)", rf"$1{MARK}"))
    hesitation = r"(?iu:(?<!(?<![\p{L}\p{M}])(?:well|hm|hmm)))"
    step(with_dots, rf"({dots()}{emoji}){small}", rf"$1{MARK}", (rf"({dots(hesitation)}{emoji})(?={WS}|$)", rf"$1{MARK}"))
    # ... and before closing quotes or brackets, if a sentence follows.
    cased = rf"(?={end}|{WS}++(?:[\p{{Lu}}\p{{N}}]|[{OPEN}]))"
    step(
        closed,
        rf"([{T}][{CLOSE}]++{emoji}){cased}",
        rf"$1{MARK}",
        (rf"([{CALM}][{CLOSE}]++{emoji})(?={WS}|$)|([{T}][{CLOSE}]++{emoji})(?={end}|{WS}++[{OPEN}])", rf"$1$2{MARK}"),
    )
    step(closed, rf"([{CALM}][{CLOSE}]++{emoji})(?={WS}++\p{{Lo}})", rf"$1{MARK}")

    # Marks without a space after them.
    prior = rf"(?<=[\p{{Ll}}\p{{N}}\p{{Lo}}\p{{M}}€%$£{CLOSE}])"
    follows = rf"(?={new}|&nbsp;\p{{Lu}})"
    step(tight, rf"((?=[{T}{HS}]){prior}(?:[{HS}]?{firm}|{single}|{dots()}){emoji}){follows}", rf"$1{MARK}")
    step(letter, rf"((?=[{T}])(?<=[\p{{Lo}}\p{{M}}\p{{N}}])(?:[\ue012-\ue017]++|{single}){emoji})(?=[\p{{Lo}}&&[^{CJK}]])", rf"$1{MARK}")
    step(closed, rf"([{T}][{CLOSE}]++)(?=\p{{Lu}}[\p{{L}}{HS}])", rf"$1{MARK}")

    # Emoji in place of the mark.
    face = rf"([{EMO}](?<![{EMO}].)(?:[{EMO}{HS}]*[{EMO}])?+)"
    step(with_emoji, rf"{face}(?={end}|{WS}++[^\p{{Ll}}\s\p{{Z}}]|[\p{{Lu}}{CJK}])", rf"$1{MARK}", (rf"{face}(?={WS}|$)", rf"$1{MARK}"))

    # Thai: spaces between Thai letters.
    step(thai, rf"(?<=[{THAI}{ZERO}])({WS}++)(?=[{THAI}])", rf"$1{MARK}")
    return df.drop(*flags, "_cut", "_closed", "_tight", "_letter")


#: Pieces whose lengths are summed one by one; longer texts are summed by such blocks first.
BLOCK = 128


def places(df: DataFrame, text: str, marked_text: str, out: str, sentence: bool = False) -> DataFrame:
    """df with `out`: array of struct<start_pos, end_pos> of the units of a text, with sentence also those.

    Pieces are taken in blocks: places are summed, and units cut out, within a block and then
    over the blocks, so that a text of n units does not cost n times its length.
    """
    # Of each piece: its length, that of its leading white space and that of its inner text.
    df = df.withColumn(
        "_pieces",
        F.transform(
            F.split(marked_text, MARK, -1),
            lambda p: F.struct(
                F.length(p).alias("n"),
                (F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))).alias("lead"),
                F.length(F.trim(p, F.lit(BLANKS))).alias("text"),
            ),
        ),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])
    pieces = F.col("_pieces")
    cut = lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))
    numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    short = F.size(pieces) <= BLOCK  # a text of one block needs no blocks
    blocks = F.transform(F.transform(numbers, cut), lambda b: F.struct(b.alias("block"), total(b).alias("n")))
    df = df.withColumn("_blocks", F.when(~short, blocks))
    df = df.withColumn("_sizes", F.transform("_blocks", lambda b: F.struct(b["n"].alias("n"))))

    def with_base(b: Column, i: Column) -> Column:
        base = total(F.slice("_sizes", F.lit(1), i))
        own = [F.substring(F.col(text), base + 1, b["n"]).alias("own")] if sentence else []
        return F.struct(b["block"].alias("block"), base.alias("base"), *own)

    df = df.withColumn("_based", F.transform("_blocks", with_base))

    def within(block: Column, base: Column, source: Column) -> Column:
        def place(p: Column, i: Column) -> Column:
            start = total(F.slice(block, F.lit(1), i)) + p["lead"]
            own = [F.substring(source, start + 1, p["text"]).alias("sentence")] if sentence else []
            return F.struct((base + start).alias("start_pos"), (base + start + p["text"]).alias("end_pos"), *own)

        return F.filter(F.transform(block, place), lambda u: u["end_pos"] > u["start_pos"])

    one = within(pieces, F.lit(0), F.col(text))
    many = F.flatten(F.transform("_based", lambda b: within(b["block"], b["base"], b["own"] if sentence else F.lit(""))))
    return df.withColumn(out, F.when(short, one).otherwise(many)).drop("_pieces", "_blocks", "_sizes", "_based")


def sentences(df: DataFrame, id: str = "doc_id", text: str = "text", sentence: bool = True) -> DataFrame:
    """id, unit, start_pos, end_pos, sentence: the units of each row's text, in one pass without a shuffle.

    Positions count code points from 0, the end is exclusive, white space around a unit is
    outside it and every other character lies in exactly one unit. Null, empty and blank
    texts have no unit. Repeated rows give their units again; null ids stay; other columns
    are not read. sentence=False leaves the units' text out and is cheaper.
    """
    apart([id], ("unit", "start_pos", "end_pos", "sentence"))
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = places(marked(rows, "_text", "_w"), "_text", "_w", "_p", sentence)
    # Outer: else the optimizer filters by the size of the array before it is computed, and for
    # that writes the whole chain out again at each of its steps.
    units = found.select("_id", F.posexplode_outer("_p").alias("unit", "_p")).where(F.col("unit").isNotNull())
    return units.select(F.col("_id").alias(id), "unit", "_p.*")
