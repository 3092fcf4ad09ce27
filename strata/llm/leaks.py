"""Evaluation texts leaking into training text (problem 7): broadcast n-grams of the test items.

Test passages and texts are brought to the same form: tags, entities and control strings
away, compatibility forms, accents, case, look-alike letters and characters without width
evened out, cut into words, or characters for Chinese and Japanese. The n-grams of the
passages, with their places, are sent to every executor; every window of every text is
looked up there. What is found is verified: hits on one diagonal of text and passage form
runs, runs are chained over small edits and interruptions, and a chain counts if it spans
enough of the passage in order and is that passage's own, for passages share phrases.
"""

from __future__ import annotations

import hashlib
import html
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import work_dir
from .names import apart

#: Words, or characters of Chinese and Japanese, of a stretch that counts.
LEAST_WORDS, LEAST_CHARS = 12, 20
#: Length of the n-grams that are looked up.
GRAM_WORDS, GRAM_CHARS = 4, 6
#: Places that a small edit leaves out of the passage, and foreign ones that it puts in; it may do both
#: where both sides have OWN_SIDES n-grams of their own.
SKIPPED, FOREIGN = 2, 3
#: Foreign places where the passage goes on without a break, at most; an interruption falls
#: between two sentences of the passage, or both sides have so many n-grams of their own.
INTERRUPTION, OWN_SIDES = 120, 4
#: Share of n-grams of no other passage that a stretch with edits must have, for passages
#: share phrases, and texts may be built from such phrases without repeating a passage.
OWN_SHARE = 0.2
#: Characters of items that are sent to the executors at once, about 150 MB in each Python worker; more go in several passes.
BLOCK_CHARS = 2 << 20
#: Words whose mended form a worker remembers.
REMEMBERED = 500_000

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー々"
_LETTER = rf"[[\p{{L}}\p{{M}}\p{{N}}]--[{_CJK}]]"
_PIECE = regex.compile(
    rf"(?P<control><\|[^|<>]++\|>|</?s>|\[/?INST\])|(?P<tag></?[A-Za-z][^<>]*+>)"
    rf"|(?P<entity>&(?:\#\d{{1,7}}|\#x[0-9A-Fa-f]{{1,6}}|[A-Za-z]{{2,10}});)"
    rf"|(?P<word>{_LETTER}+(?:(?:[\p{{Cf}}'’ʼ]+|-\r?\n){_LETTER}+)*)|(?P<char>[{_CJK}])",
    regex.V1,
)
_WORDS = regex.compile(rf"{_LETTER}+(?:(?:[\p{{Cf}}'’ʼ]+|-\r?\n){_LETTER}+)*|[{_CJK}]", regex.V1)
_INLINE = regex.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|mark|s|small|span|strong|sub|sup|u)\b[^<>]*>", regex.I)
# Letters that look alike.
_CYRILLIC = "асеіјорхуѕһԛԝвкмнтοαρνικχυε"
_LATIN = "aceijopxyshqwbkmhtoapvikxue"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYRILLIC, _LATIN), str.maketrans("aceopxykmtbh", "асеорхукмтвн")
_CHAR = regex.compile(f"[{_CJK}]")
_FORMS: dict[str, str] = {}


def _form(word: str) -> str:
    found = _FORMS.get(word)
    if found is None:
        w = "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c) not in ("Mn", "Cf", "Po", "Pd", "Cc", "Pf", "Lm"))
        w = unicodedata.normalize("NFKC", w).casefold()
        cyrillic = sum("Ͱ" <= c <= "ԯ" for c in w)
        latin = sum("a" <= c <= "z" for c in w)
        if cyrillic and latin:
            w = w.translate(_TO_LATIN if latin >= cyrillic else _TO_CYRILLIC)
        if len(_FORMS) > REMEMBERED:
            _FORMS.clear()
        found = _FORMS[word] = w
    return found


def units(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words and single characters of a text in their common form, and their places."""
    out: list[str] = []
    spots: list[tuple[int, int]] = []
    word_end = glued = -1  # where a word ended; where what may join it to the next one ended
    for m in _PIECE.finditer(text):
        start, end = m.span()
        kind = m.lastgroup
        if kind == "tag":
            if start in (word_end, glued) and _INLINE.fullmatch(m[0]):
                glued = end
            continue
        if kind == "control":
            continue
        piece = html.unescape(m[0]) if kind == "entity" else m[0]
        if kind == "entity" and not piece.isalnum():
            if unicodedata.category(piece[0]) == "Cf" and start in (word_end, glued):
                glued = end
            continue
        form = _form(piece)
        if not form:
            continue
        if kind != "char" and start in (word_end, glued) and out:
            out[-1] += form
            spots[-1] = (spots[-1][0], end)
        else:
            out.append(form)
            spots.append((start, end))
        word_end, glued = (end, -1) if kind != "char" else (-1, -1)
    return out, spots


def digits(words: list[str], spots: list[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Numbers cut into digits, as Chinese and Japanese texts are cut into characters."""
    if not any(len(w) > 1 and w.isdigit() for w in words):
        return words, spots
    cut = [(d, s) for w, s in zip(words, spots) for d in (w if w.isdigit() else (w,))]
    return [w for w, _ in cut], [s for _, s in cut]


def passage(text: str) -> str:
    """The passage of an item: its lines but for the first, an instruction, and the last, a question."""
    return "\n".join(text.split("\n")[1:-1])


def _is_cjk(unit: str) -> bool:
    return len(unit) == 1 and unit > "\u2e7f" and _CHAR.match(unit) is not None


def item_units(passage: str) -> tuple[list[str], list[tuple[int, int]], bool]:
    """Units of a passage, their places, and whether it is taken by characters."""
    words, spots = units(passage)
    chars = sum(map(_is_cjk, words)) * 2 > len(words)
    return (*digits(words, spots), True) if chars else (words, spots, False)


def grams_of(words: list[str], chars: bool) -> Iterator[tuple]:
    n = GRAM_CHARS if chars else GRAM_WORDS
    return zip(*[words[s:] for s in range(n)])


def code(gram: tuple) -> int:
    """64 bits of an n-gram, the same in every process."""
    return int.from_bytes(hashlib.blake2b("\0".join(gram).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Index:
    """n-grams of a block of items; made once, sent to every executor. elsewhere: codes of n-grams that items of other blocks have, too."""

    def __init__(self, items: list[tuple], elsewhere: frozenset[int] = frozenset()) -> None:
        self.ids: list = []
        self.chars: list[bool] = []
        self.breaks: list[set[int]] = []
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.units: list[list[str]] = []
        for id, text in items:
            text_of = passage(text or "")
            words, spots, chars = item_units(text_of)
            # Places of the passage at which a sentence of it has just ended.
            self.breaks.append({i for i in range(1, len(words)) if regex.search("[.!?。！？]", text_of[spots[i - 1][1] : spots[i][0]])})
            k = len(self.ids)
            self.ids.append(id)
            self.units.append(words)
            self.chars.append(chars)
            for j, gram in enumerate(grams_of(words, chars)):
                self.grams[gram].append((k, j))
        self.grams = dict(self.grams)
        self.has_chars = any(self.chars)
        self.own = {g for g, at in self.grams.items() if len({k for k, _ in at}) == 1 and (not elsewhere or code(g) not in elsewhere)}
        self.known = {w for ws in self.units for w in ws}
        #: Neighbours within a passage, which choose among words that a misspelt one may stand for.
        self.pairs = {p for ws in self.units for p in zip(ws, ws[1:])}
        self.near: dict[str, tuple[str, ...]] = {}
        for w in sorted(self.known):
            if len(w) >= 4 and not w.isdigit():
                for d in _deletes(w):
                    self.near[d] = (*self.near.get(d, ()), w)
        #: Mended words, by their form and as they stand in texts.
        self.mended: dict[str, str | tuple[str, ...]] = {}
        self.raw: dict[str, str | tuple[str, ...]] = {}

    def _mend(self, word: str) -> str | tuple[str, ...]:
        """The word, or those words of the items that it looks like or differs from by one letter left out, put in, replaced or swapped."""
        if word in self.known or word.isdigit():
            return word
        for table in (_TO_LATIN, _TO_CYRILLIC):
            if (alike := word.translate(table)) in self.known:
                return alike
        if len(word) < 4:
            return word
        found = dict.fromkeys(self.near.get(word, ()))
        for d in sorted(_deletes(word)):
            if d in self.known and len(d) >= 4:
                found[d] = None
            found |= dict.fromkeys(w for w in self.near.get(d, ()) if _one_edit(word, w))
        return word if not found else next(iter(found)) if len(found) == 1 else tuple(found)

    def mend(self, words: list[str]) -> list[str]:
        """The words, with those that are none of the items' read as what they most likely stand for, before anything is looked up."""
        known = self.mended
        out = [known.get(w) for w in words]
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._mend(w)
            out = [known[w] for w in words]
        return self._settled(out)

    def _settled(self, out: list) -> list[str]:
        """Of words that may stand for several, the one that stands beside the same word in a passage."""
        if tuple in map(type, out):
            for i, found in enumerate(out):
                if type(found) is tuple:
                    near = out[i - 1 : i] + out[i + 1 : i + 2]
                    fits = (c for c in found if any((n, c) in self.pairs or (c, n) in self.pairs for n in near if type(n) is str))
                    out[i] = next(fits, found[0])
        return out

    def plain(self, text: str) -> list[str] | None:
        """The mended words of units, without places and in less time; None for texts with markup."""
        if "<" in text or "&" in text or "[" in text:
            return None
        words, known = _WORDS.findall(text), self.raw
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    form = _form(w)
                    known[w] = form and self._mend(form)
            out = [known[w] for w in words]
        return self._settled([w for w in out if w] if "" in out else out)

    def touches(self, words: list[str], chars: bool) -> bool:
        """Whether any window of the words is an n-gram of a passage."""
        return not self.grams.keys().isdisjoint(grams_of(words, chars))

    def hits(self, words: list[str], chars: bool) -> dict[int, list[tuple[int, int, bool]]]:
        """By item, (place in the text, place in the passage, whether the n-gram is its own)."""
        out: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        for i, gram in enumerate(grams_of(words, chars)):
            if gram in self.grams:
                own = gram in self.own
                for k, j in self.grams[gram]:
                    out[k].append((i, j, own))
        return out


def _one_edit(a: str, b: str) -> bool:
    """Words of one length that differ in one letter, or in two neighbours that are swapped."""
    if len(a) != len(b):
        return False
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 1 or len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]


def _runs(hits: list[tuple[int, int, bool]], n: int) -> list[list]:
    """[text start, passage start, length, own n-grams] of hits in a row on one diagonal."""
    runs: list[list] = []
    for i, j, own in sorted(hits, key=lambda h: (h[1] - h[0], h[0])):
        if runs and runs[-1][1] - runs[-1][0] == j - i and i <= runs[-1][0] + runs[-1][2]:
            runs[-1][2] = i + n - runs[-1][0]
            runs[-1][3] += own
        else:
            runs.append([i, j, n, int(own)])
    return sorted(runs)


def _bridges(words: list[str], theirs: list[str], between: bool, own: int) -> bool:
    """Whether a gap, with these places of the text and of the passage in it, is no end.

    between: it lies between two sentences of the passage; own: the fewer of the own n-grams on either side.
    """
    foreign, skipped = len(words), len(theirs)
    if not skipped:
        return foreign <= FOREIGN or foreign <= INTERRUPTION and (between or own >= OWN_SIDES)
    if not foreign:
        return skipped <= SKIPPED
    if foreign == skipped == 1:  # one word that is the other with two letters changed
        a, b = words[0], theirs[0]
        if min(len(a), len(b)) >= 5 and _deletes(a) & _deletes(b):
            return True
    if skipped <= SKIPPED and foreign <= FOREIGN and own >= OWN_SIDES:
        return True
    if foreign > 4 or skipped > 4:
        return False
    # Two small edits with a few words between them.
    common = sum((Counter(words) & Counter(theirs)).values())
    return common > 0 and foreign + skipped - 2 * common <= 2


def _chains(index: Index, words: list[str], k: int, runs: list[list]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Best chain that ends in each run: as of stretches, and the place of the run before in runs, or -1."""
    theirs = index.units[k]
    best: list[tuple[int, int, int, int, int, int, int]] = []
    for i, j, size, own in runs:
        chain = (i, i + size, j, j + size, size, own, -1)
        for at in range(len(best) - 1, -1, -1):
            start, end, first, after, longest, owns, _ = best[at]
            # Runs come in the order of the text, but may overlap.
            if i - end > INTERRUPTION + len(theirs):
                break
            over = max(0, end - i, after - j)
            if over >= size or not _bridges(words[end : i + over], theirs[after : j + over], after in index.breaks[k], min(owns, own)):
                continue
            new = (start, i + size, first, j + size, max(longest, size), owns + own, at)
            if (new[3] - new[2], new[5]) > (chain[3] - chain[2], chain[5]):
                chain = new
        best.append(chain)
    return best


def stretches(index: Index, words: list[str], k: int, hits: list[tuple[int, int, bool]]) -> list[tuple[int, int, int, int, int, int]]:
    """Best chain that ends in each run: text start and end, passage start and end, longest run, own n-grams."""
    return [c[:6] for c in _chains(index, words, k, _runs(hits, GRAM_CHARS if index.chars[k] else GRAM_WORDS))]


def _accepted(index: Index, words: list[str], k: int, hits: list[tuple[int, int, bool]], every: bool) -> list[tuple[int, int, int]]:
    """(start, end, size) of the largest stretch of an item that counts, or of every one, none within another.

    Stretches are taken from the largest to the smallest; each run is part of one at most. Runs
    that are left are chained again, until no chain counts.
    """
    least = LEAST_CHARS if index.chars[k] else LEAST_WORDS
    runs = _runs(hits, GRAM_CHARS if index.chars[k] else GRAM_WORDS)
    taken: list[tuple[int, int, int]] = []
    while runs:
        chains = _chains(index, words, k, runs)
        counts = []
        for at, (_, _, first, after, longest, own, _) in enumerate(chains):
            size = after - first
            if size >= least and (longest >= least or own >= OWN_SHARE * size):
                counts.append((-size, at))
        if not counts:
            break
        if not every:
            size, at = min(counts)
            return [(chains[at][0], chains[at][1], -size)]
        used: set[int] = set()
        for size, last in sorted(counts):
            parts, at = [], last
            while at >= 0 and at not in used:
                parts.append(at)
                at = chains[at][6]
            if at < 0:
                used.update(parts)
                taken.append((chains[last][0], chains[last][1], -size))
        runs = [r for at, r in enumerate(runs) if at not in used]
    out: list[tuple[int, int, int]] = []
    for t in sorted(taken, key=lambda t: (t[0], -t[1])):
        if not out or t[1] > out[-1][1]:
            out.append(t)
    return out


def _find(index: Index, words: list[str], spots: list[tuple[int, int]], chars: bool, every: bool) -> list[tuple]:
    words = index.mend(words)
    if not index.touches(words, chars):
        return []
    out = []
    for k, hits in index.hits(words, chars).items():
        if index.chars[k] == chars:
            out += [(index.ids[k], spots[start][0], spots[end - 1][1], size) for start, end, size in _accepted(index, words, k, hits, every)]
    return out


def find(index: Index, text: str | None, every: bool = True) -> list[tuple]:
    """(item, start, end, size) of the leaked stretches of a text, or with every=False of the largest of each item."""
    if not text:
        return []
    quick = index.plain(text)
    if quick is not None and not index.touches(quick, False):
        if not index.has_chars or not any(map(_is_cjk, quick)) or not index.touches(digits(quick, [(0, 0)] * len(quick))[0], True):
            return []
    words, spots = units(text)
    out = _find(index, words, spots, False, every)
    if index.has_chars and any(map(_is_cjk, words)):
        out += _find(index, *digits(words, spots), True, every)
    return out


def _shared(items: DataFrame, text: str) -> DataFrame:
    """code of each n-gram that several rows of items have, written to the shared folder."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for t in batch.column(0).to_pylist() for words, _, chars in [item_units(passage(t))] for c in set(map(code, grams_of(words, chars)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["code"])

    path = f"{work_dir(items.sparkSession, 'grams')}/shared"
    found = items.select(text).where(F.col(text).isNotNull()).mapInArrow(codes, "code long")
    found.groupBy("code").count().where("count > 1").select("code").write.parquet(path)
    return items.sparkSession.read.parquet(path)


def blocks(items: DataFrame, id: str, text: str, most: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the items, each of at most `most` characters of text, or one item.

    The items come to the driver one partition at a time and are held a block at a time. An
    n-gram is a passage's own if no other item has it, whichever block that lies in: where
    there are several blocks, n-grams of several items are told by a job before, and the driver
    gets those that its block has.
    """
    rows = items.select(F.col(id), F.col(text)).where(F.col(id).isNotNull() & F.col(text).isNotNull())
    several = (rows.agg(F.sum(F.length(text))).first()[0] or 0) > most
    shared = _shared(rows, text) if several else None

    def index(held: list[tuple]) -> Index:
        if shared is None:
            return Index(held)
        codes = {code(g) for _, t in held for words, _, chars in [item_units(passage(t))] for g in grams_of(words, chars)}
        here = shared.sparkSession.createDataFrame([(c,) for c in codes], "code long")
        return Index(held, frozenset(r.code for r in here.join(shared, "code", "left_semi").collect()))

    held: list[tuple] = []
    size = 0
    for row in rows.toLocalIterator():
        if held and size + len(row[1]) > most:
            yield index(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield index(held)


def leaks(
    df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_chars: int = BLOCK_CHARS, every: bool = True,
) -> DataFrame:
    """id, item_id, start_pos, end_pos, size: one row for each stretch of an item's passage that a text holds.

    With every=False one row for each text and item, that of the largest stretch. The place is
    in code points, its end exclusive; size counts the words, or characters, of the passage
    that the stretch spans. Stretches may overlap, none lies within another of its item. Items beyond block_chars are
    taken in several passes over the texts, so that what is sent to the executors stays
    bounded; a pass has no shuffle, and the number of passes changes no answer. Null and empty texts and items give no rows, items of fewer than three lines have
    no passage, repeated rows give their rows again, other columns are not read.
    """
    apart([id, item_id], ("start_pos", "end_pos", "size"))
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    names = [id, item_id, "start_pos", "end_pos", "size"]
    kinds = [df.schema[id].dataType, items.schema[item_id].dataType, T.IntegerType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    arrow = to_arrow_schema(schema)

    def one_pass(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in find(index, t, every)]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], field.type) for c, field in enumerate(arrow)], schema=arrow)

        return rows.mapInArrow(run, schema)

    out = None
    for index in blocks(items, item_id, item_text, block_chars):
        found = one_pass(spark.sparkContext.broadcast(index))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(df: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """df without the leaked spans of its texts, or with spans=False without those texts' rows.

    id must be unique in df. A text's spans are cut out from the last to the first; where two
    overlap, both are.
    """
    if not spans:
        return df.join(found.select(id).distinct(), id, "left_anti")
    cut = next(n for n in map("_cuts{}".format, range(len(df.columns) + 1)) if n not in df.columns)
    cuts = found.groupBy(id).agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos"))).alias(cut))
    # Keep what lies between the ends reached so far and the next beginning.
    kept = F.aggregate(
        cut,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.greatest(c["start_pos"] - s["at"], F.lit(0)))).alias("out"),
            F.greatest(s["at"], c["end_pos"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))),
    )
    joined = df.join(cuts, id, "left")
    return joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept)).select(*df.columns)
