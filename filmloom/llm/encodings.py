"""Text that was decoded with the wrong character encoding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm.codecs import DOUBLE_BYTE, SINGLE_BYTE, UTF8, Mistake, garble, image, undo_utf8, writes
from filmloom.scratch import cut, drop_cut, join_counted

#: Passages end at sentence marks and line ends.
PASSAGE = re.compile(r"[^\n.!?]+[.!?]*")
#: A word here is a run of ASCII letters and digits and of anything beyond ASCII.
WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
LETTERS = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"[\x80-\U0010ffff]+")
# The same for Spark: passages from their first visible character; words that hold anything beyond ASCII; what is beyond ASCII.
PASSAGES_IN = r"[^\n.!?\s][^\n.!?]*+[.!?]*+"
WORDS_IN = r"(?<!\p{Alnum})\p{Alnum}*+\P{ASCII}[\p{Alnum}\P{ASCII}]*+"
BEYOND = r"\P{ASCII}+"
#: Letters of scripts that two-byte encodings were made for.
EAST = "[\u2e80-\ud7ff\uf900-\ufaff]"
LOST = "\ufffd"
CONTROL = re.compile("[\x80-\x9f]")
#: Two characters that look like UTF-8 read in latin_1.
SEQUENCE = re.compile("[\xc2-\xf4][\x80-\xbf]")
#: Twins that must show a piece of a transformation that no pair of encodings explains; documents a restored word must occur in.
LEAST_PAIRS, LEAST_KNOWN = 2, 3
#: A restored word in so many times more documents than its garbled form needs no other sign of the direction.
KNOWN_RATIO = 3
#: Signs beyond ASCII that may stand between the letters of sound text.
BETWEEN = frozenset("’‘ʼ·‐‑–—…«»„“”‹›\xad")


def _beyond_ascii(text: str) -> Column:
    return F.octet_length(text) > F.length(text)


def _stripped(text: str) -> str:
    return RUN.sub("", text)


def _script(c: str) -> int:
    """Of a letter: 0 Latin, 1 Greek, 2 Cyrillic, 3 any other."""
    return 0 if c < "Ͱ" or "Ḁ" <= c < "ἀ" else 1 if c < "Ѐ" or "ἀ" <= c < "\u2000" else 2 if c < "԰" else 3


def oddity(text: str) -> int:
    """Signs in `text` of a wrong encoding that do not depend on any other text.

    Control characters, a capital after a small letter, letters of two scripts side by side, a symbol between
    letters or other symbols, each with a character beyond ASCII; and Latin words of three letters or more without an ASCII letter.
    """
    if text.isascii():
        return 0
    signs = sum("\x80" <= c <= "\x9f" for c in text)
    for a, b in zip(text, text[1:]):
        if (a > "\x7f" or b > "\x7f") and a.isalpha() and b.isalpha():
            signs += (a.islower() and b.isupper()) or _script(a) != _script(b)
    symbol = [c > "\x9f" and c not in BETWEEN and unicodedata.category(c)[0] not in "LMZ" for c in text]
    inner = [s or c.isalpha() for s, c in zip(symbol, text)]
    signs += sum(s and before and after for before, s, after in zip(inner, symbol[1:], inner[2:]))
    return signs + sum(len(x) >= 3 and all(c > "\x7f" and _script(c) == 0 for c in x) for x in LETTERS.findall(text))


@lru_cache(1 << 16)
def _single(clean: str, garbled: str) -> frozenset[tuple[str, str]]:
    """The pairs of single-byte encodings that make one character of another: both have it at the same byte."""
    at: dict[int, list[str]] = {}
    for codec in SINGLE_BYTE:
        if (byte := writes(codec).get(garbled)) is not None:
            at.setdefault(byte, []).append(codec)
    return frozenset((s, r) for s in SINGLE_BYTE for r in at.get(writes(s).get(clean), ()) if r != s)


@lru_cache(1 << 16)
def _wider(clean: str, garbled: str) -> frozenset[tuple[str, str]]:
    """The pairs with a source of several bytes a character that make one run of another."""
    sources = (UTF8, *DOUBLE_BYTE) if len(garbled) == 2 * len(clean) else (UTF8,)
    return frozenset((s, r) for s in sources for r in SINGLE_BYTE if "".join(image(c, s, r) or LOST for c in clean) == garbled)


def _aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The differing runs beyond ASCII at the same places of two texts; none where the texts are not equal but for these."""
    runs = [[(m.start(), m.group()) for m in RUN.finditer(t)] for t in (garbled, clean)]
    if len(runs[0]) != len(runs[1]):
        return []
    shift, pairs = 0, []
    for (at, g), (to, c) in zip(*runs):
        if at - to != shift:
            return []
        shift += len(g) - len(c)
        if g != c:
            pairs.append((g, c))
    return [] if any(LOST in g or LOST in c for g, c in pairs) else pairs


def explain(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The mistakes (stored in, read in) that turn `clean` into `garbled`: the same text but for what is beyond ASCII.

    Runs beyond ASCII are aligned by their places in the stripped text. Runs that differ must all follow from one
    mistake; between single-byte encodings they align character by character.
    """
    pairs = _aligned(garbled, clean)
    if pairs and all(len(g) == len(c) for g, c in pairs):
        known = [_single(a, b) for g, c in pairs for a, b in zip(c, g) if a != b]
        unmoved = {a for g, c in pairs for a, b in zip(c, g) if a == b}
    elif pairs and all(len(g) > len(c) for g, c in pairs):
        known, unmoved = [_wider(c, g) for g, c in pairs], set()
    else:
        return []
    return sorted((s, r) for s, r in frozenset.intersection(*known) if all(image(c, s, r) == c for c in unmoved))


def pieces(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The transformation of characters that turns `clean` into `garbled`, as (garbled piece, clean character).

    Aligned runs of one length go character by character, those of k times the length by pieces of k. None unless one
    character has one image in both directions, or where the garbled text is not the odder one (`oddity`).
    """
    pairs = _aligned(garbled, clean)
    if not pairs or any(len(g) % len(c) for g, c in pairs):
        return []
    found = {(g[i * k : (i + 1) * k], a) for g, c in pairs for k in [len(g) // len(c)] for i, a in enumerate(c)}
    if len({g for g, _ in found}) < len(found) or len({c for _, c in found}) < len(found):
        return []
    return sorted(found) if oddity(garbled) > oddity(clean) else []


def _twin(garbled: str, clean: str) -> list[tuple[str, str, str, str]]:
    """What a pair of twins shows, as (stored, read, garbled piece, clean piece): pairs of encodings, else pieces."""
    found = [(s, r, "", "") for s, r in explain(garbled, clean)]
    return found or [("", "", g, c) for g, c in pieces(garbled, clean)]


def explain_double(garbled: str, clean: str) -> list[tuple[str, str]]:
    """`explain` for sources of up to two bytes a character, whose second bytes may be ASCII: texts as wholes."""
    stored = [s for s in DOUBLE_BYTE if all(image(c, s, "latin_1") for c in clean)]
    return [(s, r) for s in stored for r in SINGLE_BYTE if garble(clean, s, r) == garbled]


def _shown(found: list[tuple[str, str, str, str]]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*found)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["stored", "read", "garbled", "clean"])


def _explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, top, more, word in zip(*(c.to_pylist() for c in batch.columns)):
            gain, longer = oddity(text) - oddity(top), len(text) - len(top)
            twins = []
            if more > 0 or longer > 0 or gain >= 0:
                twins += _twin(text, top)
            if longer < 0 or gain < 0 or (more == gain == longer == 0):
                twins += _twin(top, text)
            found += [x for x in twins if x[0] == UTF8 or not word]
        yield _shown(found)


def _doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _shown([(s, r, "", "") for text, top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s, r in explain_double(text, top)])


SHOWN = "stored string, read string, garbled string, clean string"


def learn_mistakes(texts: DataFrame, words: DataFrame) -> tuple[list[Mistake], str]:
    """The mistakes that near-twins of `texts` (text) show, most supported first, and the characters of usual words.

    `words` (word, n) are their distinct words with the number of texts.
    Passages are counted over all texts. Those that are equal but for characters beyond ASCII are twins; within each
    such class every other passage is aligned with the one in most texts alone, so a class of any size is linear. That
    one counts as clean, but where it is the longer or odder (`oddity`) it counts as garbled too; equals count both ways,
    and `garbled_words` finds the direction from all words. Classes are formed twice: by the stripped text, and by it and
    the lengths of what was stripped; passages alone in theirs leave first. Words with two ASCII letters are twins in the
    same way, but show only UTF-8 read otherwise, whose form can't be chance. Passages of East Asian letters are twins
    of others with the same text outside words and as many bytes. The driver gets one row per pair of encodings, per
    garbled piece that LEAST_PAIRS twins show, and per character.
    """
    once = F.array_distinct(F.regexp_extract_all("text", F.lit(PASSAGES_IN), F.lit(0)))
    counted = texts.select(F.explode(once).alias("passage")).where(_beyond_ascii("passage")).groupBy("passage").agg(F.count(F.lit(1)).alias("n"))
    bare = F.regexp_replace("passage", BEYOND, "")
    named = bare.rlike("[A-Za-z0-9]")
    shape = F.array_join(F.transform(F.regexp_extract_all("passage", F.lit(BEYOND), F.lit(0)), lambda r: F.length(r).cast("string")), ",")
    # passages without any ASCII letter or digit are told by shape only
    counted = cut(counted.select("passage", "n", F.xxhash64(bare, F.when(~named, shape)).alias("class")))
    classes = cut(counted.groupBy("class").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("class"))
    several = join_counted(counted, classes, ["class"], "left_semi").select("passage", "n", bare.alias("bare"), shape.alias("shape"), named.alias("named"))
    spelt = words.select(F.col("word").alias("passage"), "n", F.regexp_replace("word", BEYOND, "").alias("bare"), F.lit("word").alias("shape"), F.lit(True).alias("named"))
    rows = several.union(spelt.where(F.col("bare").rlike("[A-Za-z].*[A-Za-z]"))).withColumn("word", F.col("shape") == "word")
    rows = cut(rows)
    variants, usual = F.count(F.lit(1)).alias("variants"), F.max(F.struct("n", F.col("passage").alias("clean"))).alias("top")
    alike = rows.groupBy("word", "bare", "named", "shape").agg(variants, usual)
    equal = alike.where("named").groupBy("word", "bare").agg(F.sum("variants").alias("all_variants"), F.max("top").alias("all_top"))
    tops = alike.join(equal, ["word", "bare"], "left").where("variants > 1 or all_variants > 1")
    tops = cut(tops.select("word", "bare", "shape", F.array_distinct(F.array_compact(F.array("top", "all_top"))).alias("tops")))
    pairs = join_counted(rows, tops, ["word", "bare", "shape"], "inner").select("word", "passage", "n", F.explode("tops").alias("top")).where("passage <> top.clean")
    shown = pairs.select("passage", "top.clean", (F.col("top.n") - F.col("n")).alias("more"), "word").mapInArrow(_explained, SHOWN)
    in_east, east = F.col("passage").rlike(EAST), []
    if not words.where(F.col("word").rlike(EAST)).isEmpty():
        outside = F.regexp_replace("passage", r"[@-~]*+\P{ASCII}[^\x00-\x3F]*+", "").alias("outside")
        size = F.length("passage") + F.when(in_east, F.length(F.regexp_replace("passage", r"\p{ASCII}+", ""))).otherwise(0)
        sized = counted.select("passage", "n", outside, size.alias("bytes"), in_east.alias("east"))
        east = [cut(sized.where("east").groupBy("outside", "bytes").agg(usual).select("outside", "bytes", "top.clean"))]
        shown = shown.union(join_counted(sized.where("not east"), east[0], ["outside", "bytes"], "inner").select("passage", "clean").mapInArrow(_doubled, SHOWN))
    mistakes = shown.groupBy(*SHOWN.replace(" string", "").split(", ")).count().where((F.col("stored") != "") | (F.col("count") >= LEAST_PAIRS)).collect()
    order = {c: i for i, c in enumerate((UTF8, *SINGLE_BYTE, *DOUBLE_BYTE))}
    seen = sorted(((r["stored"], r["read"], r["count"]) for r in mistakes if r["stored"]), key=lambda x: (x[0] != UTF8, -x[2], order[x[0]], order[x[1]]))
    usual_text = words.where("n > 1").select(F.explode(F.array_distinct(F.split(F.regexp_replace("word", r"[\x00-\x7f]", ""), ""))).alias("c")).distinct()
    drop_cut(counted, classes, rows, tops, *east)
    learned = learned_pieces([(r["garbled"], r["clean"], r["count"]) for r in mistakes if not r["stored"]])
    return [Mistake(s, r) for s, r, _ in seen] + learned, "".join(r["c"] for r in usual_text.collect())


def learned_pieces(shown: list[tuple[str, str, int]]) -> list[Mistake]:
    """Transformations from (garbled piece, clean piece, twins): the first takes each garbled piece as most twins do, the
    k-th those that have a k-th reading by it, and the rest as the first."""
    ranked: dict[str, list[str]] = {}
    for g, c, _ in sorted(shown, key=lambda x: (-x[2], x[0], x[1])):
        ranked.setdefault(g, []).append(c)
    return [Mistake(pieces=tuple(sorted((g, cs[min(k, len(cs) - 1)] if k < len(cs) else cs[0]) for g, cs in ranked.items()))) for k in range(max(map(len, ranked.values()), default=0))]


def _latin(text: str) -> bool:
    return any(c.isascii() and c.isalpha() for c in text)


def _other(c: str) -> bool:
    """A letter of another alphabet than Latin."""
    return c.isalpha() and c >= "ɐ"


def _restorer(mistakes: list[Mistake], alphabet: str):
    """A function from a word to its candidates (restored, certain, parts, rule, sure): certain ones are the only one of
    their word. Parts are what must be known: the new runs of letters, or, after "=", the whole restored word, if none
    has three letters. Sure ones need no known part: they explain control characters, or are usual letters of two bytes
    each where Latin letters made no word. `rule` is the place of the mistake in the list."""
    clean = {c for c in alphabet if c != LOST and not "\x80" <= c <= "\x9f"}
    readings = [m.read for m in mistakes if m.stored == UTF8]

    def possible(before: str, run: str, decoded: str, after: str) -> bool:
        if any(undo_utf8(decoded, r, possible) != decoded for r in readings):
            return True  # garbled more than once
        if not all(c in clean for c in decoded):
            return False
        letters = [c for c in decoded if c.isalpha()]
        if letters and letters[0].islower() and len(before) > 1 and before[-2:].isascii() and before[-2:].isupper():
            return False
        return not (_latin(before[-1:] + after[:1]) and any(_other(c) for c in letters))

    def telling(before: str, run: str, decoded: str, after: str) -> bool:
        # letters of one other alphabet by themselves may pair up by chance; between Latin letters they don't
        by_chance = all(_other(c) for c in run) and not _latin(before[-1:] + after[:1])
        return not by_chance and possible(before, run, decoded, after)

    def parts(text: str, word: str, least: int) -> list[str]:
        return [x for x in set(LETTERS.findall(text)) - set(LETTERS.findall(word)) if len(x) >= least and not x.isascii()]

    def restore(word: str) -> list[tuple[str, bool, list[str], int, bool]]:
        now, before = word, None
        while now != before:  # each step is shorter: ends when no reading applies any more
            before = now
            for read in readings:
                told = undo_utf8(now, read, telling)
                if told != now:
                    now = undo_utf8(told, read, possible)
        if now != word:
            return [(now, True, [], 0, True)]
        out = {}
        beyond = {c for c in word if c > "\x7f"}
        for rule, m in enumerate(mistakes):
            if m.stored in SINGLE_BYTE and not beyond <= writes(m.read).keys():
                continue
            text = undo_utf8(word, m.read, possible) if m.stored == UTF8 else m.undo(word)
            if text and text != word and text not in out:
                double = m.stored in DOUBLE_BYTE
                usual = all(c.isascii() or c in clean for c in (text[:-1] if double and text[-1] == word[-1] else text))
                if double:
                    sure = usual and len(re.findall(EAST, text)) > 1 and oddity(word) > oddity(text)
                else:
                    sure = m.stored in SINGLE_BYTE and bool(CONTROL.search(word)) and not CONTROL.search(text) and not SEQUENCE.search(word)
                if sure or usual:
                    new = parts(text, word, 1 if m.stored == UTF8 else 3)
                    if new or m.stored != UTF8:
                        out[text] = new or ["=" + text], rule, sure
        return [(text, False, new, rule, sure) for text, (new, rule, sure) in out.items()]

    return restore


def _restored(mistakes: list[Mistake], alphabet: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = _restorer(mistakes, alphabet)
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(word, n, text, certain, parts, rule, oddity(word) - oddity(text), sure) for text, certain, parts, rule, sure in restore(word)]
            columns = [list(c) for c in zip(*rows)] or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "restored", "certain", "parts", "rule", "gain", "sure"])

    return run


def garbled_words(words: DataFrame, mistakes: list[Mistake], alphabet: str) -> DataFrame:
    """(word, restored) of the distinct words (word, n) that a learned mistake explains; n is the number of documents.

    A run that is well-formed UTF-8 and decodes to usual characters is certain. Any other word counts only if every new
    part of its restored form is a known word, in LEAST_KNOWN documents, and if the direction is told: the restored form
    has fewer signs of a wrong encoding (`oddity`), or is KNOWN_RATIO times as common, or, where both forms are equally
    sound, the mistake goes this way in most of its words, by their signs and, if these are even, by which form is the
    commoner. A form without a new run of three letters (punctuation, signs, short words) must be known as a whole, and
    with fewer than three letters it needs the signs, as "à" and Cyrillic "а" are one byte. Control characters that a
    mistake explains are certain. Pieces that no pair of encodings explains need the signs always. So no word depends on how common the mistake is where the signs tell. Of several restored forms that with
    the best known parts counts.
    """
    schema = "word string, n bigint, restored string, certain boolean, parts array<string>, rule int, gain int, sure boolean"
    tried = cut(words.mapInArrow(_restored(mistakes, alphabet), schema))
    certain = tried.where("certain").select("word", "restored")
    letters = words.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(r"\p{L}++"), F.lit(0)))).alias("part"), "n").where(_beyond_ascii("part"))
    known = letters.groupBy("part").agg(F.sum("n").alias("known"))
    known = known.union(words.select(F.concat(F.lit("="), "word"), "n"))
    asked = tried.where("not certain").select("word", "n", "restored", "rule", "gain", "sure", F.explode("parts").alias("part"), F.size("parts").alias("distinct"))
    is_known = F.col("known") >= LEAST_KNOWN
    judged = cut(
        asked.join(known, "part", "left")
        .where(is_known | F.col("sure"))
        .groupBy("word", "n", "restored", "rule", "gain", "distinct", "sure")
        .agg(F.count_if(is_known).alias("good"), F.min(F.when(is_known, F.col("known"))).alias("known"), F.max(F.col("part").startswith("=")).alias("whole"))
        .where("good = distinct or sure")
    )
    # one row per learned mistake
    ways = judged.where("good = distinct").groupBy("rule").agg(F.sum(F.signum("gain")).alias("signs"), F.sum(F.signum(F.col("known") - F.col("n"))).alias("counts"))
    onward = ways.select("rule", ((F.col("signs") > 0) | ((F.col("signs") == 0) & (F.col("counts") > 0))).alias("onward"))
    short = F.col("whole") & ~F.col("restored").rlike(r"\p{L}.*\p{L}.*\p{L}")
    even = (F.col("known") > KNOWN_RATIO * F.col("n")) | ((F.col("gain") == 0) & F.col("onward"))
    learned = F.col("rule") >= sum(not m.pieces for m in mistakes)  # those come last
    told = F.col("sure") | (F.col("gain") > 0) | (~short & even & ~learned)
    rank = F.struct(F.col("good") == F.col("distinct"), F.coalesce("known", F.lit(0)), F.when(F.col("good") < F.col("distinct"), -F.col("rule")), "restored")
    best = judged.join(F.broadcast(onward), "rule", "left").where(told).groupBy("word").agg(F.max_by("restored", rank).alias("restored"))
    return certain.union(best)


def _with_gaps(words: DataFrame) -> DataFrame:
    """Words without what is beyond ASCII, and the places where that stood."""
    gaps = F.regexp_replace(F.regexp_replace("word", BEYOND, "\x00"), r"[\x01-\x7F]", ".")
    return words.withColumns({"bare": F.regexp_replace("word", BEYOND, ""), "gaps": gaps})


def lost_words(words: DataFrame, garbled: DataFrame) -> DataFrame:
    """(word, restored) of words with replacement characters, by the most frequent sound word that is equal without them."""
    sound = words.where(~F.col("word").contains(LOST)).join(garbled.select("word"), "word", "left_anti")
    best = _with_gaps(sound).where("length(bare) > 1").groupBy("bare", "gaps").agg(F.max(F.struct("n", F.col("word").alias("restored"))).alias("top"))
    lost = _with_gaps(words.where(F.col("word").contains(LOST)))
    return lost.join(best, ["bare", "gaps"]).select("word", F.col("top.restored").alias("restored"))


def apply_fixes(text: str, fixes: dict[str, str], mistakes: list[Mistake]) -> str:
    """`text` with its known words restored, and the rest of a passage by the mistake that most of its words share.

    Short words between restored ones can't be told by themselves; they follow if more words of their passage are
    restored than not, and by one mistake. A mistake of two bytes a character takes the whole passage with it, if that
    decodes without rest, as second bytes may be signs that end a word.
    """

    def passage(match: re.Match) -> str:
        words = {w for w in WORD.findall(match.group()) if not w.isascii()}
        mended = {w: fixes[w] for w in words if w in fixes}
        rest = [w for w in words if w not in fixes and LOST not in w]
        most = rest and len(mended) > len(rest)
        for m in mistakes if mended else ():
            double = m.stored in DOUBLE_BYTE
            if (most or double) and m.stored != UTF8 and all(m.undo(w) == r for w, r in mended.items()):
                if double and not CONTROL.search(whole := m.undo(match.group()) or LOST) and LOST not in whole:
                    return whole
                if most:
                    mended |= {w: r for w in rest if (r := m.undo(w))}
                    break
        return WORD.sub(lambda m: mended.get(m.group(), m.group()), match.group())

    return PASSAGE.sub(passage, text)


class WrongEncodings:
    """The records of (doc_id, text) with text decoded in a wrong encoding, and their restored text.

    Mistakes are learned from near-twins among the passages (`learn_mistakes`), applied to the distinct words of all
    texts (`garbled_words`), and carried back to the records that hold those words; a replacement character is a case
    by itself. One pass gives each record's words beyond ASCII; they are written once, and what they are needed for
    later starts there. Copies are told by the hashes of their texts: work on words is shared by all records that hold
    them, and counts are over texts, not over their copies. Null and empty texts, ASCII texts and HTML entities are no
    cases; repeated rows are one case; a null id is no record.
    """

    def __init__(self, documents: DataFrame):
        self.docs = documents.select(F.col("doc_id").alias("doc"), "text").where("doc_id is not null and text is not null")
        beyond = self.docs.where(_beyond_ascii("text"))
        hashed = beyond.withColumn("hash", F.xxhash64("text"))
        words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS_IN), F.lit(0)))
        held = cut(hashed.select("doc", "hash", words.alias("words")))
        again = F.when(F.count(F.lit(1)) > 1, F.min("doc")).alias("first")
        copies = cut(held.groupBy("hash").agg(again).where("first is not null"))

        def without_copies(rows: DataFrame) -> DataFrame:
            return join_counted(rows, copies, ["hash"], "left").where("first is null or doc = first")

        each = F.explode("words").alias("word")
        self.held = held.select("doc", each)
        self.words = cut(without_copies(held).select(each).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        self.mistakes, self.alphabet = learn_mistakes(without_copies(hashed), self.words)
        drop_cut(copies)
        self.garbled = cut(garbled_words(self.words.where(~F.col("word").contains(LOST)), self.mistakes, self.alphabet))

    def found(self) -> DataFrame:
        """(doc): the records with a garbled word or a replacement character."""
        bad = cut(self.garbled.select("word").union(self.words.where(F.col("word").contains(LOST)).select("word")))
        return join_counted(self.held, bad, ["word"], "left_semi").select("doc").distinct()

    def restored(self) -> DataFrame:
        """(doc, restored, complete): `complete` is false where a replacement character stays."""
        lost = self.words.where(F.col("word").contains(LOST)).select("word").join(lost_words(self.words, self.garbled), "word", "left")
        fixes = cut(self.garbled.union(lost))
        mend = F.collect_set(F.when(F.col("restored").isNotNull(), F.struct("word", "restored")))
        cases = cut(join_counted(self.held, fixes, ["word"], "inner").groupBy("doc").agg(mend.alias("fixes")))
        kind, mistakes = self.docs.schema["doc"].dataType.simpleString(), self.mistakes

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [apply_fixes(t, {f["word"]: f["restored"] for f in fixes}, mistakes) for t, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([LOST not in t for t in texts])], ["doc", "restored", "complete"])

        broken = join_counted(self.docs, cases, ["doc"], "inner").dropDuplicates(["doc", "text"])
        return broken.select("doc", "text", "fixes").mapInArrow(apply, f"doc {kind}, restored string, complete boolean")
