"""Texts that came flat or mixed: paragraphs found anew, words written as syllables removed, packed scripts opened, ACE names decoded.

Everything is a column expression. Folds over a text's pieces carry a few numbers and a string of
marks, so they take time linear in the pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .quality import trim


def let(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


# -- paragraphs -------------------------------------------------------------------------------


@dataclass(frozen=True)
class LayoutRules:
    """When a text counts as flat, and where its paragraphs end. Lengths are ours."""

    marks: str = "。！？!?…"
    closers: str = "”』」’\""
    openers: str = "“『「"
    glue: str = ""
    median: int = 300
    single: int = 200
    bare_share: float = 0.9
    least: int = 80
    most: int = 300


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), trim), lambda x: x != "")


def is_flat(text: Column, rules: LayoutRules = LayoutRules()) -> Column:
    """Whether the median line is too long, the only line is long, or nearly no line ends a sentence."""
    ends = f"[{rules.marks}][{rules.closers}]*$"

    def judge(lines):
        sizes = F.array_sort(F.transform(lines, F.length))
        n = F.size(lines)
        bare = F.size(F.filter(lines, lambda x: ~x.rlike(ends)))
        middle = F.get(sizes, F.floor((n - 1) / 2).cast("int"))
        return F.coalesce((n > 0) & ((middle > rules.median) | ((n == 1) & (F.get(sizes, F.lit(0)) > rules.single)) | ((n > 1) & (bare >= n * rules.bare_share))), F.lit(False))

    return let(_lines(text), judge)


def sentence_pieces(text: Column, rules: LayoutRules = LayoutRules()) -> Column:
    """The sentences of a text, line ends ignored, each with its marks and closing quotes; they make up the text again, joined by
    the glue."""
    body = F.array_join(_lines(text), rules.glue)
    found = F.regexp_extract_all(body, F.lit(f"[^{rules.marks}]*+[{rules.marks}]++[{rules.closers}]*+|[^{rules.marks}]++"), 0)
    return F.filter(F.transform(found, trim), lambda x: x != "")


def paragraphs(pieces: Column, rules: LayoutRules = LayoutRules()) -> Column:
    """Sentences put together: a paragraph ends once it has `least` characters and the sentence ended with a mark, before a
    sentence that opens a quotation, or at `most` characters; never inside an open quotation."""
    count = lambda x, marks: F.length(x) - F.length(F.translate(x, marks, ""))
    curly = "".join(c for c in rules.closers if c != '"')
    start = F.struct(F.lit("").alias("breaks"), F.lit(0).alias("size"), F.lit(0).alias("open"), F.lit(0).alias("straight"), F.lit(False).alias("ended"))

    def step(held, x):
        free = (held["open"] == 0) & (held["straight"] == 0)
        opens = x.rlike(f"^[{rules.openers}\"]")
        ends = (held["size"] > 0) & free & ((held["size"] >= rules.most) | ((held["size"] >= rules.least) & held["ended"]) | opens)
        return F.struct(
            F.concat(held["breaks"], F.when(ends, "1").otherwise("0")).alias("breaks"),
            (F.when(ends, 0).otherwise(held["size"]) + F.length(x)).alias("size"),
            F.greatest(held["open"] + count(x, rules.openers) - count(x, curly), F.lit(0)).alias("open"),
            ((held["straight"] + count(x, '"')) % 2).alias("straight"),
            x.rlike(f"[{rules.marks}][{rules.closers}]*$").alias("ended"),
        )

    def built(parts):
        breaks = F.split(F.aggregate(parts, start, step, lambda held: held["breaks"]), "")
        before = lambda marks, i: F.when(F.get(marks, i) == "1", "\n\n").when(i > 0, rules.glue).otherwise("")
        return let(breaks, lambda marks: F.array_join(F.transform(parts, lambda x, i: F.concat(before(marks, i), x)), ""))

    return let(pieces, built)


def resegmented(text: Column, rules: LayoutRules = LayoutRules()) -> Column:
    """A flat text in paragraphs; any other as it is. Applied again it changes nothing."""
    return F.when(is_flat(text, rules), paragraphs(sentence_pieces(text, rules), rules)).otherwise(text)


# -- syllables --------------------------------------------------------------------------------

#: The syllables of the romanisation, by initial.
SYLLABLES = {
    "": "a ai an ang ao e ei en eng er o ou",
    "b": "a ai an ang ao ei en eng i ian iao ie in ing o u",
    "p": "a ai an ang ao ei en eng i ian iao ie in ing o ou u",
    "m": "a ai an ang ao e ei en eng i ian iao ie in ing iu o ou u",
    "f": "a an ang ei en eng o ou u",
    "d": "a ai an ang ao e ei en eng i ian iao ie ing iu ong ou u uan ui un uo",
    "t": "a ai an ang ao e eng i ian iao ie ing ong ou u uan ui un uo",
    "n": "a ai an ang ao e ei en eng i ian iang iao ie in ing iu ong ou u uan uo ü üe",
    "l": "a ai an ang ao e ei eng i ia ian iang iao ie in ing iu ong ou u uan un uo ü üe",
    "g": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "k": "a ai an ang ao e en eng ong ou u ua uai uan uang ui un uo",
    "h": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "j": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "q": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "x": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "zh": "a ai an ang ao e ei en eng i ong ou u ua uai uan uang ui un uo",
    "ch": "a ai an ang ao e en eng i ong ou u ua uai uan uang ui un uo",
    "sh": "a ai an ang ao e ei en eng i ou u ua uai uan uang ui un uo",
    "r": "an ang ao e en eng i ong ou u uan ui un uo",
    "z": "a ai an ang ao e ei en eng i ong ou u uan ui un uo",
    "c": "a ai an ang ao e en eng i ong ou u uan ui un uo",
    "s": "a ai an ang ao e en eng i ong ou u uan ui un uo",
    "y": "a an ang ao e i in ing o ong ou u uan ue un",
    "w": "a ai an ang ei en eng o u",
}
#: Vowels with tone marks, and without.
TONED, UNTONED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ", "aaaaeeeeiiiioooouuuuüüüü"
#: Words that are syllables by chance, a parameter.
ENGLISH = ("banana", "bane", "change", "china", "finance", "gene", "lane", "line", "machine", "mine", "more", "name", "nine", "range", "same", "shine", "sine", "tense", "tone", "wine", "women", "you")
WORD = f"[A-Za-zÀ-ÖØ-öø-ɏ{TONED}]+"


def all_syllables() -> list[str]:
    """Longest first."""
    return sorted((a + b for a, finals in SYLLABLES.items() for b in finals.split()), key=lambda s: (-len(s), s))


#: No run of syllables has any of these: consonants that a vowel must follow, and other characters.
_NEVER = "[bpmfdtlkjqxywh](?![aeiouü])|[zcs](?![aeiouüh])|[^a-zü]"


def syllables(word: Column, least: int = 2, longest: int = 6) -> Column:
    """The least number of syllables that a word (lower case, tones marked or not) is made of; null if it is no such run.

    An automaton over the letters: it knows, for each of the last `longest` places, in how many syllables it is reached.
    """
    plain = F.translate(F.translate(word, TONED, UNTONED), "v", "ü")
    known = {n: F.lit(" " + " ".join(s for s in all_syllables() if len(s) == n) + " ") for n in range(1, longest + 1)}
    none = 1 << 20

    def run(w):
        def step(held, i):
            ends = [F.when(i >= n, F.when(known[n].contains(F.concat(F.lit(" "), F.substr(w, i - n + 1, F.lit(n)), F.lit(" "))), F.get(held, F.lit(n - 1)) + 1)) for n in range(1, longest + 1)]
            best = F.coalesce(F.least(*[F.coalesce(e, F.lit(none)) for e in ends]), F.lit(none))
            return F.concat(F.array(best), F.slice(held, 1, longest - 1))

        start = F.array(F.lit(0), *[F.lit(none)] * (longest - 1))
        reached = F.aggregate(F.sequence(F.lit(1), F.length(w)), start, step)
        return F.when(F.get(reached, F.lit(0)) < none, F.get(reached, F.lit(0)))

    return F.when(plain.rlike("(?:[aeioungr]|ü)$") & ~plain.rlike(_NEVER), let(plain, run))


def is_syllable_run(word: Column, english: tuple[str, ...] = ENGLISH) -> Column:
    """Whether a word stands for characters: syllables with a tone mark, or two syllables or more that are no English word."""
    low = F.lower(word)
    toned = F.translate(low, TONED, "") != low
    n = syllables(low)
    return F.coalesce(F.when(toned, n >= 1).otherwise(~low.isin(*english) & (n >= 2)), F.lit(False))


#: Words of this length go through the automaton; a pattern would try too many ways of parting them.
LONG_WORD = 40


def _forms(letter: str, plain: bool) -> str:
    """The letters of words that are `letter` in lower case (and, if plain, without their tone and `v`), as a class."""
    bare = str.maketrans(TONED + "v", UNTONED + "ü") if plain else {}
    found = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)) if chr(c).lower().translate(bare) == letter)
    return f"[{found}]" if found else re.escape(letter)


def _spelt(word: str, plain: bool = True) -> str:
    return "".join(_forms(c, plain) for c in word)


def _run_pattern(english: tuple[str, ...]) -> str:
    """What `is_syllable_run` says of words shorter than LONG_WORD, as a pattern: some syllables up to the word's end, with a tone,
    or neither an English word nor one syllable."""
    w = WORD[:-1]
    one = "(?:" + "|".join(f"{_spelt(a)}(?:{'|'.join(_spelt(b) for b in sorted(finals.split(), key=len, reverse=True))})" for a, finals in SYLLABLES.items()) + ")"
    toned = f"(?={w}*?[{''.join(_forms(c, False)[1:-1] for c in TONED)}])"
    known = "|".join(_spelt(x, False) for x in english)
    return f"(?<!{w})(?={one}+(?!{w}))(?!{w}{{{LONG_WORD}}})(?:{toned}|(?!{one}(?!{w})){f'(?!(?:{known})(?!{w}))' if known else ''}){w}++"


def without_syllable_runs(text: Column, english: tuple[str, ...] = ENGLISH) -> Column:
    """Words go by one pattern; long ones, each judged once, by the automaton."""
    w = WORD[:-1]
    short = F.regexp_replace(text, _run_pattern(english), "")
    parts = F.regexp_extract_all(short, F.lit(f"{w}++|[^{w[1:-1]}]++"), 0)

    def kept(ps):
        runs = F.filter(F.array_distinct(ps), lambda x: x.rlike(f"^{w}{{{LONG_WORD},}}$") & is_syllable_run(x, english))
        return let(runs, lambda found: F.array_join(F.filter(ps, lambda x: ~F.array_contains(found, x)), ""))

    return F.when(text.rlike(f"(?<!{w}){w}{{{LONG_WORD}}}"), let(parts, kept)).otherwise(short)


# -- packed scripts ---------------------------------------------------------------------------

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PACKED = r"\}\s*\('((?:[^'\\]++|\\.)*+)',\s*(\d{1,2}),\s*\d+,\s*'((?:[^'\\]++|\\.)*+)'\.split\('\|'\)"


def unpacked(body: Column, least: int = 100) -> Column:
    """The text of a packed script: its words are numbers in base 2 to 62 into a list of words, which they give way to; the script
    is never run. Null if it is none, or gives fewer than `least` characters."""
    part = lambda k: F.regexp_extract(body, f"(?s){_PACKED}", k)
    digits, plain = F.lit(_DIGITS), lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1")

    def opened(p):
        words, base = p["words"], p["base"]

        def value(n, c):
            return F.when((n >= 0) & (F.instr(digits, c) > 0) & (F.instr(digits, c) <= base) & (n < 1 << 40), n * base + F.instr(digits, c) - 1).otherwise(F.lit(-1).cast("long"))

        number = lambda w: F.aggregate(F.split(w, ""), F.lit(0).cast("long"), value)
        meant = lambda w: let(number(w), lambda n: F.when((n >= 0) & (n < F.size(words)), F.nullif(F.get(words, n.cast("int")), F.lit(""))))
        pieces = F.regexp_extract_all(p["text"], F.lit(r"[A-Za-z0-9_]++|[^A-Za-z0-9_]++"), 0)
        text = F.array_join(F.transform(pieces, lambda w: F.when(w.rlike("^[A-Za-z0-9]"), F.coalesce(meant(w), w)).otherwise(w)), "")
        return F.when((base >= 2) & (base <= 62), text)

    parts = F.struct(plain(part(1)).alias("text"), F.coalesce(part(2).try_cast("int"), F.lit(0)).alias("base"), F.split(plain(part(3)), "\\|", -1).alias("words"))
    return let(let(parts, opened), lambda t: F.when(F.length(t) >= least, t))


# -- names ------------------------------------------------------------------------------------


def punycode(label: Column) -> Column:
    """What an ACE label ("xn--...") says, by the decoder of RFC 3492 as a fold over its characters; another label, or one that
    is no valid code, as it is."""
    code = F.substr(F.lower(label), F.lit(5))
    basic = F.regexp_extract(code, "^(.*)-", 1)
    start = F.struct(
        F.filter(F.transform(F.split(basic, ""), lambda c: F.ascii(c)), lambda c: c > 0).alias("out"), F.lit(128).cast("long").alias("n"), F.lit(0).cast("long").alias("i"), F.lit(72).cast("long").alias("bias"),
        F.lit(0).cast("long").alias("old"), F.lit(1).cast("long").alias("w"), F.lit(36).cast("long").alias("k"), F.lit(True).alias("ok"),
    )

    def adapted(delta, length, first):
        delta = F.floor(delta / F.when(first, 700).otherwise(2))
        begun = let(delta, lambda d: F.struct((d + F.floor(d / length)).alias("d"), F.lit(0).cast("long").alias("k")))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(12)), begun, lambda s, _: F.when(s["d"] > 455, F.struct(F.floor(s["d"] / 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s))
        return let(done, lambda s: s["k"] + F.floor(36 * s["d"] / (s["d"] + 38)))

    def step(held, c):
        digit = F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), F.ascii(c) - 22).otherwise(-1)

        def with_digit(x):
            d, h = x["d"], held
            i = h["i"] + d * h["w"]
            t = F.greatest(F.least(h["k"] - h["bias"], F.lit(26)), F.lit(1))
            length = (F.size(h["out"]) + 1).cast("long")
            n = h["n"] + F.floor(i / length)
            at = i % length
            placed = F.concat(F.slice(h["out"], 1, at.cast("int")), F.array(F.least(n, F.lit(0x110000)).cast("int")), F.slice(h["out"], at.cast("int") + 1, F.size(h["out"])))
            ended = F.struct(placed.alias("out"), n.alias("n"), (at + 1).alias("i"), adapted(i - h["old"], length, h["old"] == 0).alias("bias"), (at + 1).alias("old"), F.lit(1).cast("long").alias("w"), F.lit(36).cast("long").alias("k"), (n <= 0x10FFFF).alias("ok"))
            goes_on = F.struct(h["out"].alias("out"), h["n"].alias("n"), i.alias("i"), h["bias"].alias("bias"), h["old"].alias("old"), (h["w"] * (36 - t)).alias("w"), (h["k"] + 36).alias("k"), (i < 1 << 40).alias("ok"))
            bad = F.struct(h["out"].alias("out"), h["n"].alias("n"), h["i"].alias("i"), h["bias"].alias("bias"), h["old"].alias("old"), h["w"].alias("w"), h["k"].alias("k"), F.lit(False).alias("ok"))
            return F.when(~h["ok"] | (d < 0), bad).when(d < t, ended).otherwise(goes_on)

        return let(F.struct(digit.cast("long").alias("d")), with_digit)

    rest = F.when(F.instr(code, "-") > 0, F.regexp_extract(code, "([^-]*)$", 1)).otherwise(code)
    end = F.aggregate(F.filter(F.split(rest, ""), lambda c: c != ""), start, step)
    chars = lambda s: F.array_join(F.transform(s["out"], lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")
    sound = lambda s: s["ok"] & (s["w"] == 1) & ~F.exists(s["out"], lambda c: c.between(0xD800, 0xDFFF))
    return F.when(label.rlike("(?i)^xn--[a-z0-9-]+$"), let(end, lambda s: F.when(sound(s), chars(s)).otherwise(label))).otherwise(label)


def unicode_host(host: Column) -> Column:
    """A host with its ACE labels decoded."""
    return F.array_join(F.transform(F.split(host, "\\.", -1), punycode), ".")
