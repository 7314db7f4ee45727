"""Words, sound keys and their similarity as column expressions."""

from __future__ import annotations

from functools import lru_cache, reduce
from unicodedata import category

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sound key.
DIGRAPHS = (("sch", "sk"), ("ch", "k"), ("aa", "a"), ("ee", "e"), ("oo", "o"), ("uu", "u"), ("ie", "i"), ("oe", "u"), ("eu", "u"), ("ui", "u"), ("ou", "o"), ("au", "o"), ("ij", "i"), ("ei", "i"))
DROPPED = "hr"
LETTERS = {"b": "p", "d": "t", "g": "k", "c": "k", "q": "k", "v": "f", "w": "f", "z": "s", "y": "i", "j": "i", "u": "o"}
#: Vocalises without a meaning.
VOCALISES = ("na", "la", "oh", "ah", "ho", "da", "ba", "hey", "ya", "woah", "wo", "uh", "doo", "ooh", "yeah")
#: First and last code point by script.
SCRIPTS = (("ko", 0xAC00, 0xD7A3), ("ko", 0x1100, 0x11FF), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ru", 0x0400, 0x04FF), ("el", 0x0370, 0x03FF), ("ar", 0x0600, 0x06FF), ("he", 0x0590, 0x05FF), ("th", 0x0E00, 0x0E7F))


def split_words(text: Column) -> Column:
    """Words between white space, in order; empty for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def normalize_word(text: Column) -> Column:
    """Lower case; letters, digits, apostrophes and hyphens, the last two not at the ends."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}'’\-]", "")
    return F.regexp_replace(kept, r"^['’\-]+|['’\-]+$", "")


def normalized(word: str) -> str:
    """``normalize_word`` of one word, outside Spark."""
    if word.isascii() and word.isalnum():
        return word.lower()
    kept = "".join(c for c in word.strip(" ").lower() if c in "'’-" or category(c)[0] in "LN")
    return kept.strip("'’-")


def letters_and_digits(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def is_symbol(text: Column) -> Column:
    """No letter and no digit at all."""
    return ~text.rlike(r"[\p{L}\p{N}]")


def single_spaced(text: Column) -> Column:
    """Lower case with single spaces, for comparing lines."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_pure_number(text: Column) -> Column:
    """Digits are all that is left of the letters and digits."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "").rlike(r"^[0-9]+$")


def hyphen_parts(text: Column) -> Column:
    """Parts between hyphens, of letters, digits and apostrophes, none empty."""
    return F.filter(F.transform(F.split(text, "-"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}'’]", "")), lambda x: x != "")


def sound_key(text: Column, spell_numbers: bool = False) -> Column:
    """Key under which words that sound alike when sung are equal.

    Folding looks at what is left after dropped letters went, and never at an x, which sounds as two.
    """
    if spell_numbers:
        from .numbers import spelled

        digits = F.regexp_replace(text, r"[^0-9]", "")
        text = F.when(is_pure_number(text) & (F.length(digits) <= 9), spelled(digits.try_cast("bigint"), "nl")).otherwise(text)
    s = F.regexp_replace(F.lower(text), r"[^\p{L}]", "")
    s = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), DIGRAPHS, s)
    s = F.translate(s, "".join(LETTERS) + DROPPED, "".join(LETTERS.values()))
    return F.replace(F.regexp_replace(s, r"([^x])\1+", "$1"), F.lit("x"), F.lit("ks"))


def sound_forms(text: Column) -> Column:
    """Sound keys of a word: one, or those of a number spelled in Dutch and in English."""
    from .numbers import spelled

    digits = F.regexp_replace(text, r"[^0-9]", "")
    number = digits.try_cast("bigint")
    forms = F.array_distinct(F.array(sound_key(spelled(number, "nl")), sound_key(spelled(number, "en"))))
    return F.when(is_pure_number(text) & (F.length(digits) <= 9), forms).otherwise(F.array(sound_key(text)))


@lru_cache(maxsize=200_000)
def sound_of(word: str) -> str:
    """``sound_key`` of one word, outside Spark."""
    s = "".join(c for c in word.lower() if c.isalpha())
    for a, b in DIGRAPHS:
        s = s.replace(a, b)
    s = s.translate(str.maketrans(LETTERS) | dict.fromkeys(map(ord, DROPPED)))
    return "".join(c for i, c in enumerate(s) if c == "x" or i == 0 or s[i - 1] != c).replace("x", "ks")


def letters_and_spaces(text: Column) -> Column:
    """Lower case; letters and what ends a word."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\s]+", "")


def sounds_in(texts: list[str], between: str | None = None) -> list[list[str]]:
    """``sound_key`` of the words of each text of ``letters_and_spaces``, in order, for all texts in one operation.

    Empty keys are left out, but not where what stands ``between`` two words is given.
    """
    s = reduce(lambda s, p: s.replace(*p), DIGRAPHS, "\0".join(texts))
    table = np.arange(128, dtype=np.uint32)
    for a, b in LETTERS.items():
        table[ord(a)] = ord(b)
    table[[ord(c) for c in DROPPED]] = 127
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    codes = np.where(codes < 128, table[codes & 127], codes)
    codes = codes[codes != 127]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != codes[:-1]) | (codes[1:] == ord("x")) | (codes[1:] <= 32)
    return [x.split(between) for x in codes[keep].tobytes().decode("utf-32-le").replace("x", "ks").split("\0")]


def folded(key: Column) -> Column:
    """The shortest unit that the key repeats at least twice, its start may follow; else the key."""
    units = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(key) / 2).cast("int"))), lambda n: (n * 2 <= F.length(key)) & (F.substring(key, n + 1, F.length(key)) == F.substring(key, F.lit(1), F.length(key) - n)))
    return F.coalesce(F.substring(key, F.lit(1), F.get(units, F.lit(0))), key)


def key_similarity(a: Column, b: Column, fold_a: Column | None = None, fold_b: Column | None = None) -> Column:
    """1 for equal keys, 0.95 when equal after folding, the share of a contained key, else 1 - distance / longest."""
    x, y = fold_a if fold_a is not None else folded(a), fold_b if fold_b is not None else folded(b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = F.when(F.length(x) <= F.length(y), F.contains(y, x)).otherwise(F.contains(x, y))
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
        .when(a == b, 1.0)
        .when(x == y, 0.95)
        .when((short >= 3) & inside, short / long)
        .otherwise(1.0 - F.levenshtein(x, y) / long)
    )


def is_vocalise(text: Column) -> Column:
    """A vocalise or one of them repeated."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "").rlike("^(?:" + "|".join(f"(?:{v})+" for v in VOCALISES) + ")$")


def script_of(text: Column) -> Column:
    """Script of the first letter that belongs to one of the listed scripts, else null."""
    every = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for _, low, high in SCRIPTS)
    first = F.regexp_extract(text, f"([{every}])", 1)
    out = F.lit(None).cast("string")
    for name, low, high in reversed(SCRIPTS):
        out = F.when(first.rlike(f"[\\x{{{low:X}}}-\\x{{{high:X}}}]"), F.lit(name)).otherwise(out)
    return out


def safe_name(text: Column) -> Column:
    """Letters, digits, dot, hyphen and underscore; runs of others become one underscore."""
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._\-]+", "_")


def content_id(text: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-1."""
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, length)


def version_key(text: Column) -> Column:
    """Dotted version as numbers, which compare part by part."""
    return F.transform(F.split(text, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def version_number(text: Column) -> Column:
    """Middle number of a dotted version, or null."""
    return F.get(F.split(text, r"\."), F.lit(1)).try_cast("int")


def clock(seconds: Column) -> Column:
    """Minutes and seconds with one decimal, as m:ss.s."""
    tenths = F.bround(seconds * 10).cast("bigint")
    minutes, rest = (tenths / 600).cast("bigint"), tenths % 600
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad((rest / 10).cast("bigint").cast("string"), 2, "0"), F.lit("."), (rest % 10).cast("string"))


def syllable_count(text: Column) -> Column:
    """Groups of vowels, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(text), F.lit("[aeiouyáéíóúàèêëïöüäæøåœ]+")))


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes or hours in short words."""
    s = F.bround(seconds).cast("bigint")
    minutes = (s / 60).cast("bigint")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat((s / 3600).cast("bigint").cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min")))
    )
