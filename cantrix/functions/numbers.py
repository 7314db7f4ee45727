"""Whole numbers as they are sung, in two languages, as column expressions over small literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNITS = {
    "nl": "nul een twee drie vier vijf zes zeven acht negen tien elf twaalf dertien veertien vijftien zestien zeventien achttien negentien".split(),
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
}
TENS = {
    "nl": "twintig dertig veertig vijftig zestig zeventig tachtig negentig".split(),
    "en": "twenty thirty forty fifty sixty seventy eighty ninety".split(),
}
NAMES = {"nl": ("honderd", "duizend", "miljoen"), "en": ("hundred", "thousand", "million")}


def _pick(words: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), at.cast("int"))


def _whole(n: Column, by: int) -> Column:
    return F.floor(n / by)


def below_thousand(n: Column, language: str) -> Column:
    """0 to 999; units come before tens in Dutch, and one hundred has no one there."""
    units, tens, hundred = UNITS[language], TENS[language], NAMES[language][0]

    def below_hundred(m: Column) -> Column:
        ten, one = _pick(tens, _whole(m, 10) - 2), _pick(units, m % 10)
        both = F.concat(one, F.lit("en"), ten) if language == "nl" else F.concat_ws(" ", ten, one)
        return F.when(m < 20, _pick(units, m)).when(m % 10 == 0, ten).otherwise(both)

    head, rest = _pick(units, _whole(n, 100)), n % 100
    if language == "nl":
        start = F.concat(F.when(n >= 200, head).otherwise(""), F.lit(hundred))
        large = F.concat(start, F.when(rest > 0, below_hundred(rest)).otherwise(""))
    else:
        start = F.concat_ws(" ", head, F.lit(hundred))
        large = F.when(rest > 0, F.concat_ws(" ", start, below_hundred(rest))).otherwise(start)
    return F.when(n < 100, below_hundred(n)).otherwise(large)


def spelled(n: Column, language: str) -> Column:
    """0 to 999,999,999 in words; null beyond."""
    _, thousand, million = NAMES[language]
    millions, thousands, rest = _whole(n, 1_000_000), _whole(n % 1_000_000, 1000), n % 1000

    def part(k: Column, name: str) -> Column:
        if language == "nl":
            return F.concat(F.when(k > 1, below_thousand(k, language)).otherwise(""), F.lit(name))
        return F.concat_ws(" ", below_thousand(k, language), F.lit(name))

    some = F.array(F.when(millions > 0, part(millions, million)), F.when(thousands > 0, part(thousands, thousand)), F.when((rest > 0) | (n == 0), below_thousand(rest, language)))
    out = F.array_join(F.array_compact(some), "" if language == "nl" else " ")
    return F.when((n >= 0) & (n <= 999_999_999), out)
