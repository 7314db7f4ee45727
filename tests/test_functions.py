import pytest
from pyspark.sql import functions as F

from cantrix.functions import text as T
from cantrix.functions import vector as V
from cantrix.functions.numbers import spelled


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "key"),
    [("kedeng", "ketenk"), ("GEDENGEDENG", "ketenketenk"), ("koffie", "kofi"), ("oe", "o"), ("oeh", "o"), ("ooh", "o"), ("oh", "o"), ("box", "poks"), ("", ""), ("…", "")],
)
def test_sound_key(spark, word, key):
    assert one(spark, T.sound_key(F.lit(word))) == key


def test_sound_key_joins_words(spark):
    assert one(spark, T.sound_key(F.lit("koffie thee"))) == one(spark, T.sound_key(F.lit("koffiethee")))


def test_sound_key_spells_numbers(spark):
    assert one(spark, T.sound_key(F.lit("45"), spell_numbers=True)) == one(spark, T.sound_key(F.lit("vijfenveertig")))


@pytest.mark.parametrize(("key", "unit"), [("ketenketen", "keten"), ("ketenketenk", "keten"), ("ketenk", "ketenk"), ("a", "a"), ("aa", "a"), ("", "")])
def test_folded(spark, key, unit):
    assert one(spark, T.folded(F.lit(key))) == unit


@pytest.mark.parametrize(("a", "b", "low", "high"), [("ketenk", "ketenketenk", 0.75, 1), ("kofi", "ketenk", 0, 0.65), ("kofi", "kofi", 1, 1), ("", "kofi", 0, 0), ("kofi", "kofite", 4 / 6, 4 / 6)])
def test_similarity(spark, a, b, low, high):
    got = one(spark, T.key_similarity(F.lit(a), F.lit(b)))
    assert low - 1e-9 <= got <= high + 1e-9


@pytest.mark.parametrize(("word", "norm"), [("Koffie!", "koffie"), (" Oe, ", "oe"), ("'s-nachts", "s-nachts"), ("...", "")])
def test_normalize(spark, word, norm):
    assert one(spark, T.normalize_word(F.lit(word))) == norm


@pytest.mark.parametrize(("n", "nl", "en"), [(0, "nul", "zero"), (45, "vijfenveertig", "forty five"), (100, "honderd", "one hundred"), (1999, "duizendnegenhonderdnegenennegentig", "one thousand nine hundred ninety nine"), (2_000_001, "tweemiljoeneen", "two million one")])
def test_spelled(spark, n, nl, en):
    assert one(spark, spelled(F.lit(n), "nl")) == nl
    assert one(spark, spelled(F.lit(n), "en")) == en


def test_vocalise_and_script(spark):
    assert [one(spark, T.is_vocalise(F.lit(x))) for x in ("la-la", "Na", "banana", "mama", "")] == [True, True, False, False, False]
    assert [one(spark, T.script_of(F.lit(x))) for x in ("abc", "слово", "말", "aあ")] == [None, "ru", "ko", "ja"]


def test_clock_and_version(spark):
    assert one(spark, T.clock(F.lit(75.25))) == "1:15.2"
    assert one(spark, T.version_key(F.lit("1.12.x"))) == [1, 12, 0]
    assert one(spark, T.duration_text(F.lit(3725.0))) == "1 h 02 min"


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (1.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0)))
    assert one(spark, V.cosine(a, a)) == 1.0
    assert one(spark, V.cosine(a, b)) == 0.0
    assert one(spark, V.distortion_ratio(a, a)) == 100.0
    assert one(spark, V.rms(F.slice(a, 1, 0))) == 0.0
    assert one(spark, V.nearest_of(F.lit(None).cast("double"), [1.0, 2.0], 9.0)) == 9.0
