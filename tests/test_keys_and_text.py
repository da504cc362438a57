"""Literal cases of URL keys, text measures, dates and small measures."""

import pytest
from pyspark.sql import functions as F

from sitelode.functions import dates, measures, text, urls


def each(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_host_key(spark):
    one = ["Kiosk.Test", "www.kiosk.test", "kiosk.test.", " WWW.kiosk.test. ", "http://www.kiosk.test/menu?day=mon#soup", "kiosk.test/menu", "http://kiosk.test:9000/", "sc-domain:kiosk.test"]
    assert set(each(spark, urls.host_key, one)) == {"kiosk.test"}
    assert each(spark, urls.host_key, ["https://a.b.kiosk.test/", "wwwkiosk.test"]) == ["a.b.kiosk.test", "wwwkiosk.test"]
    assert set(each(spark, urls.host_key, ["", "two words", "http://", None])) == {None}


def test_url_key(spark):
    one = ["http://www.kiosk.test/menu/", "https://KIOSK.test/menu#soup", "https://kiosk.test:443/menu//", "http://kiosk.test:80/menu"]
    assert set(each(spark, urls.url_key, one)) == {"kiosk.test/menu"}
    others = {"http://kiosk.test:9000/menu": "kiosk.test:9000/menu", "http://kiosk.test": "kiosk.test/", "http://kiosk.test/menu/?day=2": "kiosk.test/menu?day=2", "http://kiosk.test/Menu?": "kiosk.test/Menu", "tel:123": None}
    assert each(spark, urls.url_key, list(others)) == list(others.values())


def test_path_key(spark):
    cases = {"http://kiosk.test/menu/?day=1#x": "/menu", "/menu/": "/menu", "/menu?x": "/menu", "http://kiosk.test": "/", "/": "/", "/Menu": "/Menu", "menu": None, "": None}
    assert each(spark, urls.path_key, list(cases)) == list(cases.values())
    assert each(spark, urls.path_key, ["/k%C3%A4se", "/käse", "/1%2F2"]) == ["/käse", "/käse", "/1%2F2"]


def test_landing_and_property(spark):
    assert each(spark, lambda v: urls.landing_url("https://kiosk.test", v), ["/", "/m?d=1", "m", ""]) == ["https://kiosk.test/", "https://kiosk.test/m?d=1", None, None]
    inside = lambda p: lambda v: urls.in_property(v, F.lit(p))
    assert each(spark, inside("sc-domain:kiosk.test"), ["http://x.kiosk.test/1", "https://kiosk.test", "https://mykiosk.test"]) == [True, True, False]
    assert each(spark, inside("https://kiosk.test/de/"), ["https://kiosk.test/de/2", "http://kiosk.test/de/2"]) == [True, False]


def test_words_and_sentences(spark):
    assert each(spark, lambda v: F.size(text.words(v)), ["Soup of the day: leek & potato!", "", " - ", "números: 3"]) == [6, 0, 0, 2]
    assert each(spark, text.sentences, ["Soup. Is it hot? Yes!", "  \n ", "...", "plain"]) == [3, 0, 1, 1]
    assert each(spark, text.paragraphs, ["Soup.\n \nBread.", " ", "x"]) == [2, 0, 1]
    assert each(spark, text.is_blank, ["", " \t", "x"]) == [True, True, False]


def test_syllables(spark):
    """A silent ending goes first, then one last y; three letters are one syllable; punctuation stays part of a word."""
    words = {"tea": 1, "happy": 1, "city": 1, "every": 2, "yellow": 2, "baked": 1, "plates": 1, "queue": 2, "rhythms": 1, "city,": 2, "potato": 3, "- &": 0, "a an the": 3}
    assert each(spark, text.syllables, list(words)) == list(words.values())
    assert each(spark, text.syllables, [" ".join(words)]) == [sum(words.values())]


def test_tokens(spark):
    assert each(spark, text.fold, ["Crème Brûlée", "Ñ"]) == ["creme brulee", "n"]
    en = lambda v: text.significant(v, F.lit("en-GB"))
    assert each(spark, en, ["where do I buy the soup of my kiosk", "where is it"]) == [["buy", "soup", "kiosk"], ["where", "is", "it"]]
    assert each(spark, lambda v: text.significant(v, F.lit("es")), ["dónde comer una sopa con pan"]) == [["comer", "sopa", "pan"]]
    assert each(spark, text.significant, ["the sopa of pan y leek"]) == [["sopa", "pan", "leek"]]
    lacks = lambda t: lambda v: text.missing(text.tokens(v), text.tokens(F.lit(t)))
    assert each(spark, lacks("Soups and dishes, hot"), ["hot soup dish", "cold soup cold"]) == [[], ["cold"]]


@pytest.mark.parametrize(("code", "normal"), [("FR-ca", "fr-CA"), ("sr-latn-rs", "sr-Latn-RS"), ("en-001", "en-001"), ("X-DEFAULT", "x-default"), ("french", None), ("pt_pt", "pt-PT"), ("qq", None), ("xx-DE", None), ("", None)])
def test_language_codes(spark, code, normal):
    assert each(spark, text.lang_code, [code]) == [normal]


def test_bare_codes_that_look_like_countries(spark):
    assert each(spark, text.meant_region, ["UK", "se", "uk-UA", "fr"]) == ["en-GB", "sv-SE", None, None]


def test_signals(spark):
    assert each(spark, lambda v: F.regexp_count(v, F.lit(text.STATISTIC)), ["5% of $2,500", "4 out of 9 or 1 de cada 3", "soup"]) == [2, 2, 0]
    assert each(spark, lambda v: text.defines_something(v, F.lit("en")), ["Leek is a plant", "we eat soup"]) == [True, False]
    assert each(spark, lambda v: text.defines_something(v, F.lit("fr")), ["is a x"]) == [None]


def test_entity_density(spark):
    cases = {"We saw Old Salem Road today. Then Ann left!": 4 / 9, "Big. Small. Tall": 0.0, "": 0.0, "so Ómar met R2 X": 1 / 5}
    assert each(spark, text.entity_density, list(cases)) == pytest.approx(list(cases.values()))


def test_dates(spark):
    today = F.lit("2024-03-01").cast("date")
    shown = lambda v: dates.resolve(v, today).cast("string")
    assert each(spark, shown, ["today", "yesterday", "30daysAgo", " 2023-12-31", "tomorrow", "2023-13-01"]) == ["2024-03-01", "2024-02-29", "2024-01-31", "2023-12-31", None, None]
    window = lambda v: dates.hourly_window(v.cast("int"), today)["first"].cast("string")
    assert each(spark, window, ["1", "0", "99"]) == ["2024-03-01", "2024-03-01", "2024-02-21"]
    assert each(spark, lambda v: dates.hour_key(v)["hour"], ["2024-03-01T07:00:00-08:00", "2024-03-01T07:00:00", "2024-03-01"]) == ["07", None, None]
    tier = lambda v: dates.age_tier(v.cast("date"), today)
    assert each(spark, tier, ["2024-02-01", "2022-01-01", "2030-01-01", None]) == ["new", "legacy", "new", "unknown"]
    assert each(spark, lambda v: dates.today_in(dates.PACIFIC, v.cast("timestamp")).cast("string"), ["2024-03-01 06:00:00"]) == ["2024-02-29"]


def test_measures(spark):
    df = spark.createDataFrame([(3.0, 7.0, 7.0, None, 0), (None, 1.0, 2.0, 5.0, 4)], "a double, b double, c double, d double, n int")
    parts = {k: F.col(k) for k in "abc"}
    assert [r.x for r in df.select(measures.largest_part(parts).alias("x")).collect()] == ["b", None]
    assert [r.x for r in df.select(measures.hit_share(F.col("a"), F.col("d")).alias("x")).collect()] == [None, None]
    assert [r.x for r in df.select(measures.earned(F.lit(5), F.lit(1), F.col("n")).alias("x")).collect()] == [None, 1]
    assert df.select(measures.stored(F.lit(1.005) * 100).alias("x")).first().x == 100.5 and df.select(measures.stored(F.lit(float("nan"))).alias("x")).first().x is None
