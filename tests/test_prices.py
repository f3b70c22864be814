"""Prices put together from blocks, and parsers by family, on labels made by hand."""

from pyspark.sql import functions as F

from tagloom.functions.label_text import regular_noise
from tagloom.operators import families, prices
from tagloom.operators.blocks import top_name
from tagloom.operators.labels import RED, REGULAR

BLOCK = "image string, ord int, text string, conf double, box array<struct<x: double, y: double>>, source string"


def blocks(spark, rows):
    """image, ord, text, left, top, right, bottom and perhaps confidence; no place: no box."""
    made = []
    for image, ord_, text, *place in rows:
        left, top, right, bottom, conf = (*place[:4], *(place[4:] or [0.9])) if place else (None, None, None, None, 0.9)
        box = None if left is None else [(float(x), float(y)) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]
        made.append((image, ord_, text, conf, box, None))
    return spark.createDataFrame(made, BLOCK)


ROWS = [
    ("plain", 1, "499", 100, 100, 200, 180), ("plain", 2, "99", 210, 100, 240, 130), ("plain", 3, "1", 60, 100, 90, 180), ("plain", 4, "88", 300, 100, 330, 130),
    ("zero", 1, "029", 0, 0, 60, 60), ("zero", 2, "__kopeks__:1247"), ("none", 1, "1499", 0, 0, 60, 60), ("none", 2, "9", 70, 0, 80, 60),
    ("far", 1, "1499", 0, 0, 60, 60), ("far", 2, "47", 70, 300, 90, 320), ("weak", 1, "1499", 0, 0, 60, 60, 0.3), ("date", 1, "01.02.2024", 0, 0, 60, 60),
    ("tie", 1, "15", 0, 0, 40, 50), ("tie", 2, "16", 100, 0, 140, 50), ("null", 1, None, 0, 0, 1, 1), ("empty", 1, "", 0, 0, 1, 1),
    # beside a label: joined digits, four digits, six digits, too far
    ("joined", 1, "Без карты", 0, 100, 100, 120), ("joined", 2, "1", 110, 100, 120, 120), ("joined", 3, "284", 130, 100, 180, 120), ("joined", 4, "29", 190, 100, 210, 120),
    ("four", 1, "боз карты", 0, 100, 100, 120), ("four", 2, "1284", 110, 100, 180, 120), ("four", 3, "карта 12", 110, 100, 180, 120),
    ("six", 1, "без карты", 0, 100, 100, 120), ("six", 2, "128429", 110, 100, 180, 120), ("six", 3, "777", 400, 100, 440, 120),
    ("away", 1, "без карты", 0, 100, 100, 120), ("away", 2, "1284", 110, 300, 180, 320),
]


def found(df):
    return {r.image: r.price for r in df.collect()}


def test_card_price(spark):
    got = found(prices.card_price(blocks(spark, ROWS)))
    assert (got["plain"], got["zero"], got["tie"]) == (1499.99, 1029.47, 15.16)
    assert not {"none", "far", "weak", "date", "null", "empty"} & set(got)
    assert prices.card_price(blocks(spark, ROWS).limit(0)).count() == 0


def test_price_without_card(spark):
    got = found(prices.price_without_card(blocks(spark, ROWS)))
    assert got == {"joined": 1284.29, "four": 128.04, "six": 1284.29}
    assert prices.price_without_card(blocks(spark, ROWS).limit(0)).count() == 0


def test_red_prices(spark):
    rows = [
        ("own", 1, "без карты", 0, 0, 90, 20), ("own", 2, "1 684,21", 0, 30, 90, 50), ("own", 3, "2000.00", 0, 60, 90, 80),
        ("pair", 1, "9", 0, 0, 10, 10), ("pair", 2, "1315", 60, 20, 100, 40), ("pair", 3, "78", 105, 20, 120, 40), ("pair", 4, "99", 105, 95, 120, 100),
        ("card", 1, "x", 0, 0, 10, 10), ("card", 2, "1499", 0, 60, 60, 100), ("card", 3, "99", 62, 60, 75, 75), ("card", 4, "12", 61, 0, 70, 10), ("card", 5, "__123", 0, 0, 9, 9),
    ]
    made = blocks(spark, rows)
    assert found(prices.red_full_price(made)) == {"own": 1684.21, "pair": 1315.78}
    assert found(prices.red_card_price(made))["card"] == 1499.99
    assert prices.red_full_price(made.limit(0)).count() == 0 and prices.red_card_price(made.limit(0)).count() == 0


def test_parsers_by_family(spark):
    types = [("plain", REGULAR), ("joined", REGULAR), ("zero", RED), ("none", "gm_6x6_promo"), ("six", "own"), ("unseen", None)]
    typed = spark.createDataFrame(types, "image string, family string")
    own = {**families.PARSERS, "own": lambda rows: rows.groupBy("image").agg(F.count(F.lit(1)).alias("lines"))}
    got = {r.image: r for r in families.parse_labels(blocks(spark, ROWS), typed, own).collect()}
    assert set(got) == {t[0] for t in types}
    assert got["plain"].price_card == 1499.99 and got["joined"].price_default == 1284.29
    assert (got["six"].lines, got["six"].price_card, got["plain"].lines) == (3, None, None)
    assert (got["none"].price_card, got["unseen"].family, got["unseen"].price_card) == (1499.0, "unknown", None)
    assert set(families.PARSERS) == {RED, REGULAR}


def test_names_of_regular_labels(spark):
    rows = [
        ("a", 1, "1", 50, 0, 60, 10), ("a", 2, "Морковь", 0, 0, 40, 10), ("a", 3, "сорт", 70, 0, 90, 10), ("a", 4, "12 руб", 95, 0, 99, 10), ("a", 5, "Внизу", 0, 90, 40, 100),
        ("b", 1, "Сок10 / 50", 0, 0, 9, 9), ("b", 2, "1", 20, 0, 30, 9), ("b", 3, "( груша )", 40, 0, 90, 9), ("b", 4, "низ", 0, 80, 9, 90), ("b", 5, "слабо", 10, 0, 19, 9, 0.1),
        ("c", 1, "сорт вес", 0, 0, 9, 9), ("c", 2, "__k", 0, 0, 9, 9), ("c", 3, "x", 0, 90, 9, 99), ("d", 1, "99", 0, 0, 9, 9), ("e", 1, "Один"),
    ]
    got = {r.image: r.product_name for r in top_name(blocks(spark, rows)).collect()}
    assert got == {"a": "Морковь 1 сорт", "b": "Сок10/50 (груша)", "c": "1 сорт вес"}
    assert top_name(blocks(spark, rows).limit(0)).count() == 0
    texts = spark.createDataFrame([(t,) for t in (None, " ", "%", "12", "Вино 1", "Картофель")], "t string")
    assert [r[0] for r in texts.select(regular_noise(F.col("t"))).collect()] == ["empty", "empty", "signs", "digits", None, "marker"]
