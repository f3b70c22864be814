"""Scalars, votes and matching on rows made by hand."""

import random
import re
from difflib import SequenceMatcher

import pytest


from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.functions import names
from tagloom.operators import catalog, reference, votes
from tagloom.schema import COLUMNS, result_row


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_ean13(spark):
    for code, good in (("5012909010825", True), ("2099999089583", True), ("2099999089588", False), ("12", False), (None, False)):
        assert one(spark, S.valid_ean13(F.col("c").cast("string")), c=code) is good


def test_prices(spark):
    for text, value in (("1 499,90 p", 1499.9), ("1.2.3", None), ("", None), (None, None)):
        assert one(spark, S.parse_price(F.col("c").cast("string")), c=text) == value
    assert one(spark, S.format_price(F.col("c")), c="12,5") == "12.50"
    assert one(spark, S.format_price(F.col("c")), c="12.340") == "12.340"
    assert one(spark, S.format_price(F.col("c"), True), c="12.340") == "12.34"
    assert one(spark, S.repair_variants(F.col("c")), c=104.99) == [104.99, 1104.99, 2104.99]
    expected = one(spark, S.expected_price(F.col("c"), F.lit(0.35)), c=1499.99)
    assert abs(expected - 2307.68) < 0.01
    assert one(spark, S.near(F.lit(2315.78), F.col("c")), c=expected)


def test_vote_ties_and_absent(spark):
    rows = [
        (1, "v1", 1, 3, 1, "a"), (1, "v2", 2, 3, 1, "b"), (1, "v3", 3, 9, 1, "b"),
        (2, "v1", 1, 1, 1, "нет"), (2, "v2", 2, 1, 1, "нет"), (2, "v3", 3, 0, 0, "x"),
        (3, "v1", 1, 1, 1, "p"), (3, "v2", 2, 1, 1, "q"),
    ]
    long = spark.createDataFrame(rows, "group_id int, view string, ord int, score int, filled int, value string")
    long = long.withColumn("field", F.lit("f"))
    for n in (1, 3):  # votes don't depend on how rows are dealt
        won = votes.field_vote(long.repartition(n), absent="нет").orderBy("group_id").collect()
        assert [(r["value"], r["votes"], r["source_view"]) for r in won] == [("b", 2, "v3"), ("x", 1, "v3"), ("p", 1, "v1")]
    assert votes.field_vote(long.limit(0)).count() == 0


def test_result_row(spark):
    row = result_row(spark.createDataFrame([(1, "", "n")], "id int, barcode string, product_name string"), "id").first()
    assert row["barcode"] is None and row["product_name"] == "n" and len(row) == len(COLUMNS) + 1


def test_top_two_and_similarity(spark):
    scored = spark.createDataFrame([(1, 1, 50), (1, 2, 40), (2, 7, 20)], "q int, i int, score int")
    assert [(r["i"], r["margin"]) for r in catalog.top_two(scored, "q", "i").orderBy("q").collect()] == [(1, 10), (7, 20)]
    pair = spark.createDataFrame([("tide", "diet")], "a string, b string")
    assert pair.select(reference.similarity("a", "b")).first()[0] == 0.25
    assert pair.select(reference.similarity("b", "a")).first()[0] == 0.5


def test_product_tokens(spark):
    texts = ["Preigne VIEUX 0,75 L вино", "sauvignom charme, x les", "Nuаges jardims; des-haut", None, "", "ё плюс ёлка"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, name string")
    got = {r["id"]: r["tokens"] for r in names.product_tokens(rows, "id", "name").collect()}

    def corrected(token):
        token = names.MISSPELT.get(token, token)
        alike = sorted((-SequenceMatcher(None, token, w).ratio(), w) for w in names.CANONICAL)
        return alike[0][1] if len(token) >= 4 and alike[0][0] <= -0.82 else token

    for i, text in enumerate(texts):
        plain = re.sub(r"[#@>={}\[\]|;]", " ", (text or "").lower().replace("ё", "е")).replace("0,75 l", "0.75l")
        tokens = {corrected(t) for t in re.findall("[a-zа-я0-9]+(?:[./-][a-zа-я0-9]+)*", plain)}
        assert got[i] == sorted(t for t in tokens if len(t) >= 2 and t not in names.STOP_WORDS)
    assert got[0] == ["0.75l", "preignes", "vieux"] and got[1] == ["charmes", "les", "sauvignon"]


@pytest.mark.parametrize("least", [0.81, 0.82, 0.9])
def test_similar_names(spark, least):
    """Blocking by two neighbouring characters loses no name that is alike enough."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    left, right = words[::2], words[1::2]
    rows, other = (spark.createDataFrame([(w,) for w in x], f"{n} string") for x, n in ((left, "a"), (right, "b")))
    got = {r["a"]: (r["b"], r["similarity"]) for r in reference.similar_names(rows, other, None, "a", "b", least).collect()}
    expected = {}
    for a in left:
        best = min((-SequenceMatcher(None, a, b).ratio(), b) for b in right)
        if -best[0] >= least:
            expected[a] = (best[1], -best[0])
    assert got == expected and len(got) > 3


def test_reference_match(spark):
    """Best row, margin and confidence against scores added up one by one; a tie goes to the first, a lone row has no second."""
    fields = ", ".join(f"{f} {'double' if f.startswith('price_') and f != 'price_discount' else 'string'}" for f in reference.FEATURES)
    blank = dict.fromkeys(reference.FEATURES)
    shelf = [{"barcode": "1", "price_card": 100.0}, {"barcode": "2", "price_card": 100.0}, {"product_name": "Red Apple juice", "price_card": 150.0}]
    other = [("d", i, *(blank | row).values()) for i, row in enumerate(shelf)] + [("e", 0, *(blank | {"color": "red"}).values())]
    renamed = ", ".join(f"ref_{f}" for f in fields.split(", "))
    ref = spark.createDataFrame(other, f"reference_key string, ref_ord long, {renamed}")
    asked = [{"barcode": "2", "price_card": 100.0}, {"price_card": 100.0}, {"product_name": "Red Apple juice", "price_card": 150.0}, {"color": "RED "}]
    rows = [(i, "de"[i == 3], *(blank | row).values()) for i, row in enumerate(asked)] + [(9, "none", *blank.values())]
    made = reference.match_reference(spark.createDataFrame(rows, f"id int, reference_key string, {fields}"), ref)
    got = {r["id"]: (r["ref_ord"], r["score"], r["margin"], r["confidence"]) for r in made.collect()}
    # 0: 60 + 30 against -40 + 30; 1: twice 30; 2: 60 + 30 + 15 + two tokens (20) against -20; 3: 8
    assert got == {0: (1, 90, 100, "high"), 1: (0, 30, 0, "none"), 2: (2, 125, 145, "high"), 3: (0, 8, 8, "none")}
