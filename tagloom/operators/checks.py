"""Comparing results with expected rows, and codes with what is printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import parse_price_strict
from tagloom.operators.reference import similarity
from tagloom.schema import ABSENT


def soft_text(text: Column) -> Column:
    """Text for tolerant comparison: lower case, one kind of е, points for colons, even spacing, no quotes."""
    text = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "ё:", "е.")
    for pattern, by in ((r"\s+", " "), (r"\s+([,.)])", "$1"), (r"([(])\s+", "$1"), ("[\"'`]+", "")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def compare_fields(expected: DataFrame, actual: DataFrame, prices: list[str], texts: list[str]) -> DataFrame:
    """key, field, expected, actual, match for rows (key, field, value) of keys that both sides have.

    Prices agree within 0.01 (a value marked absent only with itself), texts softly or by a similarity of 0.9, others
    exactly. Null and empty are the same. The sides are joined once; of texts that don't differ Python gets nulls."""
    def plain(c):
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    both = expected.select("key", "field", F.col("value").alias("expected")).join(
        actual.select("key", "field", F.col("value").alias("actual")), ["key", "field"]
    )
    same = plain("expected") == plain("actual")
    left, right = parse_price_strict(F.col("expected")), parse_price_strict(F.col("actual"))
    absent = (F.lower(plain("expected")) == ABSENT) | (F.lower(plain("actual")) == ABSENT)
    price = F.when(absent | left.isNull() | right.isNull(), same).otherwise(F.abs(left - right) <= 0.01)
    soft = soft_text(F.col("expected")) == soft_text(F.col("actual"))
    exact = F.when(F.col("field").isin(prices), price).when(F.col("field").isin(texts), soft).otherwise(same)
    judged = both.withColumn("match", exact)
    unsure = F.col("field").isin(texts) & ~F.col("match")
    asked = lambda side: F.when(unsure, soft_text(F.col(side)))
    alike = similarity(asked("expected"), asked("actual")) >= 0.9
    return judged.withColumn("alike", alike).withColumn("match", F.when(unsure, F.col("alike")).otherwise(F.col("match"))).drop("alike")


def field_accuracy(compared: DataFrame) -> DataFrame:
    return compared.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if("match").alias("matches"))


def price_agrees(seen: Column, code: Column) -> Column:
    """Whether a printed price is that of the code, which may be by the kilogram (ten times); null if one is missing."""
    a, b = parse_price_strict(seen), parse_price_strict(code)
    return (F.abs(a - b) <= 0.01) | (F.abs(b / 10 - a) <= 0.01)


PER_KILOGRAM = "price of the code is per kg, the printed one per 100 g"


def code_agreement(rows: DataFrame) -> DataFrame:
    """rows with barcode_match, price1_match, price2_match and notes: whether what is printed agrees with the code.

    The barcode has to be equal, price_default agree with price1_qr and price_card with price2_qr, within 0.01 or by a
    tenth, which notes say once. A match is null where either side is null, blank or (of codes and prices) ABSENT."""
    def plain(c):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))

    def price(c):
        return parse_price_strict(F.replace(plain(c), F.lit(" "), F.lit("")))

    seen, code = plain("barcode"), plain("qr_code_barcode")
    known = (seen != "") & ~F.lower(code).isin("", ABSENT)
    found, tenths = {"barcode_match": F.when(known, seen == code)}, []
    for name, printed, coded in (("price1_match", "price_default", "price1_qr"), ("price2_match", "price_card", "price2_qr")):
        a, b = price(printed), price(coded)
        found[name] = (F.abs(a - b) <= 0.01) | (F.abs(b / 10 - a) <= 0.01)
        tenths.append(F.coalesce((F.abs(a - b) > 0.01) & (F.abs(b / 10 - a) <= 0.01), F.lit(False)))
    notes = F.when(tenths[0] | tenths[1], F.array(F.lit(PER_KILOGRAM))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns(found | {"notes": notes})


def code_report(rows: DataFrame, key: str = "filename") -> DataFrame:
    """The report of `code_agreement`: what was compared beside each outcome as true, false or empty, and the notes."""
    judged = code_agreement(rows)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    columns = "barcode qr_code_barcode barcode_match price_default price1_qr price1_match price_card price2_qr price2_match".split()
    return judged.select(key, *(shown(c) for c in columns), F.array_join("notes", "; ").alias("notes"))


def payload_fields(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, name, value: pairs of a payload (an address with a query, or bare pairs); the last value of a name counts."""
    query = F.regexp_replace(F.regexp_replace(F.col(payload), r"^[^?]*\?", ""), "#.*$", "")
    pairs = payloads.select(key, F.posexplode(F.split(query, "[&;\n]")).alias("at", "pair")).where(F.col("pair").contains("="))
    name, value = F.lower(F.trim(F.split_part("pair", F.lit("="), F.lit(1)))), F.regexp_extract("pair", "^[^=]*=(.*)$", 1)
    return pairs.groupBy(key, name.alias("name")).agg(F.max_by(value, "at").alias("value"))
