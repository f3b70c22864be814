"""Fields of QR payloads: JSON objects, addresses with a query, or bare pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalars import clean_qr_price, valid_ean13
from tagloom.schema import ABSENT, present, recognised

#: The names that payloads use for result columns.
ALIASES = {
    "qr_code_barcode": ("barcode", "b"),
    "price1_qr": ("price1", "p1"),
    "price2_qr": ("price2", "p2"),
    "price3_qr": ("price3", "p3"),
    "price4_qr": ("price4", "p4"),
    "wholesale_level_1_count": ("wholesalelevel1count", "wl1c"),
    "wholesale_level_1_price": ("wholesalelevel1price", "wl1p"),
    "wholesale_level_2_count": ("wholesalelevel2count", "wl2c"),
    "wholesale_level_2_price": ("wholesalelevel2price", "wl2p"),
    "action_price_qr": ("actionprice", "ap"),
    "action_code_qr": ("actioncode", "ac"),
}
COUNTS = ("wholesale_level_1_count", "wholesale_level_2_count", "action_code_qr")
#: Levels of nested objects that are opened.
DEPTH = 3


def _plain(text: Column) -> Column:
    """Percent and plus decoding; a malformed text stays."""
    return F.coalesce(F.try_url_decode(text), text)


def _nested(text: Column, above: Column, depth: int) -> Column:
    """The pairs of a JSON object's text, whose place is `above`; objects in it are opened down to DEPTH levels."""
    def opened(e: Column, i: Column) -> Column:
        at, value = F.concat(above, F.array(i)), e["value"]
        one = F.array(F.struct(at.alias("at"), e["key"].alias("name"), value.alias("value")))
        if depth + 1 == DEPTH:
            return one
        return F.when(value.startswith("{"), F.coalesce(_nested(value, at, depth + 1), one)).otherwise(one)

    return F.flatten(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), opened))


def _pairs(payload: Column) -> Column:
    """The pairs of a payload, as in `payload_pairs`, as an array of its row."""
    p = F.trim(payload)
    flat = F.regexp_replace(F.when(p.rlike(r"\?[^#]"), F.regexp_replace(F.regexp_replace(p, r"^[^?]*\?", ""), "#.*$", "")).otherwise(p), "[;\n\r]", "&")
    pair = lambda t, i: F.struct(
        F.array(i).alias("at"), _plain(F.split_part(t, F.lit("="), F.lit(1))).alias("name"),
        _plain(F.regexp_extract(t, "^[^=]*=(?s)(.*)$", 1)).alias("value"), (t != "").alias("there"),
    )
    kept = F.filter(F.transform(F.split(flat, "&"), pair), lambda t: t["there"])
    bare = F.transform(kept, lambda t: F.struct(t["at"].alias("at"), t["name"].alias("name"), t["value"].alias("value")))
    return F.coalesce(F.when(p.startswith("{"), _nested(p, F.array().cast("array<int>"), 0)), bare)


def payload_pairs(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, at, name, value: the pairs of each payload in order; `at` orders them (nested ones after their place).

    A pair without `=` has an empty value. A payload that starts as JSON but isn't any is read as pairs."""
    return payloads.select(key, F.inline(_pairs(F.col(payload))))


def qr_fields(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key and the payload's result columns for each payload that isn't empty; the last value of a column counts.

    What the payload lacks is ABSENT, but the code, which is unknown when the payload has only invalid ones. `unknown` maps
    other names to their last values. Repeated keys share one row.

    Payloads are dealt and sorted by key as they are, and their pairs never become rows: what a task sorts are payloads."""
    alias = F.create_map(*(F.lit(x) for field, names in ALIASES.items() for name in names for x in (name, field)))

    def read(p: Column) -> Column:
        name = F.trim(p["name"])
        field = F.get(F.array(alias[F.lower(name)]), F.lit(0))
        return F.struct(p["at"].alias("at"), name.alias("name"), field.alias("field"), F.trim(F.replace(_plain(F.trim(p["value"])), F.lit(","), F.lit("."))).alias("v"))

    code = lambda v: F.regexp_replace(v, "[^0-9]", "")
    mine = lambda field: F.filter("pairs", lambda p: p["field"] == field)
    last = lambda pairs, shown: F.array_max(F.transform(pairs, lambda p: F.struct(p["at"].alias("at"), shown(p["v"]).alias("v"))))
    codes = mine("qr_code_barcode")
    found = {"qr_code_barcode": last(F.filter(codes, lambda p: valid_ean13(code(p["v"]))), code)}
    for field in ALIASES:
        if field != "qr_code_barcode":
            found[field] = last(mine(field), (lambda v: v) if field in COUNTS else clean_qr_price)
    spare = F.transform(F.filter("pairs", lambda p: p["field"].isNull()), lambda p: F.struct(p["name"].alias("name"), p["at"].alias("at"), p["v"].alias("v")))
    dealt = payloads.where(F.trim(payload) != "").select(key, payload).repartition(key).sortWithinPartitions(key)
    pairs = dealt.select(key, F.transform(_pairs(F.col(payload)), read).alias("pairs"))
    rows = pairs.select(key, *(c.alias(f) for f, c in found.items()), F.exists(codes, lambda p: ~valid_ean13(code(p["v"]))).alias("_invalid_"), spare.alias("spare"))
    # rows of the same key: the last of each column, and of each other name
    grouped = rows.groupBy(key).agg(*(F.max(f)["v"].alias(f) for f in ALIASES), F.max("_invalid_").alias("_invalid_"), F.flatten(F.collect_list("spare")).alias("spare"))
    sorted_ = F.array_sort("spare")
    after = lambda i: F.get(sorted_, i + 1)["name"]
    lasts = F.filter(sorted_, lambda p, i: ~p["name"].eqNullSafe(after(i)) & p["name"].isNotNull())
    unknown = F.map_from_entries(F.transform(lasts, lambda p: F.struct(p["name"].alias("name"), p["v"].alias("v"))))
    fields = []
    for f in ALIASES:
        missing = F.when(F.col("_invalid_"), F.lit("")).otherwise(ABSENT) if f == "qr_code_barcode" else F.lit(ABSENT)
        fields.append(F.when(F.coalesce(present(F.col(f)), F.lit(False)), F.col(f)).otherwise(missing).alias(f))
    return grouped.select(key, *fields, F.when(F.size("spare") > 0, unknown).alias("unknown"))


def fallback_price(family: Column, full: Column, first_qr: Column) -> Column:
    """The full price of a red promotion without one is the payload's first price."""
    take = (family == "gm_6x6_red_promo") & ~F.coalesce(present(full), F.lit(False)) & recognised(first_qr)
    return F.when(take, first_qr).otherwise(full)
