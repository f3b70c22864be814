"""Votes over the readings of a group: one value per field with the view that it comes from.

Readings are long: group, field, value, view, ord (place in processing order, unique in a group), score, filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalars import derived_prices, digits, discount_share, expected_price, name_score, near, parse_price, valid_ean13
from tagloom.schema import ABSENT


def unpivot(readings: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long form of readings: one row per known field.

    The first key is the group. Readings go to their groups before they are made long, so that a shuffle carries each of
    them once and not once a field; votes over the groups need no further one."""
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    long = readings.select(*keys, *fields).repartition(keys[0]).select(*keys, each)
    return long.where("value IS NOT NULL AND value != ''")


def quality(fields: dict[str, Column], points: dict[str, int]) -> tuple[Column, Column]:
    """Score (points of what is known) and number of known fields of a reading."""
    known = {k: c.isNotNull() & (c.cast("string") != "") for k, c in fields.items()}
    one = lambda on, n: F.when(on, n).otherwise(0)
    score = sum((one(known[k], n) for k, n in points.items()), F.lit(0))
    return score, sum((one(c, 1) for c in known.values()), F.lit(0))


def field_vote(long: DataFrame, group: str = "group_id", absent: str | None = None) -> DataFrame:
    """The winner per group and field: most frequent, then best score, best filled count, first seen.

    With `absent`, that value wins only where nothing else was read. The source is the view of the best reading of the
    winning value. Values are counted before groups are."""
    known = [] if absent is None else [(F.col("value") != absent).alias("known")]
    won = _counts(long, [group, "field"]).groupBy(group, "field").agg(F.max(F.struct(*known, *_RANK)).alias("w"))
    return won.select(group, "field", "w.value", "w.votes", "w.score", "w.filled", (-F.col("w.late")).alias("ord"), "w.source_view")


#: Values of a group, the winner greatest: most votes, best score, best filled count, first seen.
_RANK = ["votes", "score", "filled", "late", "value", "source_view"]


def _counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """Votes of each value, its best score and filled count, first place, and the view of its best reading. Of a value's
    readings the best one has the best score, so that is not kept twice."""
    best = F.max(F.struct("score", "filled", (-F.col("ord")).alias("late"), "view")).alias("best")
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("votes"), F.max("filled").alias("filled"), F.min("ord").alias("ord"), best)
    return counts.select(*keys, "value", "votes", F.col("best.score").alias("score"), "filled", (-F.col("ord")).alias("late"), F.col("best.view").alias("source_view"))


def best_reading(readings: DataFrame, group: str, order: list[Column]) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return readings.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def barcode_vote(long: DataFrame, group: str = "group_id") -> DataFrame:
    """field_vote over valid EAN-13 codes only, with the number of distinct ones and of ignored readings.

    long: readings of one field. Codes are counted before they are checked, so each is checked once in a group."""
    counts = _counts(long.repartition(group).withColumn("value", digits("value")), [group])
    marked = counts.withColumn("ok", valid_ean13(F.col("value")))
    best = F.max(F.when(F.col("ok"), F.struct(*_RANK))).alias("w")
    ignored = F.coalesce(F.sum(F.when(~F.col("ok"), F.col("votes"))), F.lit(0)).alias("ignored")
    found = marked.groupBy(group).agg(F.count_if("ok").alias("codes"), ignored, best)
    return found.select(group, "codes", "ignored", "w.value", "w.votes", "w.source_view")


def consistent_price(readings: DataFrame, group: str = "group_id") -> DataFrame:
    """group, price_default, tier: the full price that fits the voted card price and discount.

    Tier 1: the value read that is nearest to what they lead to expect, of those above the card price and near it; 2: the
    nearest price that digits of a name or full price may mean; 3: the vote, where nothing is expected or fits. Ties go to
    the better score, then to the first. Groups without a value fall out.

    readings: group, view, ord, score, filled and, as text, price_card, discount_amount, price_default, product_name."""
    c = F.col
    fields = ["price_card", "discount_amount", "price_default"]
    won = field_vote(unpivot(readings, [group, "view", "ord", "score", "filled"], fields), group)
    voted = won.groupBy(group).agg(*(F.max(F.when(c("field") == f, c("value"))).alias(f"voted_{f}") for f in fields))
    card, share = parse_price(c("voted_price_card")), discount_share(c("voted_discount_amount"))
    voted = voted.select(group, "voted_price_default", card.alias("card"), expected_price(card, share).alias("expected"))
    full = parse_price(c("price_default"))
    texts = F.concat(*(F.coalesce(derived_prices(c(f), c("expected")), F.array().cast("array<double>")) for f in ("product_name", "price_default")))
    nearest = F.array_min(F.transform(texts, lambda p: F.struct(F.abs(p - c("expected")).alias("off"), p.alias("price"))))
    both = readings.join(voted, group).withColumn("derived", nearest)  # a column, so that it is worked out once a reading
    derived = c("derived")
    off, late = F.abs(full - c("expected")), [(-c("score")).alias("less"), c("ord").alias("ord")]
    explicit = F.when(
        (full > F.coalesce(c("card"), F.lit(0.0))) & near(full, c("expected")),
        F.struct(F.lit(1).alias("tier"), off.alias("off"), *late, full.alias("price")),
    )
    other = F.when(derived.isNotNull(), F.struct(F.lit(2).alias("tier"), derived["off"].alias("off"), *late, derived["price"].alias("price")))
    best = both.groupBy(group).agg(F.min(F.coalesce(explicit, other)).alias("best"), F.first("voted_price_default").alias("vote"))
    shown = F.when(c("best").isNotNull(), F.format_string("%.2f", c("best.price"))).otherwise(c("vote"))
    found = best.select(group, shown.alias("price_default"), F.coalesce(c("best.tier"), F.lit(3)).alias("tier"))
    return found.where("price_default IS NOT NULL")


def best_name(readings: DataFrame, group: str = "group_id") -> DataFrame:
    """group, product_name, source_view: the usable name that reads best, then of the better reading, then the longest,
    then the first. A usable name has two words at least and isn't the absent marker.

    readings: group, view, ord, score, product_name."""
    name = F.trim("product_name")
    usable = readings.where((name != ABSENT) & (F.size(F.split(name, r"\s+")) >= 2))
    order = F.struct(name_score(F.col("product_name")), "score", F.length("product_name"), -F.col("ord"))
    return usable.groupBy(group).agg(
        F.max_by("product_name", order).alias("product_name"), F.max_by("view", order).alias("source_view")
    )
