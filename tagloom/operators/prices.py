"""Prices put together from the blocks of a label: the card price by layout, and the price beside a "without card" label.

Blocks are rows (image, ord, text, conf, box, and perhaps source). The few blocks of an image that count are gathered once,
and prices are put together in that one row: blocks are shuffled once and never joined with one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.label_text import DATE, in_default_range, red_price, without_card, without_card_red
from tagloom.functions.scalars import digits, kopeck_hint
from tagloom.operators.blocks import bounds, price_part

#: Least confidence of blocks, and how far (in pixels or heights of the main block) parts may lie apart.
CARD_CONF, FULL_CONF = 0.4, 0.3
KOPECK_REACH, PREFIX_REACH = (0.75, 90.0), (0.5, 80.0)
LABEL_REACH = {"left": 180, "right": 220, "top": 80, "bottom": 90, "level": 90}
NEAREST = 4


def _priced(blocks: DataFrame, least: float) -> tuple[DataFrame, Column]:
    """Blocks with their digits and places, and which may be part of a price."""
    hint = F.col("source") == "price_hint" if "source" in blocks.columns else F.lit(False)
    part = F.col("box").isNotNull() & (F.col("conf") >= least) & price_part(F.col("text")) & ~F.coalesce(hint, F.lit(False))
    return _placed(blocks.withColumn("part", F.coalesce(part, F.lit(False)))), F.col("part")


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with their digits, edges, centre and height."""
    sides = bounds(blocks)
    return sides.withColumns({
        "digits": digits(F.col("text")), "cx": (F.col("left") + F.col("right")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2,
        "height": F.col("bottom") - F.col("top"),
    })


def _gathered(on: Column, *fields: str) -> Column:
    """The blocks of an image for which `on` holds, as structs."""
    return F.collect_list(F.when(on, F.struct(*fields)))


def _least(structs: Column, key: Callable[[Column], Column]) -> Column:
    """The struct with the least key among an image's structs; null if there are none."""
    return F.array_min(F.transform(structs, lambda p: F.struct(key(p).alias("key"), p.alias("it"))))["it"]


def _long(p: Column, least: int, most: int) -> Column:
    return F.length(p["digits"]).between(least, most)


def card_price(blocks: DataFrame) -> DataFrame:
    """image, price: the highest block of two to four digits, with the two digits to its right on its level that are
    nearest, or else the image's first hint, as kopecks, and a single digit before it. Without such a prefix a leading zero
    of three digits was a thousand. Images without roubles or kopecks have no row; ties go to the first by ord."""
    rows, part = _priced(blocks, CARD_CONF)
    fields = ("ord", "digits", "left", "right", "cx", "cy", "height")
    hinted = kopeck_hint(F.col("text"))
    short = part & F.length("digits").between(1, 4)
    images = rows.where(short | hinted.isNotNull()).groupBy("image").agg(
        _gathered(short, *fields).alias("parts"), F.min_by(F.when(hinted.isNotNull(), hinted), F.when(hinted.isNotNull(), F.col("ord"))).alias("hint")
    )
    main = _least(F.filter("parts", lambda p: _long(p, 2, 4)), lambda p: F.struct(-p["height"], p["ord"]))
    images = images.withColumn("m", main).where("m IS NOT NULL")
    m = F.col("m")
    off, level = lambda p: F.abs(p["cy"] - m["cy"]), lambda reach: F.greatest(m["height"] * reach[0], F.lit(reach[1]))
    other = lambda p, n: (F.length(p["digits"]) == n) & (p["ord"] != m["ord"])
    kopecks = F.filter("parts", lambda p: other(p, 2) & (p["cx"] > m["cx"]) & (off(p) <= level(KOPECK_REACH)))
    prefix = F.filter("parts", lambda p: other(p, 1) & (p["right"] <= m["left"]) & (off(p) <= level(PREFIX_REACH)))
    rows = images.select(
        "image", "hint", F.col("m.digits").alias("roubles"),
        _least(kopecks, lambda p: F.struct(off(p), p["left"] - m["right"], p["ord"], p["digits"]))["digits"].alias("kopecks"),
        _least(prefix, lambda p: F.struct(m["left"] - p["right"], p["ord"], p["digits"]))["digits"].alias("prefix"),
    )
    roubles = F.col("roubles")
    lost = (F.length(roubles) == 3) & roubles.startswith("0")
    roubles = F.when(F.col("prefix").isNotNull(), F.concat("prefix", roubles)).when(lost, F.concat(F.lit("1"), roubles)).otherwise(roubles)
    price = F.concat(roubles, F.lit("."), F.coalesce("kopecks", "hint")).try_cast("double")
    return rows.select("image", price.alias("price")).where("price IS NOT NULL")


def composed(parts: Column) -> Column:
    """The price that a few blocks (structs in order of left, cy, turn) make: digits left of two digits, in order, as
    roubles if they are two to four; else the highest four digits as roubles, a zero and the last digit; else the highest
    six digits with the last two as kopecks. Null where they make none."""
    size = lambda p: F.length(p["digits"])

    def joined(k: Column) -> Column:
        left = F.filter(parts, lambda r: (r["turn"] != k["turn"]) & (r["cx"] < k["cx"]) & size(r).between(1, 4))
        roubles = F.array_join(F.transform(left, lambda r: r["digits"]), "")
        return F.when(F.length(roubles).between(2, 4), F.concat(roubles, F.lit("."), k["digits"]))

    pairs = F.array_compact(F.transform(F.filter(parts, lambda k: size(k) == 2), joined))

    def highest(n: int) -> Column:
        of = F.filter(parts, lambda p: size(p) == n)
        best = F.array_min(F.transform(of, lambda p, i: F.struct((-p["height"]).alias("h"), i.alias("i"), p["digits"].alias("digits"))))
        return best["digits"]

    four, six = highest(4), highest(6)
    price = F.coalesce(
        F.get(pairs, F.lit(0)),
        F.concat(F.left(four, F.lit(3)), F.lit(".0"), F.right(four, F.lit(1))),
        F.concat(F.left(six, F.lit(4)), F.lit("."), F.right(six, F.lit(2))),
    )
    return price.try_cast("double")


def price_without_card(blocks: DataFrame) -> DataFrame:
    """image, label (its ord), price: the price that the four blocks nearest to a label of the price without card make; of
    several labels the one with the nearest block counts. Images without label or price have no row."""
    r = LABEL_REACH
    rows, part = _priced(blocks, FULL_CONF)
    part = part & ~F.lower("text").contains("карт")
    label = F.coalesce(F.col("box").isNotNull() & without_card(F.col("text")), F.lit(False))
    edges = ("ord", "left", "right", "top", "bottom", "cx", "cy")
    images = rows.where(part | label).groupBy("image").agg(
        _gathered(part, "ord", "digits", "left", "cx", "cy", "height").alias("parts"), _gathered(label, *edges).alias("labels")
    )

    def priced(own: Column) -> Column:
        up, across = lambda p: F.abs(p["cy"] - own["cy"]), lambda p: F.abs(p["cx"] - own["cx"])
        near = lambda p: (
            (p["cx"] >= own["left"] - r["left"]) & (p["cx"] <= own["right"] + r["right"]) & (up(p) <= r["level"])
            & (p["cy"] >= own["top"] - r["top"]) & (p["cy"] <= own["bottom"] + r["bottom"])
        )
        ranked = F.transform(F.filter("parts", near), lambda p: F.struct(up(p).alias("up"), across(p).alias("across"), p["ord"].alias("ord"), p.alias("it")))
        few = F.slice(F.array_sort(ranked), 1, NEAREST)
        return F.struct(own["ord"].alias("label"), few.alias("few"))

    met = images.select("image", F.explode(F.transform("labels", priced)).alias("l")).where(F.size("l.few") > 0)
    taken = lambda q, i: F.struct(
        q["it"]["left"].alias("left"), q["it"]["cy"].alias("cy"), (i + 1).alias("turn"), q["it"]["cx"].alias("cx"), q["it"]["height"].alias("height"), q["it"]["digits"].alias("digits")
    )
    gap = F.struct(F.col("l.few")[0]["up"].alias("up"), F.col("l.few")[0]["across"].alias("across"))
    made = met.select("image", F.col("l.label").alias("label"), gap.alias("gap"), F.array_sort(F.transform("l.few", taken)).alias("parts"))
    made = made.withColumn("price", composed(F.col("parts"))).where("price IS NOT NULL")
    best = made.groupBy("image").agg(F.min(F.struct("gap", "label", "price")).alias("b"))
    return best.select("image", "b.label", "b.price")


#: Structs of red labels.
_PART = ("ord", "digits", "left", "right", "top", "bottom", "cx", "cy", "height", "conf")


def _red_images(blocks: DataFrame, part: Column, label: Column, own: Column) -> DataFrame:
    """image, its bounds (x0, y0, x1, y1), and its parts and labels as structs: of the blocks with a box and a text that is no
    service text. `own` is the price that a part's text is by itself."""
    plain = F.trim("text")
    rows = blocks.where(F.col("box").isNotNull() & (plain != "") & ~plain.startswith("__")).withColumn("text", plain)
    rows = _placed(rows).withColumns({"own": own, "part": F.coalesce(part, F.lit(False)), "label": label})
    return rows.groupBy("image").agg(
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max("right").alias("x1"), F.max("bottom").alias("y1"),
        _gathered(F.col("part"), *_PART, "own").alias("parts"), _gathered(F.col("label"), *_PART).alias("labels"),
    )


def assembled(parts: Column) -> Column:
    """The highest block whose text is a price by itself (`own`; then the rightmost), else the roubles and kopecks that fit
    best: their distance in height, a third of the gap and how far left they are count against them."""
    direct = _least(F.filter(parts, lambda p: p["own"].isNotNull()), lambda p: F.struct(p["cy"], -p["cx"], p["ord"], p["own"]))["own"]
    off = lambda r, k: F.abs(r["cy"] - k["cy"])
    price = lambda r, k: F.concat(r["digits"], F.lit("."), k["digits"])
    fits = lambda r, k: (off(r, k) <= F.greatest(r["height"] * 1.2, F.lit(45.0))) & (k["left"] >= r["left"] - 20) & in_default_range(price(r, k))
    score = lambda r, k: off(r, k) + F.abs(k["left"] - r["right"]) * 0.35 - r["cx"] * 0.02
    kopecks = F.filter(parts, lambda k: _long(k, 2, 2))
    choice = lambda r, k: F.struct(score(r, k).alias("score"), r["ord"].alias("r"), k["ord"].alias("k"), price(r, k).alias("price"))
    pairs = F.flatten(F.transform(
        F.filter(parts, lambda r: _long(r, 3, 4)), lambda r: F.transform(F.filter(kopecks, lambda k: fits(r, k)), lambda k: choice(r, k))
    ))
    return F.coalesce(direct, F.array_min(pairs)["price"])


def red_full_price(blocks: DataFrame) -> DataFrame:
    """image, price of a red label: what the blocks under the highest "without card" label make, else those in its upper
    right part."""
    c = F.col
    number = F.length("digits").between(1, 6) & ~c("text").rlike(DATE) & (c("conf") >= 0.15)
    own = red_price(c("text"))
    images = _red_images(blocks, number, without_card_red(c("text")), F.when(in_default_range(own), own))
    beside = lambda l, p: (p["cx"] >= l["left"] - 40) & (p["cy"] >= l["top"] - 50) & (p["cy"] <= l["bottom"] + 180)  # noqa: E731, E741
    near = F.transform("labels", lambda l: F.struct(  # noqa: E741
        l["cy"].alias("cy"), l["ord"].alias("label"), assembled(F.filter("parts", lambda p: beside(l, p))).alias("price")
    ))
    first = F.array_min(F.filter(near, lambda n: n["price"].isNotNull()))["price"]
    upper = F.filter("parts", lambda p: (p["cy"] <= c("y0") + (c("y1") - c("y0")) * 0.60) & (p["cx"] >= c("x0") + (c("x1") - c("x0")) * 0.35))
    found = images.select("image", first.alias("beside"), upper.alias("upper"))
    rows = found.select("image", F.coalesce("beside", assembled(c("upper"))).alias("price")).where("price IS NOT NULL")
    return rows.select("image", c("price").try_cast("double").alias("price"))


def red_card_price(blocks: DataFrame) -> DataFrame:
    """image, price of a red label's lower part: the highest three or four digits that have two digits beside them (on their
    level if there are any), the nearest to their right edge."""
    c = F.col
    part = F.length("digits").between(2, 5) & ~c("text").rlike(DATE) & (c("conf") >= 0.25)
    images = _red_images(blocks, part, F.lit(False), F.lit(None).cast("string"))
    lower = F.filter("parts", lambda p: p["cy"] >= c("y0") + (c("y1") - c("y0")) * 0.40)
    rows = images.select("image", lower.alias("parts"))
    level = lambda r, k: (k["left"] >= r["left"]) & (F.abs(k["cy"] - r["cy"]) <= F.greatest(r["height"] * 0.9, F.lit(35.0)))
    near = lambda r: F.filter("parts", lambda k: _long(k, 2, 2) & (k["left"] >= r["left"] - 20))  # noqa: E731, no level is further left
    best = lambda r: _least(near(r), lambda k: F.struct(F.when(level(r, k), 1).otherwise(2), F.abs(k["cx"] - r["right"]), k["ord"], k["digits"]))["digits"]
    choice = lambda r: F.struct((-r["height"]).alias("h"), (-r["cy"]).alias("y"), r["ord"].alias("o"), r["digits"].alias("roubles"), best(r).alias("kopecks"))
    made = F.transform(F.filter("parts", lambda r: _long(r, 3, 4)), choice)
    rows = rows.select("image", F.array_min(F.filter(made, lambda p: p["kopecks"].isNotNull())).alias("b")).where("b IS NOT NULL")
    return rows.select("image", F.concat("b.roubles", F.lit("."), "b.kopecks").try_cast("double").alias("price"))
