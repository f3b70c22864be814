"""Text blocks of label images: bounds, filters, zones, nearest values and composed prices.

Blocks are rows (image, ord, text, conf, box) with box an array of points. The joins are on the image and so on the few
blocks of one frame; nothing is gathered but minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.label_text import clean_regular_name, regular_noise
from tagloom.functions.scalars import digits, valid_ean13

DATE = r"[0-9]{2}\.[0-9]{2}\.[0-9]{2,4}"
#: What names the mechanic of a promotion, the first that matches counts.
MECHANICS = (
    ("bogof", "bogof|богоф|набор"),
    ("sale", "распродаж"),
    ("threshold_from", r"от\s+\d+|цена\s+от"),
    ("threshold_to", r"до\s+\d+|ограничени[ея]м?\s+по\s+количеству"),
    ("promo", "акци|%"),
)


def bounds(blocks: DataFrame) -> DataFrame:
    """left, right, top, bottom of each block; a null box gives zeros."""
    def edge(of, axis):
        return F.coalesce(of(F.col("box")[axis]), F.lit(0.0))

    return blocks.withColumns(
        {"left": edge(F.array_min, "x"), "right": edge(F.array_max, "x"), "top": edge(F.array_min, "y"), "bottom": edge(F.array_max, "y")}
    )


def visible(least: float) -> Column:
    """Blocks with a box and enough confidence that aren't service text."""
    return F.coalesce(F.col("box").isNotNull() & ~F.col("text").startswith("__") & (F.col("conf") >= least), F.lit(False))


def price_part(text: Column) -> Column:
    """One to six digits, neither a date nor service text."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return n.between(1, 6) & ~text.rlike(DATE) & ~text.startswith("__")


def zoned(blocks: DataFrame) -> DataFrame:
    """`depth`: the place of a block's centre in the image, 0 at the top of the blocks and 1 at their bottom."""
    image = Window.partitionBy("image")
    top, bottom = F.min("top").over(image), F.max("bottom").over(image)
    return blocks.withColumn("depth", F.try_divide((F.col("top") + F.col("bottom")) / 2 - top, bottom - top))


def nearest(labels: DataFrame, values: DataFrame, fits: Column, distance: list[Column]) -> DataFrame:
    """image, label, value, text, gap: for each label the fitting value of its image with the least distance.

    Columns of labels and values go by the aliases l and v in `fits` and `distance`. Ties go to the first in order, and
    labels without a fitting value have no row."""
    met = labels.alias("l").join(values.alias("v"), (F.col("l.image") == F.col("v.image")) & fits)
    key = F.struct(*(d.alias(f"d{i}") for i, d in enumerate(distance)), F.col("v.ord").alias("ord"), F.col("v.text").alias("text"))
    least = met.groupBy(F.col("l.image").alias("image"), F.col("l.ord").alias("label")).agg(F.min(key).alias("m"))
    return least.select("image", "label", F.col("m.ord").alias("value"), F.col("m.text").alias("text"), F.col("m.d0").alias("gap"))


def main_block() -> Column:
    """The highest block of three or four digits of an image, an aggregate of its blocks."""
    c = F.col
    key = F.struct((c("top") - c("bottom")).alias("h"), "ord", "text", "left", "right", "top")
    return F.min(F.when(c("text").rlike("^[0-9]{3,4}$"), key))


def kopecks(main: Column) -> Column:
    """The two digits at the right of the main block that are nearest to its top, an aggregate of the blocks of its image."""
    c = F.col
    key = F.struct(F.abs(c("top") - main["top"]).alias("d0"), (c("left") - main["right"]).alias("d1"), "ord", "text")
    return F.min(F.when(c("text").rlike("^[0-9]{2}$") & (c("left") >= main["right"] - 5), key))["text"]


def main_price(blocks: DataFrame) -> DataFrame:
    """image, price: the highest block of three or four digits with the nearest two digits at its right as kopecks."""
    rows = blocks.where(F.col("text").rlike("^[0-9]{2,4}$")).withColumn("main", main_block().over(Window.partitionBy("image")))
    return rows.groupBy("image").agg(F.max("main.text").alias("text"), kopecks(F.col("main")).alias("kopecks")).where("text IS NOT NULL").select("image", priced().alias("price"))


def priced() -> Column:
    """The price of `text` and `kopecks`; null without a text."""
    return F.when(F.col("text").isNotNull(), F.concat_ws(".", "text", F.coalesce("kopecks", F.lit("00"))))


def centres(blocks: DataFrame) -> DataFrame:
    """`seen`: whether a block with bounds has a box and is no service text; `cx`, `cy` of its centre, its `digits`, and
    `lower`: whether its centre lies in the lower two fifths of its image's seen blocks. Without height no block is `lower`."""
    boxed = F.col("box").isNotNull() if "box" in blocks.columns else F.col("top").isNotNull()
    rows = blocks.withColumn("seen", boxed & ~F.coalesce(F.col("text").startswith("__"), F.lit(False)))
    image, of = Window.partitionBy("image"), lambda name: F.when(F.col("seen"), F.col(name))
    top, bottom = F.min(of("top")).over(image), F.max(of("bottom")).over(image)
    rows = rows.withColumns({"cx": (F.col("left") + F.col("right")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2})
    rows = rows.withColumns({"y0": top, "height": bottom - top, "digits": F.coalesce(digits(F.col("text")), F.lit(""))})
    return rows.withColumn("lower", (F.col("height") > 0) & (F.col("cy") >= F.col("y0") + F.col("height") * 0.6)).drop("y0", "height")


def centred(blocks: DataFrame) -> DataFrame:
    """The seen blocks of `centres`."""
    return centres(blocks).where("seen").drop("seen")


#: Fixed value: day, month, year of four digits, and a time if one follows.
PRINTED = r"\b(\d{2})[.\s](\d{2})[.\s](\d{4})(?:\s+(\d{2})[.: ]?(\d{2}))?\b"


def printed_date(text: Column) -> Column:
    """A date and time as DD.MM.YYYY HH:MM, a date alone as DD.MM.YYYY; null if there is none."""
    plain = F.regexp_replace(F.trim(text), r"\s+", " ")
    day, month, year, hour, minute = (F.regexp_extract(plain, PRINTED, i) for i in range(1, 6))
    date = F.concat_ws(".", day, month, year)
    likely = text.rlike(r"\d{2}(\.|\s+)\d{2}(\.|\s+)\d{4}")  # most texts are none, and one look tells
    return F.when(likely & (day != ""), F.when(minute != "", F.concat(date, F.lit(" "), hour, F.lit(":"), minute)).otherwise(date))


def lowest_date(seen: Column) -> Column:
    """The lowest date of an image's seen blocks, as in `latest_date`, an aggregate of them with their centres."""
    date = printed_date(F.col("text"))
    key = F.struct((F.length(date) < 12).alias("untimed"), (-F.col("cy")).alias("up"), "ord", date.alias("date"))
    return F.min(F.when(seen & date.isNotNull(), key))["date"]


def latest_date(blocks: DataFrame) -> DataFrame:
    """image, date: the lowest date of an image by its centre, those with a time first, then the first in order."""
    return centred(blocks).groupBy("image").agg(lowest_date(F.lit(True)).alias("date")).where("date IS NOT NULL")


def text_date(blocks: DataFrame, sure: float = 0.7, least: float = 0.4) -> DataFrame:
    """image, date: the first DD.MM.YYYY of the texts, wherever they stand, without a time.

    The first among texts of confidence `sure` counts if it is a day of the calendar, else the first such day among those of
    confidence `least`. Null texts and confidences count for nothing."""
    return blocks.groupBy("image").agg(first_date(sure, least).alias("date")).select("image", dated().alias("date")).where("date IS NOT NULL")


def first_date(sure: float = 0.7, least: float = 0.4) -> Column:
    """The candidates of `text_date`, an aggregate of an image's blocks; `dated` chooses."""
    date = F.regexp_extract("text", r"\d{2}\.\d{2}\.\d{4}", 0)
    there, day = date != "", F.try_to_timestamp(date, F.lit("dd.MM.yyyy")).isNotNull()
    return F.struct(
        F.min(F.when(there & (F.col("conf") >= sure), F.struct("ord", date.alias("date"), day.alias("day")))).alias("a"),
        F.min(F.when(there & (F.col("conf") >= least) & day, F.struct("ord", date.alias("date")))).alias("b"),
    )


def dated(found: str = "date") -> Column:
    a, b = F.col(found)["a"], F.col(found)["b"]
    return F.coalesce(F.when(a["day"], a["date"]), b["date"])


def stock_number(blocks: DataFrame) -> DataFrame:
    """image, id_sku: a block of 10 to 12 digits that is no date, in the lower zone if there are any; nearest to 12 digits, then
    left, then top, by its centre."""
    return centred(blocks).groupBy("image").agg(nearest_number(F.lit(True)).alias("id_sku")).where("id_sku IS NOT NULL")


def nearest_number(seen: Column) -> Column:
    """The stock number of an image's seen blocks, an aggregate of them with their centres."""
    n = F.length("digits")
    key = F.struct((~F.col("lower")).alias("high"), (12 - n).alias("short"), "cx", "cy", "ord", "digits")
    return F.min(F.when(seen & n.between(10, 12) & printed_date(F.col("text")).isNull(), key))["digits"]


def barcode(blocks: DataFrame) -> DataFrame:
    """image, barcode: a valid code of 13 digits in the lower zone, in one block, or else in up to three neighbouring ones.

    Blocks of 1, 5, 6 or 13 digits are parts, from left to right, then from the top; a part of five in the middle has lost its
    leading zero. The first that is valid counts; images without one have no row."""
    rows = centred(blocks).where(F.col("lower") & F.length("digits").isin(1, 5, 6, 13))
    order = Window.partitionBy("image").orderBy("left", "cy", "ord")
    second, third = F.lead("digits", 1).over(order), F.lead("digits", 2).over(order)
    second = F.when(F.length(second) == 5, F.concat(F.lit("0"), second)).otherwise(second)
    together = F.concat("digits", F.coalesce(second, F.lit("")), F.coalesce(third, F.lit("")))
    tried = rows.select("image", "ord", "digits", F.row_number().over(order).cast("long").alias("place"), together.alias("code"))
    direct = F.when(valid_ean13(F.col("digits")), F.struct(F.lit(0).alias("tier"), F.col("ord").alias("place"), F.col("digits").alias("code")))
    joined = F.when(valid_ean13(F.col("code")), F.struct(F.lit(1).alias("tier"), "place", "code"))
    found = tried.groupBy("image").agg(F.min(F.coalesce(direct, joined)).alias("m")).where("m IS NOT NULL")
    return found.select("image", F.col("m.code").alias("barcode"))


#: Words that a price label's texts hold.
LABEL_WORDS = ("с карт", "картой", "без карт", "карты", "руб", "сух", "вино")


def block_set_score(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, score: how well the blocks of each set (by `by`) read as a price label.

    Counted are blocks (30 at most), mean confidence, words of labels, a discount or a percent sign, whole codes, blocks of
    two to four digits (10 at most) and of any digits (15 at most); blocks of signs only count against a set, as do sets
    without digits and of fewer than four blocks. Service text counts for nothing; a set of nothing else scores 0. Null
    texts count as empty and null confidences as 0."""
    text, service = F.coalesce("text", F.lit("")), F.coalesce(F.col("text").startswith("__"), F.lit(False))
    rows = blocks.select(*by, "ord", F.lower(text).alias("text"), F.coalesce("conf", F.lit(0.0)).alias("conf"), (~service).alias("seen"))
    n = F.length(digits(F.col("text")))
    seen = F.col("seen")
    sums = rows.groupBy(*by).agg(
        F.count_if(seen).alias("n"),
        F.avg(F.when(seen, F.col("conf"))).alias("conf"),
        F.array_sort(F.collect_list(F.when(seen, F.struct("ord", "text")))).alias("texts"),  # the blocks of one image
        F.count_if(seen & n.between(2, 4)).alias("prices"),
        F.count_if(seen & (n > 0)).alias("numbers"),
        F.count_if(seen & (n == 13)).alias("codes"),
        F.count_if(seen & F.trim("text").rlike(r"(?U)^[\W_]+$")).alias("noise"),
    )
    whole = F.array_join(F.transform("texts", lambda t: t["text"]), "\n")
    sums = sums.withColumn("whole", whole)
    words = sum((F.when(F.col("whole").contains(w), 4.0).otherwise(0.0) for w in LABEL_WORDS), F.lit(0.0))
    percent = F.when(F.col("whole").rlike(r"\d{1,2}\s*%"), 8.0).when(F.col("whole").contains("%"), 4.0).otherwise(0.0)
    score = (
        F.least("n", F.lit(30)) * 0.8 + F.col("conf") * 8.0 + words + percent + F.col("codes") * 8.0
        + F.least("prices", F.lit(10)) * 2.0 + F.least("numbers", F.lit(15)) * 0.8 - F.col("noise") * 1.2
        - F.when(F.col("numbers") == 0, 8.0).otherwise(0.0) - F.when(F.col("n") < 4, 5.0).otherwise(0.0)
    )
    return sums.select(*by, F.when(F.col("n") == 0, 0.0).otherwise(F.round(score, 4)).alias("score"))


def best_variant(blocks: DataFrame, key: str, variant: str) -> DataFrame:
    """key, variant, score: of an image's variants (ordered by `variant`) the one whose blocks score most, then the first."""
    scored = block_set_score(blocks, [key, variant])
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("down"), variant)).alias("m"))
    return best.select(key, F.col("m")[variant].alias(variant), (-F.col("m.down")).alias("score"))


def mechanic(text: Column) -> Column:
    found = F.lit("regular")
    for name, pattern in reversed(MECHANICS):
        found = F.when(F.lower(text).rlike(pattern), name).otherwise(found)
    return found


def top_name(blocks: DataFrame, zone: float = 0.48, least: float = 0.35) -> DataFrame:
    """image, product_name: the blocks of the upper zone that may belong to a name, joined from the top and the left. A lone 1
    counts where one of the next two blocks speaks of a sort or weight.

    Blocks without a box, of little confidence or with service text are left out; labels without height or name have no row."""
    hint = F.col("source") == "price_hint" if "source" in blocks.columns else F.lit(False)
    rows = bounds(blocks.where(visible(least) & ~F.coalesce(hint, F.lit(False))))
    image, order = Window.partitionBy("image"), Window.partitionBy("image").orderBy("top", "left", "ord")
    y0, y1 = F.min("top").over(image), F.max("bottom").over(image)
    upper = rows.select("image", "ord", "text", "left", "top", ((F.col("top") + F.col("bottom")) / 2).alias("cy"), y0.alias("y0"), y1.alias("y1"))
    upper = upper.where((F.col("y1") > F.col("y0")) & (F.col("cy") <= F.col("y0") + (F.col("y1") - F.col("y0")) * zone))
    low = F.trim(F.translate(F.lower("text"), "ё", "е"))
    after = [F.lead(low, i).over(order) for i in (1, 2)]
    sorted_ = F.lit(False)
    for text in after:
        sorted_ = sorted_ | F.coalesce(text.contains("сорт") | text.contains("вес"), F.lit(False))
    kept = upper.select("image", "ord", "text", "left", "top", (regular_noise(F.col("text")).isNull() | ((low == "1") & sorted_)).alias("kept")).where("kept")
    parts = F.array_sort(F.collect_list(F.struct("top", "left", "ord", "text")))
    named = kept.groupBy("image").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("name"))
    return named.select("image", clean_regular_name(F.col("name")).alias("product_name"))
