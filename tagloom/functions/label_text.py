"""Column functions on the texts of label blocks, and lenient casts of report values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.scalars import digits

#: Signs of a price without the card, service words, and misread words with what they stand for.
WITHOUT = "без|боз|б8|б8э|ба|ба1|бвз|баз"
WITHOUT_RED = "без|боз|бвз|баз|б8|6ез"
SERVICE = "без карт|с карт|картой|карты|руб|цена|от цены|скид|код"
MISREAD = (
    ("HAUТ", "HAUT"), ("KARIH", "MARIN"), ("PlRE", "PURE"), ("ALTTUDE", "ALTITUDE"), ("LEs", "LES"), ("Внмо", "Вино"),
    ("Пнно", "Вино"), ("Птна", "Вино"), ("Бсл cyх", "бел. сух."), ("Бсщ", "бел."), ("Сапнньон", "Совиньон"),
    ("Саuишнан", "Совиньон"), ("Бля", "Блан"), ("Шэрпонс", "Шардоне"), ("Фрянцтя", "Франция"), ("Фралыя", "Франция"),
    ("сратцня", "Франция"),
)
QUANTITY_UNITS = "шт|кг|г|гр|мл|л"
DATE = r"[0-9]{2}\.[0-9]{2}\.[0-9]{2,4}"


def without_card(text: Column) -> Column:
    """A label of the price without the card, read as badly as it may be; null is none."""
    low = F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"\s+", " ")
    return F.coalesce(low.contains("карт") & low.rlike(WITHOUT), F.lit(False))


def without_card_red(text: Column) -> Column:
    """As `without_card` on red labels, where letters may be spaced out and Latin."""
    low = F.translate(F.lower(text), "ёe", "ее")
    tight = F.regexp_replace(low, r"\s+", "")
    return F.coalesce(tight.contains("карт") & (low.rlike(WITHOUT_RED) | tight.rlike(WITHOUT_RED)), F.lit(False))


def red_price(text: Column) -> Column:
    """Three or four digits with two more behind a point as they are; six digits split 4 + 2, five 4 + 1; else null."""
    point = F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit(".")), "[^0-9.]", "")
    first = F.split_part(point, F.lit("."), F.lit(1))
    tail = F.replace(F.substr(point, F.length(first) + 2), F.lit("."), F.lit(""))
    joined = F.when(point.contains("."), F.concat(first, F.lit("."), tail)).otherwise(point)
    plain = digits(text)
    whole = F.substring(plain, 1, 4)
    return (
        F.when(joined.rlike(r"^[0-9]{3,4}\.[0-9]{2}$"), joined)
        .when(F.length(plain) == 6, F.concat(whole, F.lit("."), F.substring(plain, 5, 2)))
        .when(F.length(plain) == 5, F.concat(whole, F.lit("."), F.substring(plain, 5, 1), F.lit("0")))
    )


def in_default_range(price: Column) -> Column:
    return F.coalesce(price.try_cast("double").between(1000, 2500), F.lit(False))


def likely_quantity(price: Column, text: Column) -> Column:
    """A whole price that the text also has as a number of pieces or a weight."""
    number = price.cast("long").cast("string")
    pattern = F.concat(F.lit("(?i)(?U)(^|[^0-9a-zа-яё_])"), number, F.lit(rf"\s*({QUANTITY_UNITS})($|[^0-9a-zа-яё_])"))
    return F.coalesce((price == F.floor(price)) & F.regexp_like(text, pattern), F.lit(False))


def scale_label(text: Column) -> Column:
    """A label of the number for the scales; look-alike Latin letters count as theirs."""
    low = F.translate(F.lower(text), "ёep", "еер")
    return F.coalesce(low.contains("ном") & low.contains("вес"), F.lit(False))


def scale_number(text: Column, conf: Column) -> Column:
    return F.coalesce(F.length(digits(text)).between(2, 4) & (conf >= 0.35) & ~text.rlike(DATE), F.lit(False))


def clean_name(text: Column) -> Column:
    """Misread words set right, spacing, signs and volumes evened out."""
    for old, new in MISREAD:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+([,.)])", "$1"), r"([(])\s+", "$1")
    text = F.regexp_replace(text, r"(?iU)\b0\s*[,.]?\s*75\s*L\b", "0.75L")
    return F.trim(F.regexp_replace(text, r"(?iU)\bбел(\s+|[;:]\s*)сух\b", "бел. сух."))


def first_reason(rules: tuple[tuple[str, Column], ...]) -> Column:
    """The name of the first rule that holds, in one expression; null where none does."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    return reason


def rejected_name(text: Column) -> Column:
    """Why a block is no part of a product name, the first reason that holds; null if it may be one."""
    low, plain = F.trim(F.translate(F.lower(text), "ё", "е")), digits(text)
    letters = F.length(F.regexp_replace(text, "[^a-zA-Zа-яА-Я]", ""))
    odd = F.length(F.regexp_replace(F.trim(text), r"[a-zA-Zа-яА-Я0-9\s.,()/]", ""))
    return first_reason((
        ("empty", low.isNull() | (low == "")),
        ("service", low.startswith("__")),
        ("date", text.rlike(DATE)),
        ("time", low.rlike("^[0-9]{1,2}[:.][0-9]{2}$")),
        ("discount", low.rlike(r"^-?\s*[0-9]{1,2}\s*%?$")),
        ("numeric", low.rlike("^[0-9\\s.,'\"*]+$")),
        ("long_digits", F.length(plain) >= 8),
        ("layout_code", low.rlike(r"^[0-9_\s-]+$") & (F.length(plain) >= 3)),
        ("service_label", low.rlike(SERVICE)),
        ("no_letters", letters == 0),
        ("too_many_specials", (odd > F.length(F.trim(text)) * 0.45) & (letters <= 2)),
    ))


#: Texts that stand on regular labels beside the name.
NOT_NAMES = (
    "без карты", "с картой", "с карт", "c карт", "картой", "карты", "боз карты", "бвз карты", "баз карты", "ба1 карты", "б8э карты", "цена", "руб", "₽",
    "за 1 кг", "за 100г", "за 100 г", "за 1 шт", "шт.", "код", "номер на весах", "номер на вес", "номep на весах", "детской картой", "арт",
)


def regular_noise(text: Column) -> Column:
    """Why a block of a regular label is no part of its name, the first reason that holds; null if it may be one."""
    low = F.trim(F.translate(F.lower(text), "ё", "е"))
    plain = digits(low)
    short = F.length(plain).between(1, 6) & ~low.rlike(r"[a-zа-я]")
    marker = F.lit(False)
    for words in NOT_NAMES:
        marker = marker | low.contains(words)
    return first_reason((
        ("empty", low.isNull() | (low == "")),
        ("service", low.startswith("__")),
        ("signs", low.rlike("^[-%.,₽]+$")),
        ("digits", (plain != "") & (plain == low)),
        ("long_digits", F.length(plain) >= 10),
        ("date", low.rlike(DATE)),
        ("time", low.rlike("^[0-9]{1,2}[:.][0-9]{2}$")),
        ("discount", low.contains("%")),
        ("price", short),
        ("marker", marker),
    ))


def clean_regular_name(text: Column) -> Column:
    """Spacing, fractions and the words for peeling and sorting in one spelling."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\s+([,.)])", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"([(])\s+", "$1"), r"([A-Za-zА-Яа-я]+\d+)\s*/\s*(\d+)", "$1/$2")
    peeled = lambda t: F.regexp_replace(t, r"(?iU)\bочищ\s+1\s+сорт\b", "очищ. 1 сорт")
    text = peeled(F.regexp_replace(text, r"(?iU)\bочищ:", "очищ."))
    return F.trim(peeled(F.regexp_replace(text, r"(?iU)(?<!\d\s)\bсорт вес\b", "1 сорт вес")))


def lenient_int(text: Column) -> Column:
    """A whole number through a decimal one; anything else is 0."""
    return F.coalesce(F.trim(text).try_cast("double").try_cast("long"), F.lit(0))


def lenient_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y"), F.lit(False))


def lenient_object(text: Column) -> Column:
    """The fields of a JSON object as a map of texts; anything else is an empty one."""
    given = F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    return F.coalesce(given, F.create_map().cast("map<string,string>"))
