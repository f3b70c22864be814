"""Column functions of the consolidation operators. Built-in expressions only; none fails on malformed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings in kopecks that derived prices may have.
KOPECKS = (0, 9, 17, 19, 21, 47, 51, 78, 79, 89, 90, 95, 99)
NAME_PATTERN = "[a-zа-я0-9]+(?:[./-][a-zа-я0-9]+)*"


def number(text: Column) -> Column:
    """A number with point or comma; anything else is null."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def parse_price(text: Column) -> Column:
    """Lenient: comma as point, other characters dropped; blank, several points or nothing left give null."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "[^0-9.]", "").try_cast("double")


def parse_price_strict(text: Column) -> Column:
    """Strict: other characters make it null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), plain.try_cast("double"))


def clean_qr_price(text: Column) -> Column:
    """Comma to point; spaces go when the rest is a number, else the text stays."""
    point = F.replace(text, F.lit(","), F.lit("."))
    tight = F.replace(point, F.lit(" "), F.lit(""))
    return F.when(tight.rlike(r"^[0-9]+(\.[0-9]+)?$"), tight).otherwise(F.trim(point))


def format_price(text: Column, strip_zeros: bool = False) -> Column:
    """Two to four decimals; whole numbers and what is no price stay. strip_zeros: more than two lose trailing zeros."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    tail = F.split_part(plain, F.lit("."), F.lit(2))
    shown = F.when(F.length(tail) <= 2, F.concat(F.split_part(plain, F.lit("."), F.lit(1)), F.lit("."), F.rpad(tail, 2, "0")))
    longer = F.when(F.length(tail) <= 4, plain)
    if strip_zeros:
        longer = F.regexp_replace(F.regexp_replace(longer, "0+$", ""), r"\.$", "")
    return F.when(plain.rlike(r"^[0-9]+\.[0-9]{1,4}$"), F.coalesce(shown, longer)).otherwise(
        F.when(plain.rlike(r"^[0-9]+$"), plain).otherwise(text)
    )


def valid_ean13(code: Column) -> Column:
    """Thirteen digits whose weighted sum, 1 and 3 in turn, ends in zero."""
    n = F.substring(code, 1, 13).try_cast("long")
    digit = lambda i: F.call_function("div", n, F.lit(10 ** (13 - i))) % 10
    total = sum((digit(i) * (1 if i % 2 else 3) for i in range(2, 14)), digit(1))
    return F.coalesce(F.when(code.rlike("^[0-9]{13}$"), total % 10 == 0), F.lit(False))


def discount_share(text: Column) -> Column:
    """The first run of one or two digits, from 1 to 99, as a share."""
    n = F.regexp_extract(text, r"(\d{1,2})", 1).try_cast("int")
    return F.when(n.between(1, 99), n / 100)


def expected_price(card: Column, share: Column) -> Column:
    return F.when((card > 0) & share.between(0.01, 0.99), card / (1 - share))


def near(value: Column, expected: Column, ratio: float = 0.08, least: float = 30.0) -> Column:
    return F.abs(value - expected) <= F.greatest(F.lit(least), expected * ratio)


def derived_prices(text: Column, expected: Column) -> Column:
    """Prices that digit runs may mean: each window of four digits without leading zero with each ending, near expected."""
    plain = digits(text)
    places = F.when(F.length(plain) >= 4, F.sequence(F.lit(1), F.length(plain) - 3)).otherwise(F.array().cast("array<int>"))
    reach = F.greatest(F.lit(30.0), expected * 0.05)  # no ending adds a whole one, so only wholes in reach get endings
    fits = lambda v: (v >= 1000) & v.between(expected - reach - 1, expected + reach)
    wholes = F.filter(F.transform(places, lambda i: F.substring(plain, i, F.lit(4)).cast("int")), fits)
    ends = F.array(*(F.lit(k / 100) for k in KOPECKS))
    every = F.flatten(F.transform(wholes, lambda v: F.transform(ends, lambda k: F.round(v + k, 2))))
    return F.array_distinct(F.filter(every, lambda p: near(p, expected, 0.05)))


def suspiciously_low(card: Column, full: Column, discount: Column) -> Column:
    return (full >= 1000) & (card > 0) & (card < 200) & discount.isNotNull() & ~F.trim(discount).isin("", "нет")


def repair_variants(price: Column) -> Column:
    """A price that lost a leading digit: what it may have been."""
    more = F.when(price < 100, F.array(price + 900, price + 1900)).when(price < 1000, F.array(price + 1000, price + 2000))
    return F.array_distinct(F.concat(F.array(price), F.coalesce(more, F.array().cast("array<double>"))))


def normalise_text(text: Column) -> Column:
    """Lower case, ё as е, other signs as spaces, single spaces."""
    low = F.translate(F.lower(text), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^0-9a-zа-яà-öø-ÿß%.,/ -]+", " "), " +", " "))


def normalise_volume(text: Column) -> Column:
    """'0, 75 L' as '0.75l'."""
    point = F.regexp_replace(text, r"([0-9]) *, *([0-9])", "$1.$2")
    return F.regexp_replace(point, r"(?i)([0-9.]+) *(ml|cl|kg|l|g)\b", "$1$2")


def name_tokens(text: Column, pattern: str = NAME_PATTERN, stop_words: Column | None = None) -> Column:
    """Distinct tokens of two characters at least, in order of text order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))
    found = F.filter(found, lambda t: F.length(t) >= 2)
    return found if stop_words is None else F.array_except(found, stop_words)


def strong_tokens(tokens: Column, common: Column | None = None) -> Column:
    strong = F.filter(tokens, lambda t: (F.length(t) >= 4) & t.rlike(r"[\p{L}0-9]"))
    return strong if common is None else F.array_except(strong, common)


def name_readability(text: Column, useful: str = "(?!)") -> Column:
    """Letters and useful words count for a name; odd characters and single letters against it; 0 at least."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    letters, words, upper = count("[A-Za-z]"), count("[A-Za-z]{3,}"), count("[A-Z][a-z]+")
    odd = count("[^A-Za-z0-9 .,%]")
    single = F.size(F.filter(F.split(text, " "), lambda w: w.rlike("^[A-Za-z]$")))
    return F.greatest(F.lit(0), letters + 4 * words + 2 * upper + 6 * count(useful) - 3 * odd - 2 * single)


def _odd_name(text: Column, allowed: str) -> Column:
    """Blank, or over a quarter of characters that are no letters, digits, white space or allowed signs."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    odd = F.length(F.regexp_replace(plain, rf"(?U)[\p{{L}}\p{{N}}\s{allowed}]", ""))
    return (plain == "") | (odd * 4 > F.length(plain))


def noisy_name(text: Column) -> Column:
    """A name of a merged row that isn't one: odd (quotes are allowed), or of fewer than two words. Null is noisy."""
    words = F.size(F.regexp_extract_all(text, F.lit("[A-Za-zА-Яа-я0-9]+"), F.lit(0)))
    return F.coalesce(_odd_name(text, r".,()/\"'\-") | (words < 2), F.lit(True))


def noisy_search_name(text: Column, tokens: Column) -> Column:
    """A name too noisy to search for: odd, or of fewer than two product tokens (`names.product_tokens`). Null is noisy."""
    return F.coalesce(_odd_name(text, r".,()/\-") | (F.size(tokens) < 2), F.lit(True))


def first_known(*values: Column) -> Column:
    """The first value that is neither null nor empty nor zero."""
    return F.coalesce(*(F.when(~v.cast("string").isin("", "0", "0.0"), v) for v in values))


def close(left: Column, right: Column, tolerance: float = 0.01) -> Column:
    return F.coalesce(F.abs(left - right) <= tolerance + 1e-9, F.lit(False))


def same_text(left: Column, right: Column) -> Column:
    return F.coalesce(F.lower(F.trim(left)) == F.lower(F.trim(right)), F.lit(False))


def split_department(key: Column) -> tuple[Column, Column]:
    """Department and base of 'department/base'; what is missing is 'unknown'."""
    part = lambda i: F.coalesce(F.nullif(F.trim(F.get(F.split(key, "/", 2), F.lit(i))), F.lit("")), F.lit("unknown"))
    return part(0), part(1)


def valid_date(text: Column) -> Column:
    """The DD.MM.YYYY in a text, if there is such a day."""
    found = F.regexp_extract(text, r"([0-9]{2}[. ][0-9]{2}[. ][0-9]{4})", 1)
    return F.try_to_timestamp(F.translate(found, " ", "."), F.lit("dd.MM.yyyy")).cast("date")


def _counted(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def name_score(text: Column) -> Column:
    """How readable a name is when views are merged: letters, words of three characters and capital words count for it,
    signs of misreading, odd characters and single characters against it; 0 at least."""
    plain = F.trim(text)
    word = "[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9./-]*"
    words = F.regexp_extract_all(plain, F.lit(word), F.lit(0))
    letters, n = _counted(plain, "[A-Za-zА-Яа-яЁё]"), F.size(words)
    capital = F.size(F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}") & (F.upper(w) == w)))
    odd = 1 - _counted(plain, r"[A-Za-zА-Яа-яЁё0-9\s.,()/-]") / F.greatest(F.length(plain), F.lit(1))
    single = F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.greatest(n, F.lit(1))
    score = (
        letters * 0.1 + F.size(F.filter(words, lambda w: F.length(w) >= 3)) + F.when(letters > 0, 2.0).otherwise(0.0)
        + F.least(capital, F.lit(4)) * 0.5 - _counted(plain, r"[#@>={}\[\];|]") * 1.5
        - F.when(odd > 0.3, odd * 10).otherwise(0.0) - F.when(single > 0.35, 3.0).otherwise(0.0)
    )
    return F.when((plain == "") | (plain == "нет"), 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def price_text(text: Column) -> Column:
    """A price as it is read off a label: comma and rouble signs as point, one decimal made two, more than two cut; without
    a point the last two of five digits or more are kopecks."""
    tight = F.translate(F.regexp_replace(F.trim(text), r"\s+", ""), ",рРpP₽", "......")
    whole, rest = F.split_part(tight, F.lit("."), F.lit(1)), F.replace(F.regexp_replace(tight, r"^[^.]*\.", ""), F.lit("."), F.lit(""))
    rest = F.when(F.length(rest) == 1, F.concat(rest, F.lit("0"))).otherwise(F.substring(rest, 1, 2))
    split = F.concat(F.expr("''"), F.regexp_replace(tight, r"(..)$", ".$1"))
    shown = F.when(tight.contains("."), F.concat_ws(".", whole, rest)).when(F.length(tight) >= 5, split).otherwise(tight)
    return shown.try_cast("double")


def clean_scalar(text: Column) -> Column:
    """Output form of a field: white space as single spaces, unknown as an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_product_name(text: Column) -> Column:
    """Output form of a name: the volume 0.75 in one piece, no space before closing or after opening signs."""
    name = F.regexp_replace(clean_scalar(text), r"(?U)\b0\s*[,.]\s*75\s*([LlЛл])\b", "0.75$1")
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)\b0\s+75\s*([LlЛл])\b", "0.75$1"), r"(?U)\b075\s*([LlЛл])\b", "0.75$1")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s+([,.)])", "$1"), r"([(])\s+", "$1"))


def clean_code(text: Column) -> Column:
    """Output form of a code: its digits, or the absent marker."""
    plain = clean_scalar(text)
    return F.when(plain == "нет", plain).otherwise(digits(plain))


def kopeck_hint(text: Column) -> Column:
    """The last two digits of a block that hints at kopecks, `__kopeks__:NN`."""
    found = digits(text)
    return F.when(text.startswith("__kopeks__:") & (F.length(found) >= 2), F.right(found, F.lit(2)))


def whole_roubles(text: Column) -> Column:
    """The first run of two to five digits."""
    return F.regexp_extract(text, r"^\D*(\d{2,5})", 1).try_cast("int")
