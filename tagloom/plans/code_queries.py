"""Codes of labels, their agreement with what is printed, variants of blocks, candidates as items and the list of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import names as N
from tagloom.functions import scalars as S
from tagloom.operators import blocks as B
from tagloom.operators import catalog as C
from tagloom.operators import checks, summary
from tagloom.plans.block_queries import BLOCKS_SQL, block_rows
from tagloom.plans.stand_ins import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: A part's label: a code whose last digit is wrong for every seventh, as (order, text, left, top) of its blocks. By the
#: part it is whole, in three parts, in three with the zero of the middle lost, in the upper zone, after a lone digit at its
#: left, or beside a wrong one.
_BODY = "concat('400000', lpad(CAST(p_partkey * 791 % 1000000 AS STRING), 6, '0'))"
_SUM = " + ".join(f"CAST(substr(body, {i}, 1) AS INT) * {1 if i % 2 else 3}" for i in range(1, 13))
_LAST = f"CAST((10 - ({_SUM}) % 10 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS STRING)"
_KIND = "p_partkey % 6"
_LABEL = (
    (1, "p_name", "0", "0"),
    (2, "'24.12.2025 12:46'", "0", "40"),
    (3, f"CASE WHEN {_KIND} IN (1, 2, 3, 4, 5) THEN substr(code, 8, 6) END", "300", f"CASE WHEN {_KIND} = 3 THEN 20 ELSE 100 END"),
    (4, f"CASE WHEN {_KIND} IN (1, 3, 4, 5) THEN substr(code, 2, 6) WHEN {_KIND} = 2 THEN substr(code, 3, 5) END", "200", f"CASE WHEN {_KIND} = 3 THEN 20 ELSE 98 END"),
    (5, f"CASE WHEN {_KIND} IN (1, 2, 3, 4, 5) THEN substr(code, 1, 1) END", "100", f"CASE WHEN {_KIND} = 3 THEN 20 ELSE 99 END"),
    (6, f"CASE WHEN {_KIND} = 4 THEN '7' WHEN {_KIND} = 5 THEN '4000000000000' END", "50", "100"),
    (7, f"CASE WHEN {_KIND} = 0 THEN concat(substr(code, 1, 1), ' ', substr(code, 2, 6), ' ', substr(code, 8, 6)) END", "60", "100"),
    (8, "'__kopeks__:99'", "400", "100"),
)


def _label_blocks(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(_BODY).alias("body"))
    parts = parts.withColumn("code", F.concat("body", F.expr(_LAST)))
    rows = ", ".join(f"struct({o} AS ord, {t} AS text, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)" for o, t, x, y in _LABEL)
    each = parts.select(F.col("p_partkey").alias("image"), F.expr(f"inline(array({rows}))")).where("text IS NOT NULL")
    box = F.array(F.struct("x", "y"), F.struct((F.col("x") + 40).alias("x"), (F.col("y") + 10).alias("y")))
    return B.bounds(each.select("image", "ord", "text", F.lit(0.9).alias("conf"), box.alias("box")))


def _sql(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


_LABEL_SQL = _sql(f"""w AS (SELECT p_partkey, p_name, {_BODY} AS body FROM part), c AS (SELECT *, concat(body, {_LAST}) AS code FROM w),
lb AS (""" + " UNION ALL ".join(f"SELECT p_partkey AS image, {o} AS ord, {t} AS text, {x} AS x, {y} AS y FROM c" for o, t, x, y in _LABEL) + ")")  # fmt: skip
_VALID = "list_sum([CAST(d AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END for d, i in string_split({0}, '')]) % 10 = 0 AND length({0}) = 13"


@query(f"""WITH {_LABEL_SQL}, g AS (SELECT image, min(y) AS lo, max(y + 10) AS hi FROM lb WHERE text IS NOT NULL AND NOT starts_with(text, '__') GROUP BY 1),
z AS (SELECT image, ord, regexp_replace(text, '[^0-9]', '', 'g') AS digits, x, y FROM lb JOIN g USING (image)
  WHERE text IS NOT NULL AND NOT starts_with(text, '__') AND y + 5 >= lo + (hi - lo) * 0.6),
t AS (SELECT image, 0 AS tier, ord AS place, digits AS code FROM z WHERE length(digits) = 13
  UNION ALL SELECT image, 1, row_number() OVER o, concat(digits, CASE WHEN length(lead(digits) OVER o) = 5 THEN '0' ELSE '' END, lead(digits) OVER o, lead(digits, 2) OVER o)
  FROM z WHERE length(digits) IN (1, 5, 6, 13) WINDOW o AS (PARTITION BY image ORDER BY x, y))
SELECT image, arg_min(code, tier * 100 + place) AS barcode FROM t WHERE {_VALID.format("code")} GROUP BY image""")
def label_barcode(spark, sf_dir):
    """Codes of labels, whole or in parts, some without the zero of the middle part, some wrong."""
    return B.barcode(_label_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS_SQL}, v AS (SELECT image, ord, ord % 3 AS variant, conf, CASE line WHEN 2 THEN 'С КАРТОЙ 99 руб' WHEN 3 THEN concat(right(text, 1), ' %')
  WHEN 5 THEN '%' WHEN 6 THEN '#~=' WHEN 7 THEN 'Вино сухое' ELSE text END AS text FROM b),
u AS (SELECT *, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n FROM v WHERE NOT starts_with(text, '__')),
s AS (SELECT image, variant, string_agg(lower(text), chr(10) ORDER BY ord) AS blob, count(*) AS n, avg(conf) AS conf, count(*) FILTER (n BETWEEN 2 AND 4) AS prices,
  count(*) FILTER (n > 0) AS numbers, count(*) FILTER (n = 13) AS codes, count(*) FILTER (regexp_full_match(text, '[#~=%]+')) AS noise FROM u GROUP BY 1, 2),
q AS (SELECT image, variant, round(least(n, 30) * 0.8 + conf * 8 + codes * 8 + least(prices, 10) * 2 + least(numbers, 15) * 0.8 - noise * 1.2
  + CASE WHEN regexp_matches(blob, '[0-9]{{1,2}}[ \\n]*%') THEN 8 WHEN contains(blob, '%') THEN 4 ELSE 0 END
  + 4 * (""" + " + ".join(f"CAST(contains(blob, '{w}') AS INTEGER)" for w in B.LABEL_WORDS) + """)
  - CASE WHEN numbers = 0 THEN 8 ELSE 0 END - CASE WHEN n < 4 THEN 5 ELSE 0 END, 4) AS score FROM s),
a AS (SELECT DISTINCT image, variant, coalesce(score, 0) AS score FROM v LEFT JOIN q USING (image, variant))
SELECT image, variant, CAST(round(score * 1000) AS BIGINT) AS thousandths FROM a
QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, variant) = 1""")  # fmt: skip
def best_block_variant(spark, sf_dir):
    """Of the readings of an image in three variants the one that looks most like a price label."""
    texts = F.expr(
        "CASE line WHEN 2 THEN 'С КАРТОЙ 99 руб' WHEN 3 THEN concat(right(text, 1), ' %') WHEN 5 THEN '%' WHEN 6 THEN '#~=' "
        "WHEN 7 THEN 'Вино сухое' ELSE text END"
    )
    rows = block_rows(spark, sf_dir).select("image", "ord", (F.col("ord") % 3).alias("variant"), texts.alias("text"), "conf")
    best = B.best_variant(rows, "image", "variant")
    return best.select("image", "variant", F.round(F.col("score") * 1000).cast("long").alias("thousandths"))


#: Readings with a code: prices in hundredths are printed as they are, in rubles with a comma, by 100 g or not at all.
_REPORT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS filename,
CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * 10 AS DECIMAL(20, 0)) AS base,
CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('4600', CAST(l_partkey AS STRING)) END AS barcode,
CASE l_partkey % 5 WHEN 0 THEN 'НЕТ' WHEN 1 THEN concat(' 4600', CAST(l_partkey AS STRING), ' ') WHEN 2 THEN '4600' ELSE concat('4600', CAST(l_partkey AS STRING)) END AS qr_code_barcode
FROM lineitem"""
_PRICES = """CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', CAST(CAST(base / 1000 AS DECIMAL(20, 2)) AS STRING)) WHEN 2 THEN replace(CAST(CAST(base / 1000 AS DECIMAL(20, 2)) AS STRING), '.', ',') ELSE 'от 5' END AS price_default,
CASE l_partkey % 4 WHEN 0 THEN CAST(CAST(base / 1000 AS DECIMAL(20, 2)) AS STRING) WHEN 1 THEN CAST(CAST(base / 100 AS DECIMAL(20, 2)) AS STRING) WHEN 2 THEN 'нет' ELSE CAST(CAST(base / 1000 + 7 AS DECIMAL(20, 2)) AS STRING) END AS price1_qr,
CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN concat('1 ', CAST(l_suppkey % 100 + 100 AS STRING), ',50') ELSE CAST(l_suppkey AS STRING) END AS price_card,
CASE l_partkey % 3 WHEN 0 THEN concat('1', CAST(l_suppkey % 100 + 100 AS STRING), '.5') WHEN 1 THEN concat('1', CAST(l_suppkey % 100 + 100 AS STRING), '5') ELSE CAST(l_suppkey * 10 AS STRING) END AS price2_qr"""
_CENTS = "try_cast(replace(replace(trim({0}), ' ', ''), ',', '.') AS DOUBLE)"
_MATCH = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN '' WHEN abs({0} - {1}) <= 0.01 OR abs({1} / 10 - {0}) <= 0.01 THEN 'true' ELSE 'false' END"
_TENTH = "coalesce(abs({0} - {1}) > 0.01 AND abs({1} / 10 - {0}) <= 0.01, false)"


@query(_sql(f"""WITH r AS ({_REPORT}), q AS (SELECT *, {_PRICES} FROM r),
n AS (SELECT *, {_CENTS.format("price_default")} AS a, {_CENTS.format("price1_qr")} AS b, {_CENTS.format("price_card")} AS c, {_CENTS.format("price2_qr")} AS d FROM q)
SELECT filename, barcode, qr_code_barcode, CASE WHEN qr_code_barcode = 'НЕТ' OR barcode = '' THEN '' WHEN trim(qr_code_barcode) = barcode THEN 'true' ELSE 'false' END AS barcode_match,
coalesce(price_default, '') AS price_default, price1_qr, {_MATCH.format("a", "b")} AS price1_match, price_card, price2_qr, {_MATCH.format("c", "d")} AS price2_match,
CASE WHEN {_TENTH.format("a", "b")} OR {_TENTH.format("c", "d")} THEN '{checks.PER_KILOGRAM}' ELSE '' END AS notes FROM n"""))  # fmt: skip
def code_report(spark, sf_dir):
    """What is printed beside what the code says, for every reading."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_columns(_REPORT)).selectExpr("*", *_columns(_PRICES))
    return checks.code_report(rows)


def _columns(sql: str) -> list[str]:
    """The expressions of a select list, which lie on lines or after commas outside brackets."""
    text = sql.removeprefix("SELECT ").removesuffix("FROM lineitem")
    depth, at, found, quoted = 0, 0, [], False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                found.append(text[at:i])
                at = i + 1
    return [*found, text[at:]]


@query("""WITH q AS (SELECT l_orderkey AS query, l_linenumber AS place, l_suppkey, l_partkey FROM lineitem),
k AS (SELECT query, place, p_name AS fullname, CASE l_suppkey % 5 WHEN 0 THEN 'gone' WHEN 1 THEN NULL ELSE p_brand END AS code FROM q JOIN part ON l_partkey = p_partkey WHERE place <= 5),
i AS (SELECT p_name AS fullname, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS code, max(p_partkey) AS item_id FROM part GROUP BY 1, 2)
SELECT query, place, k.fullname, coalesce(k.code, '') AS code, item_id FROM k JOIN i ON k.fullname = i.fullname AND coalesce(k.code, '') = i.code""")
def candidate_items(spark, sf_dir):
    """Listed candidates back to catalogue items, by name and code."""
    part = table(spark, sf_dir, "part")
    code = F.when(F.col("l_suppkey") % 5 == 0, "gone").when(F.col("l_suppkey") % 5 == 1, F.lit(None)).otherwise(F.col("p_brand"))
    listed = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("fullname"), code.alias("code")
    )
    own = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand"))
    items = part.select(F.col("p_name").alias("fullname"), own.alias("code"), F.col("p_partkey").alias("item_id"))
    return C.candidate_items(listed, items, "query")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'fully_matched' WHEN 'O' THEN 'needs_review' ELSE 'partial_ocr' END"
_DEPARTMENT = "CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'wine/base1' WHEN 2 THEN 'dairy/base2' WHEN 3 THEN 'gastronomy' ELSE 'bread/base4' END"


@query(f"""WITH r AS (SELECT o_orderkey AS group_id, {_STATUS} AS status, {_DEPARTMENT} AS department, o_orderkey % 3000 / 4.0 AS seconds FROM orders)
SELECT group_id, status, department, CAST(seconds AS DOUBLE) AS seconds, 'Проверка' AS status_name, 'warning' AS status_tone,
CASE department WHEN 'unknown' THEN 'Неизвестный отдел' WHEN 'wine/base1' THEN 'Вино - base1' WHEN 'dairy/base2' THEN 'Молочная категория - base2' WHEN 'gastronomy' THEN 'Гастрономия' ELSE 'bread - base4' END AS department_name,
CASE WHEN seconds < 60 THEN concat(CAST(CAST(floor(seconds * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR), '.', CAST(CAST(floor(seconds * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR), ' сек')
ELSE concat(CAST(floor(seconds / 60) AS BIGINT), ' мин ', CAST(floor(seconds % 60 + 0.5) AS BIGINT), ' сек') END AS runtime FROM r WHERE status = 'needs_review'""")
def result_list(spark, sf_dir):
    """The results that need a review, as a list shows them: filtered, named and ordered."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("group_id"), F.expr(_STATUS).alias("status"), F.expr(_DEPARTMENT).alias("department"),
        (F.col("o_orderkey") % 3000 / 4).alias("seconds"),
    )
    return summary.result_list(rows, "needs_review")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS plain, list_distinct(regexp_extract_all(
  regexp_replace(replace(lower(text), 'ё', 'е'), '[#@>={}\[\]|;]', ' ', 'g'), '[a-zа-я0-9]+(?:[./-][a-zа-я0-9]+)*')) AS tokens FROM documents)
SELECT doc_id, plain = '' OR length(regexp_replace(plain, '[\p{L}\p{N}\s.,()/-]', '', 'g')) * 4 > length(plain)
  OR len(list_filter(tokens, lambda x: length(x) >= 2)) < 2 AS noisy FROM t""")
def noisy_search_name(spark, sf_dir):
    tokens = F.filter(S.name_tokens(N.normal_name(F.col("text"))), lambda t: F.length(t) >= 2)
    return table(spark, sf_dir, "documents").select("doc_id", S.noisy_search_name(F.col("text"), tokens).alias("noisy"))
