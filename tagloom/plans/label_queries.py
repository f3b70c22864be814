"""Label types, extraction by family, payload fields, conflicts and summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import label_text as T
from tagloom.functions.scalars import noisy_name
from tagloom.operators import blocks as B
from tagloom.operators import labels as L
from tagloom.operators import payloads, summary
from tagloom.plans.stand_ins import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: Texts of the stand-in blocks; `{...}` differ between the engines.
_TEXTS = """CASE l_partkey % 16 WHEN 0 THEN 'с картой' WHEN 1 THEN 'без карты' WHEN 2 THEN 'цена за 1 кг'
WHEN 3 THEN concat('-', l_suppkey % 60 + 10, '%') WHEN 4 THEN 'Ш' WHEN 5 THEN 'к' WHEN 6 THEN 'номер на весах'
WHEN 7 THEN '__service__' WHEN 8 THEN concat({date}, CASE WHEN l_suppkey % 2 = 0 THEN ' 10:30' ELSE '' END)
WHEN 9 THEN CAST(l_suppkey % 90 + 10 AS {text}) WHEN 10 THEN CAST(l_partkey * 1000003 % 9000000000 + 1000000000 AS {text})
WHEN 11 THEN 'вино полусухое' WHEN 12 THEN 'QR' WHEN 13 THEN '100 гр' ELSE
CAST(CAST(round(l_extendedprice * 100) AS {long}) % 9900 + 100 AS {text}) END"""


def _label_blocks(spark, sf_dir) -> DataFrame:
    """lineitem as blocks of labels: an order is an image."""
    left, top = F.col("l_partkey") % 400, F.col("l_linenumber") * 60 + F.col("l_suppkey") % 40
    right, bottom = left + 20 + F.col("l_partkey") % 70, top + 10 + F.col("l_partkey") % 30
    order = F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")
    text = F.expr(_TEXTS.format(date="date_format(l_shipdate, 'dd.MM.yyyy')", text="string", long="long"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), order.cast("long").alias("ord"), text.alias("text"),
        (F.col("l_partkey") % 100 / 100).alias("conf"),
        *(c.cast("double").alias(n) for c, n in ((left, "left"), (right, "right"), (top, "top"), (bottom, "bottom"))),
    )


def _colors(spark, sf_dir) -> DataFrame:
    color = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'red' WHEN o_orderkey % 3 = 1 THEN 'white' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), color.alias("color"))


_FLAG_SQL = ", ".join(f"regexp_matches(t, '{p}') AS {n}" for n, p in L.FLAGS.items())
_UNIT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in L.UNITS) + " ELSE 'unknown' END"
_MECHANIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in B.MECHANICS) + " ELSE 'regular' END"
LABELS_SQL = f"""
b AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord,
  {_TEXTS.format(date="strftime(l_shipdate, '%d.%m.%Y')", text="VARCHAR", long="BIGINT")} AS text,
  (l_partkey % 100) / 100.0::DOUBLE AS conf, CAST(l_partkey % 400 AS DOUBLE) AS "left",
  CAST(l_partkey % 400 + 20 + l_partkey % 70 AS DOUBLE) AS "right", CAST(l_linenumber * 60 + l_suppkey % 40 AS DOUBLE) AS top,
  CAST(l_linenumber * 60 + l_suppkey % 40 + 10 + l_partkey % 30 AS DOUBLE) AS bottom FROM lineitem),
w AS (SELECT image, coalesce(lower(string_agg(text, chr(10) ORDER BY ord, text) FILTER (NOT starts_with(text, '__'))), '') AS t,
  bool_or(length(regexp_replace(text, '[^0-9]', '', 'g')) >= 12) AS has_barcode,
  count(*) FILTER (length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 2 AND 4) AS price_like FROM b GROUP BY image),
f AS (SELECT image, t, has_barcode, price_like, CASE o_orderkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'white' END AS color,
  {_FLAG_SQL}, {_UNIT_SQL} AS unit_type, {_MECHANIC_SQL} AS mechanic FROM w LEFT JOIN orders ON image = o_orderkey),
g AS (SELECT *, coalesce(color = 'red' AND (has_discount OR price_like >= 2), FALSE) AS red,
  has_card_price AND has_default_price AS pair FROM f),
types AS (SELECT image, unit_type, has_barcode, has_scale_number, is_child, has_qr, price_like, red OR has_card_price AS has_card_price,
  red OR has_default_price AS has_default_price, red OR has_discount AS has_discount, CASE WHEN red THEN '{L.RED}'
  WHEN pair AND mechanic = 'regular' THEN '{L.REGULAR}' WHEN pair AND mechanic = 'promo' THEN '{L.PROMO}' ELSE 'unknown' END
  AS family, CASE WHEN red OR pair THEN 'gm_6x6' ELSE 'unknown' END AS format, CASE WHEN red THEN 'promo' ELSE mechanic END
  AS mechanic, CAST(CASE WHEN red THEN CASE WHEN has_discount THEN 0.7 ELSE 0.55 END WHEN pair AND mechanic = 'regular' THEN
  CASE WHEN has_scale_number OR has_barcode OR has_qr THEN 0.8 ELSE 0.7 END WHEN pair AND mechanic = 'promo' THEN 0.7
  ELSE 0 END AS DOUBLE) AS confidence FROM g),
z AS (SELECT *, ((top + bottom) / 2 - min(top) OVER i) / nullif(max(bottom) OVER i - min(top) OVER i, 0) AS depth,
  min("left") OVER i AS x0, max("right") OVER i AS x1, min(top) OVER i AS y0, max(bottom) OVER i AS y1
  FROM b WINDOW i AS (PARTITION BY image)),
d AS (SELECT * FROM b WHERE regexp_matches(text, '^[0-9]+$')),
m AS (SELECT * FROM d WHERE length(text) BETWEEN 3 AND 4 QUALIFY row_number() OVER (PARTITION BY image
  ORDER BY top - bottom, ord, text, "left") = 1),
k AS (SELECT m.image, v.text FROM m JOIN d v ON m.image = v.image AND v."left" >= m."right" - 5 WHERE length(v.text) = 2
  QUALIFY row_number() OVER (PARTITION BY m.image ORDER BY abs(v.top - m.top), v."left" - m."right", v.ord, v.text) = 1),
price AS (SELECT m.image, concat(m.text, '.', coalesce(k.text, '00')) AS price FROM m LEFT JOIN k ON m.image = k.image),
day AS (SELECT image, text AS date FROM b WHERE regexp_matches(text, '^[0-9]{{2}}\\.[0-9]{{2}}\\.')
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY length(text) < 12, top + bottom DESC, ord, text) = 1),
low AS (SELECT *, min(top) OVER i AS t0, max(bottom) OVER i - min(top) OVER i AS h, (top + bottom) / 2 AS cy FROM b WHERE NOT starts_with(text, '__') WINDOW i AS (PARTITION BY image)),
sku AS (SELECT image, text AS id_sku FROM low WHERE regexp_matches(text, '^[0-9]{{10,12}}$')
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY h = 0 OR cy < t0 + h * 0.6::DOUBLE, 12 - length(text), "left" + "right", cy, ord) = 1),
long AS (SELECT image, regexp_replace(text, '[^0-9]', '', 'g') AS code FROM b WHERE length(regexp_replace(text, '[^0-9]', '', 'g')) >= 10
  AND NOT regexp_matches(text, '[0-9]{{2}}\\.[0-9]{{2}}\\.') QUALIFY row_number() OVER (PARTITION BY image ORDER BY ord, code) = 1),
sign AS (SELECT image, string_agg(s, ' ' ORDER BY o, s) AS special_symbols FROM (SELECT image, upper(text) AS s, min(ord) AS o FROM z
  WHERE depth >= 0.55 AND conf >= 0.35 AND lower(text) IN ('к', 'л', 'ш') GROUP BY ALL) GROUP BY image),
cut AS (SELECT image, concat('-', v, '%') AS discount_amount FROM (SELECT image, ord, CASE WHEN contains(text, '%') THEN 0 ELSE 1 END
  AS tier, CASE WHEN contains(text, '%') THEN regexp_extract(text, '([0-9]{{1,2}})', 1)
  WHEN ("left" + "right") / 2 <= x0 + (x1 - x0) * 0.45 AND (top + bottom) / 2 >= y0 + (y1 - y0) * 0.35 AND
  (length(regexp_replace(text, '[^0-9]', '', 'g')) = 2 OR length(regexp_replace(text, '[^0-9]', '', 'g')) = 3
  AND ends_with(text, '9')) THEN substr(regexp_replace(text, '[^0-9]', '', 'g'), 1, 2) END AS v FROM z)
  WHERE CAST(v AS INTEGER) >= 10 QUALIFY row_number() OVER (PARTITION BY image ORDER BY tier, ord, v) = 1)
"""


@query(f"WITH {LABELS_SQL} SELECT * FROM types")
def label_types(spark, sf_dir):
    return L.classify(_label_blocks(spark, sf_dir), _colors(spark, sf_dir))


@query(f"""WITH {LABELS_SQL} SELECT t.image, t.family, price AS price_card, date AS print_datetime,
CASE WHEN family IN ('{L.RED}', '{L.REGULAR}') THEN id_sku ELSE code END AS id_sku,
CASE WHEN family = '{L.RED}' THEN discount_amount END AS discount_amount,
CASE WHEN family IN ('{L.RED}', '{L.REGULAR}') THEN special_symbols END AS special_symbols
FROM types t LEFT JOIN price USING (image) LEFT JOIN day USING (image) LEFT JOIN sku USING (image) LEFT JOIN long USING (image)
LEFT JOIN cut USING (image) LEFT JOIN sign USING (image)""")
def label_extraction(spark, sf_dir):
    rows = _label_blocks(spark, sf_dir)
    return L.extract(rows, L.classify(rows, _colors(spark, sf_dir)))


@query(f"""WITH {LABELS_SQL} SELECT image, CASE WHEN contains(t, 'полусладкое') THEN 'Полусладкое' WHEN contains(t, 'полусухое')
THEN 'Полусухое' WHEN contains(t, 'сладкое') THEN 'Сладкое' WHEN contains(t, 'сухое') THEN 'Сухое' END AS additional_info FROM w""")
def keyword_attribute(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.when(~F.col("text").startswith("__"), F.struct("ord", "text"))))
    text = F.lower(F.array_join(F.transform(lines, lambda p: p["text"]), "\n"))
    return _label_blocks(spark, sf_dir).groupBy("image").agg(text.alias("t")).select("image", L.sweetness(F.col("t")).alias("additional_info"))


_POLICY = """CASE o_orderkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'white' END AS color,
CASE WHEN o_custkey % 4 = 0 THEN '-15%' WHEN o_custkey % 4 = 1 THEN 'нет' ELSE '' END AS discount_amount,
CASE WHEN o_custkey % 5 = 0 THEN '99.90' END AS price_discount, CASE WHEN o_custkey % 7 = 0 THEN '3' ELSE '' END
AS wholesale_level_1_count"""


@query(f"""WITH r AS (SELECT o_orderkey, {_POLICY} FROM orders), f AS (SELECT *, CASE WHEN color IS NOT DISTINCT FROM 'red' OR
discount_amount NOT IN ('', 'нет') THEN '{L.RED}' WHEN color = 'white' THEN '{L.REGULAR}' ELSE 'unknown' END AS family FROM r)
SELECT o_orderkey, family, CASE WHEN family = '{L.REGULAR}' AND discount_amount = '' THEN 'нет' ELSE discount_amount END AS discount_amount,
CASE WHEN family != 'unknown' AND price_discount IS NULL THEN 'нет' ELSE price_discount END AS price_discount,
CASE WHEN family != 'unknown' AND wholesale_level_1_count = '' THEN 'нет' ELSE wholesale_level_1_count END AS wholesale_level_1_count FROM f""")
def family_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_split_aliases(_POLICY))
    family = L.infer_family(F.col("color"), F.col("discount_amount"))
    return L.absent_policy(rows.withColumn("family", family)).drop("color")


def _split_aliases(sql: str) -> list[str]:
    """The expressions of a SELECT list; none of them has a comma of its own."""
    return [part.strip() for part in sql.split(",")]


_PAYLOAD = """concat('https://label.example/q?b=', lpad(CAST(p_partkey * 1000003 AS {text}), 13, '4'), '&P1=1+', p_size, '50,5;price1=',
p_size, ',', p_partkey % 90 + 10, '&p2=%32', p_size, '&wl1c=', p_size, '&brand=', replace(p_brand, '#', ''), '&ap=#frag')"""


@query(f"""WITH p AS (SELECT p_partkey, p_size, lpad(CAST(p_partkey * 1000003 AS VARCHAR), 13, '4') AS code, replace(p_brand, '#', '')
AS brand FROM part), v AS (SELECT *, (SELECT sum(CAST(substr(code, i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)
FROM range(1, 14) AS s(i)) % 10 = 0 AS ok FROM p)
SELECT p_partkey, CASE WHEN ok THEN code ELSE '' END AS qr_code_barcode, concat(p_size, '.', p_partkey % 90 + 10) AS price1_qr,
concat('2', p_size) AS price2_qr, 'нет' AS price3_qr, CAST(p_size AS VARCHAR) AS wholesale_level_1_count, 'нет' AS action_price_qr,
brand FROM v""")
def qr_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PAYLOAD.format(text="string")).alias("payload"))
    found = payloads.qr_fields(rows, "p_partkey", "payload")
    shown = "qr_code_barcode price1_qr price2_qr price3_qr wholesale_level_1_count action_price_qr".split()
    return found.select("p_partkey", *shown, F.col("unknown")["brand"].alias("brand"))


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus != 'F' AND o_custkey % 3 != 0 THEN '15.5'
WHEN o_orderstatus = 'F' THEN '20' END AS price_default FROM orders""")
def qr_fallback_price(spark, sf_dir):
    full, family = F.expr("IF(o_orderstatus = 'F', '20', NULL)"), F.expr(f"IF(o_custkey % 2 = 0, '{L.RED}', '{L.REGULAR}')")
    first = F.expr("IF(o_custkey % 3 = 0, 'нет', '15.5')")
    return table(spark, sf_dir, "orders").select("o_orderkey", payloads.fallback_price(family, full, first).alias("price_default"))


_GROUPS = """
g AS (SELECT user_id AS group_id, count(*) AS total_views, count(*) FILTER (value > 20) AS processed_views,
  sum(CAST(round(value * 1000) AS BIGINT)) AS ms, max(event_id) AS last FROM events GROUP BY user_id),
r AS (SELECT *, ['high', 'medium', 'low', 'none'][last % 4 + 1] AS confidence, CASE last % 5 WHEN 0 THEN '' WHEN 1 THEN 'ab'
  ELSE 'Green tea leaves' END AS product_name, CASE WHEN last % 7 = 0 THEN 'нет' ELSE '10' END AS price_card,
  CASE WHEN last % 3 = 0 THEN 'red' ELSE 'white' END AS color, CASE WHEN last % 6 < 4 THEN '-15%' END AS discount_amount,
  CASE WHEN last % 8 > 2 THEN '46' END AS barcode, CASE WHEN last % 8 = 1 THEN '46' END AS qr_code_barcode FROM g),
x AS (SELECT *, list_filter([CASE WHEN confidence != 'high' THEN 'not_high' END, CASE WHEN last % 5 < 2 THEN 'bad_name' END,
  CASE WHEN price_card = 'нет' THEN 'no_card_price' END, CASE WHEN color = 'red' AND discount_amount IS NULL THEN
  'red_without_discount' END, CASE WHEN barcode IS NULL AND qr_code_barcode IS NULL THEN 'no_code' END,
  CASE WHEN confidence != 'high' AND processed_views = total_views THEN 'all_views_used' END], lambda s: s IS NOT NULL) AS reasons FROM r)
"""


def _groups(spark, sf_dir) -> DataFrame:
    """events as merged rows with their match: a user is a group, the fields follow from its last event."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("group_id")).agg(
        F.count(F.lit(1)).alias("total_views"), F.count_if(F.col("value") > 20).alias("processed_views"),
        F.sum(F.round(F.col("value") * 1000).cast("long")).alias("seconds"), F.max("event_id").alias("last"),
    )
    return rows.withColumns({
        "confidence": F.expr("element_at(array('high', 'medium', 'low', 'none'), int(last % 4 + 1))"),
        "product_name": F.expr("CASE last % 5 WHEN 0 THEN '' WHEN 1 THEN 'ab' ELSE 'Green tea leaves' END"),
        "price_card": F.expr("IF(last % 7 = 0, 'нет', '10')"), "color": F.expr("IF(last % 3 = 0, 'red', 'white')"),
        "discount_amount": F.expr("IF(last % 6 < 4, '-15%', NULL)"), "barcode": F.expr("IF(last % 8 > 2, '46', NULL)"),
        "qr_code_barcode": F.expr("IF(last % 8 = 1, '46', NULL)"), "early_stopped": F.col("processed_views") < F.col("total_views"),
    }).withColumn("reasons", summary.problem_reasons(noisy_name(F.col("product_name"))))


@query(f"WITH {_GROUPS} SELECT group_id, array_to_string(reasons, ' ') AS reasons FROM x WHERE len(reasons) > 0")
def problem_groups(spark, sf_dir):
    return _groups(spark, sf_dir).where(F.size("reasons") > 0).select("group_id", F.array_join("reasons", " ").alias("reasons"))


@query(f"""WITH {_GROUPS} SELECT count(*) AS total_groups, count(*) FILTER (confidence = 'high') AS high_count,
count(*) FILTER (confidence = 'medium') AS medium_count, count(*) FILTER (confidence = 'low') AS low_count,
count(*) FILTER (confidence = 'none') AS none_count, CAST(sum(total_views) AS BIGINT) AS total_views,
CAST(sum(processed_views) AS BIGINT) AS processed_views, CAST(sum(total_views - processed_views) AS BIGINT) AS skipped_views,
round(sum(processed_views) / sum(total_views), 3) AS processed_views_ratio,
count(*) FILTER (processed_views < total_views) AS early_stopped_count, count(*) FILTER (len(reasons) > 0) AS problem_count,
arg_max(group_id, ROW(ms, group_id)) AS slowest_group FROM x""")
def run_summary(spark, sf_dir):
    return summary.run_summary(_groups(spark, sf_dir))


@query(f"""WITH {_GROUPS} SELECT group_id, confidence = 'high' AND total_views >= 70 AND total_views % 20 + 10 >= 15
AND (barcode IS NOT NULL OR qr_code_barcode IS NOT NULL OR product_name = 'Green tea leaves' AND discount_amount IS NOT NULL)
AS enough FROM r""")
def early_stop(spark, sf_dir):
    rows = _groups(spark, sf_dir).withColumns({"id_sku": F.lit(None).cast("string"), "price_default": F.lit("")})
    stop = summary.enough(F.col("confidence"), F.col("total_views"), F.col("total_views") % 20 + 10)
    return rows.select("group_id", stop.alias("enough"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'Sweet red wine' END AS name,
['high', 'medium', 'low'][p_partkey // 3 % 3 + 1] AS confidence, lpad(CAST(p_partkey * 1000003 AS VARCHAR), 13, '4') AS code,
count(*) OVER (PARTITION BY p_name) = 1 AS alone, p_name FROM part), v AS (SELECT *, (SELECT sum(CAST(substr(code, i, 1)
AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FROM range(1, 14) AS s(i)) % 10 = 0 AS ok FROM c)
SELECT p_partkey, CASE WHEN confidence = 'high' OR confidence = 'medium' AND name IN ('', 'x') THEN p_name ELSE name END
AS product_name, CASE WHEN confidence = 'high' AND alone AND ok THEN code END AS barcode FROM v""")
def catalog_enrich(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    alone = part.groupBy("p_name").agg((F.count(F.lit(1)) == 1).alias("alone"))
    rows = part.join(alone, "p_name").select(
        "p_partkey", "p_name", "alone", F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'Sweet red wine' END").alias("name"),
        F.expr("element_at(array('high', 'medium', 'low'), int(p_partkey div 3 % 3 + 1))").alias("confidence"),
        F.expr("lpad(string(p_partkey * 1000003), 13, '4')").alias("code"),
    )
    name, sure = F.col("name"), F.col("confidence")
    return rows.select(
        "p_partkey", summary.catalogue_name(name, noisy_name(name), sure, F.col("p_name")).alias("product_name"),
        summary.catalogue_code(F.lit(None).cast("string"), sure, F.col("code"), F.col("alone")).alias("barcode"),
    )


@query("""WITH n AS (SELECT p_size AS query, p_name AS name, min(p_partkey) AS place, list_filter(list_distinct(string_split(lower(p_name), ' ')),
lambda t: length(t) >= 4) AS tokens FROM part GROUP BY p_size, p_name QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY min(p_partkey)) <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) AS turn, count(*) OVER (PARTITION BY query) AS names FROM n),
t AS (SELECT query, turn, names, unnest(tokens) AS token FROM k),
u AS (SELECT *, count(*) OVER (PARTITION BY query, token) AS have FROM t),
s AS (SELECT DISTINCT p_size AS query, unnest(string_split(CASE WHEN p_partkey % 4 = 0 THEN lower(p_name) ELSE concat(substr(p_name, 1, 2), ' ', p_size) END, ' ')) AS token FROM part),
h AS (SELECT query, list(token ORDER BY token) FILTER (turn = 1) AS matched, count(*) FILTER (turn > 1) AS others
FROM u JOIN s USING (query, token) WHERE have <= greatest(1, names // 2) GROUP BY query),
r AS (SELECT query, names, coalesce(len(matched), 0) AS n, coalesce(others, 0) AS others, matched[1] AS first,
coalesce(array_to_string(matched, ' '), '') AS matched FROM (SELECT DISTINCT query, names FROM k) LEFT JOIN h USING (query)),
o AS (SELECT *, CASE WHEN names < 2 OR others > 0 OR n = 0 THEN 0 WHEN n >= 2 THEN 20 WHEN length(first) >= 5 THEN 15 ELSE 8 END AS bonus FROM r)
SELECT query, CASE WHEN bonus >= 15 THEN 'high' WHEN bonus = 8 THEN 'medium' ELSE 'conflict' END AS confidence, bonus, matched FROM o""")
def conflict_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = F.split(F.lower("p_name"), " ")
    strong = F.array_distinct(F.filter(words, lambda t: F.length(t) >= 4))
    named = part.groupBy(F.col("p_size").alias("query"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("place"), F.first(strong).alias("tokens"))
    misread = F.split(F.concat_ws(" ", F.substring("p_name", 1, 2), "p_size"), " ")  # most names are read too badly to tell
    said = part.select(F.col("p_size").alias("query"), F.when(F.col("p_partkey") % 4 == 0, words).otherwise(misread).alias("tokens"))
    return summary.resolve_conflict(named, said, "query").withColumn("matched", F.array_join("matched", " "))


_BEFORE = "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END"


@query(f"""WITH f AS (SELECT o_orderkey AS key, unnest(['name', 'status']) AS field, unnest([{_BEFORE}, o_orderstatus]) AS old,
unnest([o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END]) AS new FROM orders)
SELECT field, CASE WHEN old != new THEN 'catalog' ELSE 'vote' END AS source, count(*) AS n FROM f GROUP BY ALL""")
def field_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("key", F.col("o_orderkey"))
    before = rows.select("key", F.expr(_BEFORE).alias("name"), F.col("o_orderstatus").alias("status"))
    after = rows.select("key", F.col("o_orderpriority").alias("name"), F.expr("IF(o_custkey % 2 = 0, 'X', o_orderstatus)").alias("status"))
    long = [df.unpivot("key", ["name", "status"], "field", "value") for df in (before, after)]
    sources = long[0].select("key", "field", F.lit("vote").alias("source"))
    marked = summary.mark_sources(sources, summary.changed_fields(*long, ["key"]), ["key"], "catalog")
    return marked.groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS hits,
count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS misses FROM documents""")
def cache_counts(spark, sf_dir):
    return summary.cache_counts(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT user_id AS group_id, count(*) AS views, count(DISTINCT event_type) AS kinds FROM events WHERE user_id IN
(SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) GROUP BY user_id""")
def reported_groups(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    each = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("group_id")).agg(F.count(F.lit(1)).alias("views"), F.countDistinct("event_type").alias("kinds"))
    return each.join(ids, "group_id", "left_semi")


@query(f"""WITH {LABELS_SQL}, n AS (SELECT text, conf, lower(text) AS t, regexp_replace(text, '[^0-9]', '', 'g') AS n FROM b),
x AS (SELECT CASE WHEN starts_with(t, '__') THEN 'service' WHEN regexp_matches(text, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2,4}}') THEN 'date'
WHEN regexp_matches(t, '^-?\\s*[0-9]{{1,2}}\\s*%?$') THEN 'discount' WHEN regexp_matches(t, '^[0-9]+$') THEN 'numeric'
WHEN regexp_matches(t, 'без карт|с карт|картой|карты|руб|цена|от цены|скид|код') THEN 'service_label' END AS reason,
contains(t, 'карт') AND contains(t, 'без') AS without_card, contains(t, 'ном') AND contains(t, 'вес') AS scale_label,
length(n) BETWEEN 2 AND 4 AND conf >= 0.35 AS scale_number, CASE length(n) WHEN 6 THEN concat(n[1:4], '.', n[5:6])
WHEN 5 THEN concat(n[1:4], '.', n[5:5], '0') END AS price FROM n)
SELECT reason, without_card, scale_label, scale_number, price IS NOT NULL AS red_price, count(*) AS n,
count(*) FILTER (CAST(price AS DOUBLE) BETWEEN 1000 AND 2500) AS in_range FROM x GROUP BY ALL""")
def block_text_rules(spark, sf_dir):
    text, price = F.col("text"), T.red_price(F.col("text"))
    rows = _label_blocks(spark, sf_dir).select(
        T.rejected_name(text).alias("reason"), T.without_card(text).alias("without_card"), T.scale_label(text).alias("scale_label"),
        T.scale_number(text, F.col("conf")).alias("scale_number"), price.isNotNull().alias("red_price"), T.in_default_range(price).alias("fits"),
    )
    keys = ["reason", "without_card", "scale_label", "scale_number", "red_price"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("in_range"))
