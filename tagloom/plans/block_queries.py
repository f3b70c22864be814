"""Blocks, checks, codes and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators import blocks as B
from tagloom.operators import checks
from tagloom.plans.stand_ins import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def block_rows(spark, sf_dir) -> DataFrame:
    """lineitem as blocks: an order is an image. Places, sizes and texts follow from the keys."""
    left, top = F.col("l_partkey") % 400, F.col("l_linenumber") * 60 + F.col("l_suppkey") % 40
    right, bottom = left + 20 + F.col("l_partkey") % 70, top + 10 + F.col("l_partkey") % 30
    corners = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]
    text = F.expr(
        "CASE l_partkey % 6 WHEN 0 THEN concat('__kopeks__:', l_suppkey % 90 + 10) "
        "WHEN 1 THEN concat(date_format(l_shipdate, 'dd.MM.yyyy'), if(l_suppkey % 2 = 0, ' 10:30', '')) "
        "WHEN 2 THEN cast(l_suppkey % 90 + 10 AS string) "
        "WHEN 3 THEN cast(l_partkey * 1000003 % 9000000000 + 1000000000 AS string) "
        "ELSE cast(cast(round(l_extendedprice * 100) AS long) % 9900 + 100 AS string) END"
    )
    order = F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")
    return B.bounds(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("image"), order.cast("long").alias("ord"), text.alias("text"),
            (F.col("l_partkey") % 100 / 100).alias("conf"), F.array(*corners).alias("box"), F.col("l_linenumber").alias("line"),
        )
    )


BLOCKS_SQL = """
b AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord,
  CASE l_partkey % 6 WHEN 0 THEN concat('__kopeks__:', l_suppkey % 90 + 10)
  WHEN 1 THEN concat(strftime(l_shipdate, '%d.%m.%Y'), CASE WHEN l_suppkey % 2 = 0 THEN ' 10:30' ELSE '' END)
  WHEN 2 THEN CAST(l_suppkey % 90 + 10 AS VARCHAR) WHEN 3 THEN CAST(l_partkey * 1000003 % 9000000000 + 1000000000 AS VARCHAR)
  ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 9900 + 100 AS VARCHAR) END AS text,
  (l_partkey % 100) / 100.0::DOUBLE AS conf, l_linenumber AS line, CAST(l_partkey % 400 AS DOUBLE) AS "left",
  CAST(l_partkey % 400 + 20 + l_partkey % 70 AS DOUBLE) AS "right", CAST(l_linenumber * 60 + l_suppkey % 40 AS DOUBLE) AS top,
  CAST(l_linenumber * 60 + l_suppkey % 40 + 10 + l_partkey % 30 AS DOUBLE) AS bottom FROM lineitem),
p AS (SELECT * FROM b WHERE length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 1 AND 6
  AND NOT regexp_matches(text, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{2,4}') AND NOT starts_with(text, '__')),
z AS (SELECT *, ((top + bottom) / 2 - min(top) OVER i) / nullif(max(bottom) OVER i - min(top) OVER i, 0) AS depth
  FROM b WINDOW i AS (PARTITION BY image))
"""


@query(f"""WITH {BLOCKS_SQL} SELECT image, count(*) AS parts, min("left") AS left_most, max(bottom) AS lowest
FROM p WHERE conf >= 0.3 GROUP BY image""")
def block_filters(spark, sf_dir):
    rows = block_rows(spark, sf_dir).where(B.visible(0.3) & B.price_part(F.col("text")))
    return rows.groupBy("image").agg(F.count(F.lit(1)).alias("parts"), F.min("left").alias("left_most"), F.max("bottom").alias("lowest"))


@query(f"""WITH {BLOCKS_SQL} SELECT l.image, l.ord AS label, v.ord AS value, v.text, v.top - l.top AS gap
FROM b l JOIN p v ON l.image = v.image AND v.top >= l.top AND v.line > 1 WHERE l.line = 1
QUALIFY row_number() OVER (PARTITION BY l.image, l.ord ORDER BY v.top - l.top, abs(v."left" - l."left"), v.ord, v.text) = 1""")
def label_proximity(spark, sf_dir):
    rows = block_rows(spark, sf_dir).select("image", "ord", "text", "line", "left", "top")
    labels = rows.where("line = 1").dropDuplicates(["image", "ord"])
    values = rows.where((F.col("line") > 1) & B.price_part(F.col("text")))
    down = F.col("v.top") - F.col("l.top")
    return B.nearest(labels, values, down >= 0, [down, F.abs(F.col("v.left") - F.col("l.left"))])


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT * FROM b WHERE regexp_matches(text, '^[0-9]+$')),
m AS (SELECT * FROM d WHERE length(text) BETWEEN 3 AND 4 QUALIFY row_number() OVER (PARTITION BY image
  ORDER BY top - bottom, ord, text, "left") = 1),
k AS (SELECT m.image, v.text FROM m JOIN d v ON m.image = v.image AND v."left" >= m."right" - 5 WHERE length(v.text) = 2
  QUALIFY row_number() OVER (PARTITION BY m.image ORDER BY abs(v.top - m.top), v."left" - m."right", v.ord, v.text) = 1)
SELECT m.image, concat(m.text, '.', coalesce(k.text, '00')) AS price FROM m LEFT JOIN k ON m.image = k.image""")
def rouble_kopeck_pairs(spark, sf_dir):
    return B.main_price(block_rows(spark, sf_dir))


@query(f"""WITH {BLOCKS_SQL} SELECT image, text AS date FROM b WHERE regexp_matches(text, '^[0-9]{{2}}\\.[0-9]{{2}}\\.')
QUALIFY row_number() OVER (PARTITION BY image ORDER BY length(text) < 12, top + bottom DESC, ord, text) = 1""")
def latest_print_date(spark, sf_dir):
    return B.latest_date(block_rows(spark, sf_dir))


@query(f"""WITH {BLOCKS_SQL}, y AS (SELECT *, min(top) OVER i AS y0, max(bottom) OVER i - min(top) OVER i AS h, (top + bottom) / 2 AS cy
  FROM b WHERE NOT starts_with(text, '__') WINDOW i AS (PARTITION BY image))
SELECT image, text AS id_sku FROM y WHERE regexp_matches(text, '^[0-9]{{10,12}}$')
QUALIFY row_number() OVER (PARTITION BY image ORDER BY h = 0 OR cy < y0 + h * 0.6::DOUBLE, 12 - length(text), "left" + "right", cy, ord) = 1""")
def sku_choice(spark, sf_dir):
    return B.stock_number(block_rows(spark, sf_dir))


@query("""SELECT conv_id, turn, max(CAST(regexp_matches(text, '[0-9]') AS INTEGER)) OVER w AS digits_near,
lead(role, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def neighbour_context(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    near = F.max(F.col("text").rlike("[0-9]").cast("int")).over(order.rowsBetween(-2, 2))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", near.alias("digits_near"), F.lead("role", 1).over(order).alias("next_role"))


@query("""SELECT conv_id, role AS variant, count(*) + 2 * count(*) FILTER (regexp_matches(text, '[0-9]'))
- count(*) FILTER (length(text) < 20) AS score FROM conversations GROUP BY conv_id, role
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, role) = 1""")
def variant_choice(spark, sf_dir):
    score = F.count(F.lit(1)) + 2 * F.count_if(F.col("text").rlike("[0-9]")) - F.count_if(F.length("text") < 20)
    scored = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("variant")).agg(score.alias("score"))
    best = scored.groupBy("conv_id").agg(F.min(F.struct((-F.col("score")).alias("down"), "variant")).alias("m"))
    return best.select("conv_id", "m.variant", (-F.col("m.down")).alias("score"))


@query("""SELECT conv_id, string_agg(regexp_extract(text, '^[A-Za-z]+'), ' ' ORDER BY turn) AS name FROM conversations
WHERE regexp_extract(text, '^[A-Za-z]+') != '' GROUP BY conv_id""")
def name_assembly(spark, sf_dir):
    word = F.regexp_extract("text", "^[A-Za-z]+", 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", word.alias("word")).alias("part")).where("part.word != ''")
    parts = F.array_sort(F.collect_list("part"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("name"))


@query("""WITH t AS (SELECT conv_id, lower(string_agg(text, chr(10) ORDER BY turn)) AS t,
count(*) FILTER (regexp_matches(text, '[0-9]')) AS priced FROM conversations GROUP BY conv_id)
SELECT conv_id, priced, CASE """ + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in B.MECHANICS) + """ ELSE 'regular' END
AS mechanic FROM t""")
def tag_classify(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"])
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(parts, "\n").alias("t"), F.count_if(F.col("text").rlike("[0-9]")).alias("priced")
    )
    return whole.select("conv_id", "priced", B.mechanic(F.col("t")).alias("mechanic"))


ORDERS_SQL = """
e AS (SELECT o_orderkey AS key, unnest(['price', 'status', 'name']) AS field, unnest([CAST(CAST(round(o_totalprice) AS BIGINT)
  AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM orders),
a AS (SELECT key, field, CASE WHEN field = 'price' AND key % 7 = 0 THEN concat(value, '.50')
  WHEN field = 'price' AND key % 5 = 0 THEN concat(value, ',00') WHEN field = 'name' AND key % 3 = 0 THEN lower(value)
  WHEN field = 'name' AND key % 8 = 0 THEN 'другое' WHEN field = 'status' AND key % 4 = 0 THEN 'X' ELSE value END AS value
  FROM e WHERE key % 11 != 0)
"""


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    price = F.round("o_totalprice").cast("long").cast("string").alias("price")
    wide = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), price, F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("name"))
    expected = wide.unpivot("key", ["price", "status", "name"], "field", "value")
    changed = F.expr(
        "CASE WHEN field = 'price' AND key % 7 = 0 THEN concat(value, '.50') WHEN field = 'price' AND key % 5 = 0 THEN "
        "concat(value, ',00') WHEN field = 'name' AND key % 3 = 0 THEN lower(value) WHEN field = 'name' AND key % 8 = 0 THEN "
        "'другое' WHEN field = 'status' AND key % 4 = 0 THEN 'X' ELSE value END"
    )
    return expected, expected.where("key % 11 != 0").withColumn("value", changed)


@query(f"""WITH {ORDERS_SQL} SELECT e.field, count(*) AS total, count(*) FILTER (CASE e.field
WHEN 'price' THEN abs(CAST(e.value AS DOUBLE) - CAST(replace(a.value, ',', '.') AS DOUBLE)) <= 0.01
WHEN 'name' THEN lower(e.value) = lower(a.value) ELSE e.value = a.value END) AS matches
FROM e JOIN a ON e.key = a.key AND e.field = a.field GROUP BY e.field""")
def field_check(spark, sf_dir):
    return checks.field_accuracy(checks.compare_fields(*_orders(spark, sf_dir), ["price"], ["name"]))


@query(f"WITH {ORDERS_SQL} SELECT DISTINCT key FROM e WHERE key NOT IN (SELECT key FROM a)")
def missing_rows(spark, sf_dir):
    expected, actual = _orders(spark, sf_dir)
    return expected.select("key").distinct().join(actual.select("key").distinct(), "key", "left_anti")


@query("""WITH c AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS seen, CASE p_partkey % 4 WHEN 0 THEN NULL
WHEN 1 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 10 WHEN 2 THEN CAST(round(p_retailprice * 100) AS BIGINT) + 500
ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS code FROM part)
SELECT p_partkey, code = seen OR code = seen * 10 AS agrees FROM c""")
def qr_agreement(spark, sf_dir):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    code = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN seen * 10 WHEN 2 THEN seen + 500 ELSE seen END")
    rows = table(spark, sf_dir, "part").select("p_partkey", cents.alias("seen")).withColumn("code", code)
    text = [(F.col(c).cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string") for c in ("seen", "code")]
    return rows.select("p_partkey", checks.price_agrees(*text).alias("agrees"))


@query("""WITH q AS (SELECT page_id, string_split_regex(regexp_replace(regexp_replace(url, '^[^?]*\\?', ''), '#.*$', ''), '[&;\n]') AS l
FROM pages), x AS (SELECT page_id, unnest(l) AS pair, generate_subscripts(l, 1) AS place FROM q)
SELECT page_id, lower(trim(split_part(pair, '=', 1))) AS name, arg_max(regexp_extract(pair, '^[^=]*=(.*)$', 1), place) AS value
FROM x WHERE contains(pair, '=') GROUP BY ALL""")
def qr_payload(spark, sf_dir):
    return checks.payload_fields(table(spark, sf_dir, "pages"), "page_id", "url")


@query("""WITH g AS (SELECT event_type AS stage, user_id, sum(CAST(round(value * 1000) AS BIGINT)) AS ms, count(*) AS n FROM events
GROUP BY ALL) SELECT stage, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(n) AS BIGINT) AS n, arg_max(user_id, ROW(ms, user_id)) AS slowest
FROM g GROUP BY stage""")
def stage_timings(spark, sf_dir):
    ms = F.round(F.col("value") * 1000).cast("long")
    each = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), "user_id").agg(F.sum(ms).alias("ms"), F.count(F.lit(1)).alias("n"))
    slowest = F.max(F.struct("ms", "user_id"))["user_id"].alias("slowest")
    return each.groupBy("stage").agg(F.sum("ms").alias("ms"), F.sum("n").alias("n"), slowest)


@query("""SELECT lang, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'full' WHEN quality = 0 THEN 'review' ELSE 'miss' END
AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def status_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "review").otherwise("miss")
    return rows.groupBy("lang", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
