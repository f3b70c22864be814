"""Votes, prices, codes and view ranking over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import views as V
from tagloom.operators import votes
from tagloom.plans.stand_ins import READINGS_SQL, VIEWS_SQL, readings, table, views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FIELDS = ["flag", "status", "year"]
LONG_SQL = f"""
WITH {READINGS_SQL},
l AS (SELECT group_id, view, ord, score, filled, 'flag' AS field, flag AS value FROM r UNION ALL
  SELECT group_id, view, ord, score, filled, 'status', status FROM r UNION ALL
  SELECT group_id, view, ord, score, filled, 'year', year FROM r),
c AS (SELECT group_id, field, value, count(*) AS votes, max(score) AS score, max(filled) AS filled, min(ord) AS ord,
  arg_max(view, ROW(score, filled, -ord)) AS source_view FROM l GROUP BY ALL)
"""


def _long(spark, sf_dir) -> DataFrame:
    return votes.unpivot(readings(spark, sf_dir), ["group_id", "view", "ord", "score", "filled"], FIELDS)


@query(LONG_SQL + """SELECT group_id, field, value, votes, source_view FROM c
QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY votes DESC, score DESC, filled DESC, ord) = 1""")
def field_vote(spark, sf_dir):
    return votes.field_vote(_long(spark, sf_dir)).select("group_id", "field", "value", "votes", "source_view")


@query(LONG_SQL + """SELECT group_id, field, value, votes, source_view FROM c QUALIFY row_number() OVER
(PARTITION BY group_id, field ORDER BY value = 'N', votes DESC, score DESC, filled DESC, ord) = 1""")
def absent_fallback_vote(spark, sf_dir):
    won = votes.field_vote(_long(spark, sf_dir), absent="N")
    return won.select("group_id", "field", "value", "votes", "source_view")


@query(f"""WITH {READINGS_SQL} SELECT group_id, ord,
CASE WHEN l_partkey % 3 != 0 THEN 5 ELSE 0 END + CASE WHEN l_suppkey % 4 != 0 THEN 3 ELSE 0 END + 2 + 1 AS quality,
CASE WHEN l_partkey % 3 != 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 4 != 0 THEN 1 ELSE 0 END + 2 AS filled_fields FROM r""")
def reading_quality(spark, sf_dir):
    fields = {
        "barcode": F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")),
        "price": F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")),
        "flag": F.col("flag"),
        "status": F.col("status"),
    }
    score, filled = votes.quality(fields, {"barcode": 5, "price": 3, "flag": 2, "status": 1})
    return readings(spark, sf_dir).select("group_id", "ord", score.alias("quality"), filled.alias("filled_fields"))


@query(f"""WITH {READINGS_SQL} SELECT group_id, view, score, filled FROM r
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, filled DESC, ord) = 1""")
def best_reading(spark, sf_dir):
    order = [F.desc("score"), F.desc("filled"), F.asc("ord")]
    return votes.best_reading(readings(spark, sf_dir), "group_id", order).select("group_id", "view", "score", "filled")


_ENDS = "0, 9, 17, 19, 21, 47, 51, 78, 79, 89, 90, 95, 99"
_PRICE_TEXTS_SQL = f"""WITH {READINGS_SQL},
p AS (SELECT group_id, view, ord, score, filled, CAST(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS VARCHAR) AS card, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS disc,
  CASE WHEN l_partkey % 3 != 0 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) + l_partkey % 7 * 100 AS VARCHAR) END AS full_text, concat('box ', CAST(CAST(floor(l_extendedprice / 10) AS BIGINT) AS VARCHAR)) AS name FROM r),
l AS (SELECT group_id, score, filled, ord, 'card' AS field, card AS value FROM p UNION ALL SELECT group_id, score, filled, ord, 'disc', disc FROM p UNION ALL SELECT group_id, score, filled, ord, 'full', full_text FROM p WHERE full_text IS NOT NULL),
c AS (SELECT group_id, field, value, count(*) AS votes, max(score) AS score, max(filled) AS filled, min(ord) AS ord FROM l GROUP BY ALL),
won AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY votes DESC, score DESC, filled DESC, ord) = 1),
v AS (SELECT group_id, CAST(max(CASE WHEN field = 'card' THEN value END) AS DOUBLE) AS card, CAST(max(CASE WHEN field = 'disc' THEN value END) AS INTEGER) AS disc, max(CASE WHEN field = 'full' THEN value END) AS vote FROM won GROUP BY 1),
x AS (SELECT group_id, card, vote, CASE WHEN card > 0 AND disc BETWEEN 1 AND 99 THEN card / (1 - disc / 100) END AS expected FROM v),
y AS (SELECT p.group_id, p.score, p.ord, p.name, p.full_text, CAST(p.full_text AS DOUBLE) AS full_price, x.card, expected FROM p JOIN x USING (group_id)),
d AS (SELECT group_id, score, ord, expected, regexp_replace(t, '[^0-9]', '', 'g') AS digits FROM (SELECT *, name AS t FROM y UNION ALL SELECT *, full_text FROM y WHERE full_text IS NOT NULL)),
w AS (SELECT group_id, score, ord, expected, CAST(substr(digits, CAST(i AS INTEGER), 4) AS INTEGER) AS whole FROM d, unnest(range(1, greatest(1, length(digits) - 2))) AS u(i)),
e AS (SELECT group_id, score, ord, 1 AS tier, abs(full_price - expected) AS off, full_price AS price FROM y WHERE full_price > card AND abs(full_price - expected) <= greatest(30, expected * 0.08)
  UNION ALL SELECT group_id, score, ord, 2, abs(round(whole + k / 100, 2) - expected), round(whole + k / 100, 2) FROM w, unnest([{_ENDS}]) AS z(k) WHERE whole >= 1000 AND abs(round(whole + k / 100, 2) - expected) <= greatest(30, expected * 0.05)),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY tier, off, score DESC, ord) = 1)
"""


@query(_PRICE_TEXTS_SQL + """SELECT group_id, coalesce(printf('%.2f', price), vote) AS price_default, CAST(coalesce(tier, 3) AS INTEGER) AS tier FROM x LEFT JOIN f USING (group_id) WHERE coalesce(printf('%.2f', price), vote) IS NOT NULL""")
def consistent_price(spark, sf_dir):
    return votes.consistent_price(_label_prices(spark, sf_dir))


def _label_prices(spark, sf_dir) -> DataFrame:
    """Readings with prices as text: a third have no full price, a name may hold digits of one."""
    whole = lambda c: F.floor(c).cast("long").cast("string")
    price = F.col("l_extendedprice")
    full = (F.floor(price) + F.col("l_partkey") % 7 * 100).cast("string")
    return readings(spark, sf_dir).select(
        "group_id", "view", "ord", "score", "filled",
        whole(price * (1 - F.col("l_discount"))).alias("price_card"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("discount_amount"),
        F.when(F.col("l_partkey") % 3 != 0, full).alias("price_default"),
        F.concat(F.lit("box "), whole(price / 10)).alias("product_name"),
    )


@query(f"""WITH {READINGS_SQL}, n AS (SELECT group_id, view, ord, score, CASE WHEN l_linenumber = 3 THEN 'нет' WHEN l_linenumber % 2 = 0 THEN p_name ELSE concat(upper(p_name), ' #', l_linenumber, ' x') END AS name
  FROM r JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, regexp_extract_all(name, '[A-Za-z0-9][A-Za-z0-9./-]*') AS words, len(regexp_extract_all(name, '[A-Za-z]')) AS letters, 1 - len(regexp_extract_all(name, '[A-Za-z0-9\\s.,()/-]')) / length(name) AS odd,
  len(regexp_extract_all(name, '#')) AS junk FROM n WHERE name != 'нет' AND len(string_split(name, ' ')) >= 2),
s AS (SELECT *, greatest(letters * 0.1::DOUBLE + len(list_filter(words, lambda x: length(x) >= 3)) + CASE WHEN letters > 0 THEN 2.0 ELSE 0.0 END
  + least(len(list_filter(words, lambda x: length(x) >= 3 AND regexp_matches(x, '[A-Za-z]') AND upper(x) = x)), 4) * 0.5::DOUBLE - junk * 1.5::DOUBLE - CASE WHEN odd > 0.3 THEN odd * 10 ELSE 0.0 END
  - CASE WHEN len(list_filter(words, lambda x: length(x) = 1)) / len(words) > 0.35 THEN 3.0 ELSE 0.0 END, 0) AS reads FROM w)
SELECT group_id, name AS product_name, view AS source_view FROM s QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY reads DESC, score DESC, length(name) DESC, ord) = 1""")
def best_name(spark, sf_dir):
    name = F.when(F.col("l_linenumber") == 3, "нет").when(F.col("l_linenumber") % 2 == 0, F.col("p_name"))
    name = name.otherwise(F.concat(F.upper("p_name"), F.lit(" #"), F.col("l_linenumber").cast("string"), F.lit(" x")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return votes.best_name(readings(spark, sf_dir).join(parts, "l_partkey").withColumn("product_name", name))


@query(f"""WITH {READINGS_SQL},
t AS (SELECT group_id, ord, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS d, l_extendedprice AS e FROM r),
w AS (SELECT DISTINCT group_id, ord, e, CAST(substr(d, CAST(i AS INTEGER), 4) AS INTEGER) AS whole FROM t, unnest(range(1, length(d) - 2)) AS u(i)),
x AS (SELECT group_id, ord, e, whole * 100 + k AS kop FROM w, unnest([{_ENDS}]) AS z(k) WHERE whole >= 1000)
SELECT group_id, ord, CAST(count(*) AS BIGINT) AS n_derived, CAST(max(kop) AS BIGINT) AS largest FROM x
WHERE abs(kop / 100.0 - e) <= greatest(30, e * 0.05) GROUP BY group_id, ord""")
def derived_price(spark, sf_dir):
    text = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    found = S.derived_prices(text, F.col("l_extendedprice"))
    rows = readings(spark, sf_dir).select("group_id", "ord", found.alias("p")).where(F.size("p") > 0)
    return rows.groupBy("group_id", "ord").agg(
        F.sum(F.size("p")).alias("n_derived"), F.max(F.round(F.array_max("p") * 100).cast("long")).alias("largest")
    )


_TEXT_SQL = f"""WITH {READINGS_SQL}, c AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS k FROM r),
t AS (SELECT group_id, ord, CASE l_linenumber % 3 WHEN 0 THEN concat(k // 100, ',', lpad(CAST(k % 100 AS VARCHAR), 2, '0'))
  WHEN 1 THEN concat(k // 100000, ' ', lpad(CAST(k // 100 % 1000 AS VARCHAR), 3, '0'), ' p.') ELSE CAST(k // 100 AS VARCHAR) END AS txt FROM c)
"""


def _price_texts(spark, sf_dir) -> DataFrame:
    k = F.round(F.col("l_extendedprice") * 100).cast("long")
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    whole, tail = F.floor(k / 100).cast("long"), k % 100
    text = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(whole.cast("string"), F.lit(","), part(tail, 2)))
        .when(
            F.col("l_linenumber") % 3 == 1,
            F.concat(F.floor(k / 100000).cast("string"), F.lit(" "), part(whole % 1000, 3), F.lit(" p.")),
        )
        .otherwise(whole.cast("string"))
    )
    return readings(spark, sf_dir).select("group_id", "ord", text.alias("txt"))


@query(_TEXT_SQL + """SELECT group_id, ord, TRY_CAST(regexp_replace(replace(txt, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE) AS lenient,
CASE WHEN regexp_matches(replace(txt, ',', '.'), '^[0-9]+(\\.[0-9]*)?$') THEN TRY_CAST(replace(txt, ',', '.') AS DOUBLE) END AS strict FROM t""")
def price_parse(spark, sf_dir):
    rows = _price_texts(spark, sf_dir)
    return rows.select("group_id", "ord", S.parse_price(F.col("txt")).alias("lenient"), S.parse_price_strict(F.col("txt")).alias("strict"))


@query(_TEXT_SQL + """SELECT group_id, ord, CASE WHEN txt LIKE '%,%' THEN replace(txt, ',', '.') ELSE txt END AS shown FROM t""")
def price_format(spark, sf_dir):
    return _price_texts(spark, sf_dir).select("group_id", "ord", S.format_price(F.col("txt")).alias("shown"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS full_price,
  round(p_retailprice - 850, 2) AS card, p_retailprice AS ref FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, full_price, full_price >= 1000 AND card > 0 AND card < 200 AS suspicious,
  (CASE WHEN card < 100 THEN least(abs(card - ref), abs(card + 900 - ref), abs(card + 1900 - ref))
    WHEN card < 1000 THEN least(abs(card - ref), abs(card + 1000 - ref), abs(card + 2000 - ref)) ELSE abs(card - ref) END) <= 150.01 AS repaired FROM x""")
def price_repair(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    card = F.round(F.col("p_retailprice") - 850, 2)
    fits = F.exists(S.repair_variants(card), lambda v: F.abs(v - F.col("p_retailprice")) <= 150.01)
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("full_price"),
        S.suspiciously_low(card, F.col("l_extendedprice"), F.lit("35")).alias("suspicious"), fits.alias("repaired"),
    )


_EAN_SQL = """
d AS (SELECT p_partkey, lpad(CAST(460000000000 + p_partkey * 7919 AS VARCHAR), 12, '0') AS b FROM part),
s AS (SELECT p_partkey, b, (SELECT sum(CAST(substr(b, CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FROM range(1, 13) AS q(i)) AS t FROM d),
e AS (SELECT p_partkey, concat(b, (10 - t % 10 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 10) AS code, p_partkey % 7 != 0 AS valid FROM s)
"""


def _codes(spark, sf_dir) -> DataFrame:
    body = F.lpad((F.lit(460000000000) + F.col("p_partkey") * 7919).cast("string"), 12, "0")
    total = sum((F.substring(body, i, 1).cast("int") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    broken = F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)
    last = (10 - total % 10 + broken) % 10
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(body, last.cast("string")).alias("code"))


@query(f"WITH {_EAN_SQL} SELECT p_partkey, code, valid FROM e")
def ean13_check(spark, sf_dir):
    return _codes(spark, sf_dir).select("p_partkey", "code", S.valid_ean13(S.digits(F.col("code"))).alias("valid"))


@query(f"""WITH {READINGS_SQL}, {_EAN_SQL}, c AS (SELECT group_id, view, ord, score, filled, code, valid FROM r JOIN e ON e.p_partkey = r.l_partkey),
n AS (SELECT group_id, count(DISTINCT CASE WHEN valid THEN code END) AS codes, count(*) FILTER (NOT valid) AS ignored FROM c GROUP BY 1),
g AS (SELECT group_id, code AS value, count(*) AS votes, max(score) AS score, max(filled) AS filled, min(ord) AS ord FROM c WHERE valid GROUP BY 1, 2),
w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, score DESC, filled DESC, ord) = 1)
SELECT group_id, codes, ignored, value, votes FROM n LEFT JOIN w USING (group_id)""")
def barcode_vote(spark, sf_dir):
    rows = readings(spark, sf_dir).join(_codes(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    long = rows.select("group_id", "view", "ord", "score", "filled", F.lit("barcode").alias("field"), F.col("code").alias("value"))
    return votes.barcode_vote(long).select("group_id", "codes", "ignored", "value", "votes")


@query(f"WITH {_EAN_SQL} SELECT p_partkey, CASE WHEN valid THEN code END AS barcode FROM e")
def barcode_from_parts(spark, sf_dir):
    """A code in three neighbouring blocks, put together from left to right and checked."""
    code = F.col("code")
    parts = F.array(F.substring(code, 1, 1), F.substring(code, 2, 6), F.substring(code, 8, 6))
    blocks = _codes(spark, sf_dir).select("p_partkey", F.posexplode(parts).alias("pos", "digits"))
    w = Window.partitionBy("p_partkey").orderBy("pos")
    joined = F.concat(F.col("digits"), F.lead("digits", 1).over(w), F.lead("digits", 2).over(w))
    tried = blocks.select("p_partkey", "pos", joined.alias("code"))
    return tried.groupBy("p_partkey").agg(F.min_by(F.when(S.valid_ean13(F.col("code")), F.col("code")), F.when(S.valid_ean13(F.col("code")), F.col("pos"))).alias("barcode"))


@query(f"""WITH {VIEWS_SQL} SELECT group_id, max(area) AS max_area, median(area) AS median_area, max(sharpness) AS max_sharpness,
min(ts) AS min_ts, max(ts) AS max_ts FROM v GROUP BY group_id""")
def view_stats(spark, sf_dir):
    return V.view_stats(views(spark, sf_dir), "group_id")


#: Scores are rounded as they are written, in decimals: the query does, and binary products put some halves below the half.
_SCORE_SQL = f"""WITH {VIEWS_SQL}, s AS (SELECT group_id, max(area) AS ma, median(area) AS me, max(sharpness) AS ms FROM v GROUP BY 1),
q AS (SELECT group_id, view_id, area, ts, CAST(round(round(CAST(CAST(2.0 * least(1.0, k / 100.0) + 1.5 * CASE WHEN ms > 0 THEN sharpness / ms ELSE 0 END + 1.2 * (area / ma) + 0.2
  - CASE WHEN area < 0.25 * ma THEN 0.8 WHEN area < 0.5 * me THEN 0.4 ELSE 0 END - CASE WHEN view_id % 11 = 0 THEN 0.25 ELSE 0 END AS VARCHAR) AS DECIMAL(38, 20)), 4), 2) AS DOUBLE) AS score FROM v JOIN s USING (group_id))
"""


def _scored(spark, sf_dir) -> DataFrame:
    v = views(spark, sf_dir)
    own = v.join(V.view_stats(v, "group_id"), "group_id")
    score = V.view_score(F.col("k") / 100, F.col("sharpness"), F.col("area"), F.col("view_id") % 11 == 0, F.col("ts").isNotNull())
    return own.withColumn("score", F.round(score, 2))


@query(_SCORE_SQL + "SELECT group_id, view_id, CAST(floor(score * 10 + 0.501) AS BIGINT) AS tenths FROM q")
def view_score(spark, sf_dir):
    tenths = F.floor(F.col("score") * 10 + 0.501)  # a score has two decimals, so no rounding is on an edge
    return _scored(spark, sf_dir).select("group_id", "view_id", tenths.alias("tenths"))


def _initial_sql(limit: int = 7) -> str:
    """The choice turn by turn: each adds the view that is farthest from those chosen before."""
    sql = _SCORE_SQL + """, sp AS (SELECT group_id, min(ts) AS lo, greatest(1, max(ts) - min(ts)) AS span FROM q GROUP BY 1),
a AS (SELECT group_id, view_id, CAST(floor(score * 10 + 0.501) AS BIGINT) AS score, area, (ts - lo) / span AS t, CAST(view_id % 97 * 10 AS DOUBLE) AS x FROM q JOIN sp USING (group_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, view_id) AS rs, row_number() OVER (PARTITION BY group_id ORDER BY area DESC, view_id) AS ra FROM a),
c3 AS (SELECT group_id, view_id, score, t, x, CASE WHEN rs <= 3 THEN rs ELSE least(3, count(*) OVER (PARTITION BY group_id)) + row_number() OVER (PARTITION BY group_id, rs <= 3 ORDER BY ra) END AS chosen FROM b WHERE rs <= 3 OR ra <= 2)"""
    for k in range(4, limit + 1):
        sql += f""", d{k} AS (SELECT a.group_id, a.view_id, a.score, a.t, a.x, min(abs(a.t - s.t) + sqrt((a.x - s.x) * (a.x - s.x)) / 1000) AS d FROM a JOIN c{k - 1} s ON a.group_id = s.group_id
  WHERE (a.group_id, a.view_id) NOT IN (SELECT group_id, view_id FROM c{k - 1}) AND a.group_id NOT IN (SELECT group_id FROM c{k - 1} WHERE chosen = {k}) GROUP BY ALL),
c{k} AS (SELECT * FROM c{k - 1} UNION ALL (SELECT group_id, view_id, score, t, x, {k} FROM d{k} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY d DESC, score DESC, view_id) = 1))"""
    return sql + f" SELECT group_id, view_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, chosen) - 1 AS INTEGER) AS pos, CAST(chosen AS INTEGER) AS chosen FROM c{limit}"


@query(_initial_sql())
def initial_views(spark, sf_dir):
    span = F.greatest(F.lit(1), F.col("max_ts") - F.col("min_ts"))
    x = (F.col("view_id") % 97 * 10).cast("double")
    tenths = F.floor(F.col("score") * 10 + 0.501)
    scored = _scored(spark, sf_dir).select(
        "group_id", "view_id", F.col("view_id").alias("ord"), tenths.alias("score"), "area",
        ((F.col("ts") - F.col("min_ts")) / span).alias("t"), x.alias("x"), F.lit(0.0).alias("y"),
    )
    return V.initial_views(scored, "group_id")


@query(f"""WITH {VIEWS_SQL}, p AS (SELECT group_id, view_id, row_number() OVER (PARTITION BY group_id ORDER BY k DESC, view_id) AS place FROM v)
SELECT group_id, view_id, CAST(CASE WHEN place <= 7 THEN 1 ELSE 1 + ceil((place - 7) / 5.0) END AS INTEGER) AS round FROM p WHERE place <= 22""")
def next_views(spark, sf_dir):
    """Views of the first rounds, with the cap of 22 views per group that is the operator's own setting here."""
    ranked = V.rounds(views(spark, sf_dir), "group_id", order=[F.desc("k"), F.asc("view_id")])
    return ranked.where(F.col("place") <= 22).select("group_id", "view_id", "round")


@query(f"""WITH {VIEWS_SQL}, p AS (SELECT group_id, view_id, k, area, row_number() OVER (PARTITION BY group_id ORDER BY k DESC, view_id) AS place FROM v),
q AS (SELECT *, CAST(CASE WHEN place <= 7 THEN 1 ELSE 1 + ceil((place - 7) / 5.0) END AS INTEGER) AS rnd FROM p),
c AS (SELECT DISTINCT group_id, rnd, sum(area) OVER w AS evidence, count(*) OVER w AS used FROM q WINDOW w AS (PARTITION BY group_id ORDER BY rnd RANGE UNBOUNDED PRECEDING))
SELECT group_id, CAST(coalesce(min(CASE WHEN evidence >= 3000 THEN rnd END), max(rnd)) AS INTEGER) AS stop_round,
  min(CASE WHEN evidence >= 3000 THEN rnd END) IS NOT NULL AS early_stop,
  CAST(coalesce(arg_min(used, CASE WHEN evidence >= 3000 THEN rnd END), max(used)) AS BIGINT) AS views_used FROM c GROUP BY group_id""")
def progressive_rounds(spark, sf_dir):
    """Rounds of views until the evidence of a prefix suffices: all prefixes in one pass, the first that does is taken."""
    ranked = V.rounds(views(spark, sf_dir), "group_id", order=[F.desc("k"), F.asc("view_id")])
    per_round = ranked.groupBy("group_id", "round").agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("n"))
    prefix = Window.partitionBy("group_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    sums = per_round.select("group_id", "round", F.sum("area").over(prefix).alias("evidence"), F.sum("n").over(prefix).alias("used"))
    enough = F.when(F.col("evidence") >= 3000, F.col("round"))
    return sums.groupBy("group_id").agg(
        F.coalesce(F.min(enough), F.max("round")).alias("stop_round"),
        F.min(enough).isNotNull().alias("early_stop"),
        F.coalesce(F.min_by("used", enough), F.max("used")).alias("views_used"),
    )


@query(LONG_SQL + f""", w AS (SELECT group_id, field, value FROM c QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY votes DESC, score DESC, filled DESC, ord) = 1),
m AS (SELECT group_id, p_name, count(*) AS votes, min(ord) AS ord FROM r JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY length(p_name) DESC, votes DESC, ord) = 1)
SELECT o_orderkey AS group_id, max(CASE WHEN field = 'flag' THEN value END) AS flag, max(CASE WHEN field = 'status' THEN value END) AS status,
  max(CASE WHEN field = 'year' THEN value END) AS year, max(p_name) AS product_name FROM orders LEFT JOIN w ON o_orderkey = w.group_id LEFT JOIN n ON o_orderkey = n.group_id GROUP BY 1""")
def group_merge(spark, sf_dir):
    """One row per group: voted fields, the longest name, and a blank row for groups without readings."""
    won = votes.field_vote(_long(spark, sf_dir)).groupBy("group_id").pivot("field", FIELDS).agg(F.first("value"))
    named = readings(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = named.groupBy("group_id", "p_name").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("ord"))
    names = votes.best_reading(counts, "group_id", [F.desc(F.length("p_name")), F.desc("votes"), F.asc("ord")])
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"))
    return groups.join(won, "group_id", "left").join(names.select("group_id", F.col("p_name").alias("product_name")), "group_id", "left")
