"""What keeps queries bounded as their tables grow: one shuffle of readings, gathered labels, nothing worked out twice."""

from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import votes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _readings(spark):
    rows = [(1, "v1", 1, 2, 1, "a", "x"), (1, "v2", 2, 3, 0, "a", ""), (1, "v3", 3, 1, 2, "b", None), (2, "v1", 1, 0, 0, None, "y")]
    return spark.createDataFrame(rows, "group_id long, view string, ord long, score int, filled int, flag string, status string")


def test_readings_are_shuffled_once_for_all_fields(spark):
    long = votes.unpivot(_readings(spark), ["group_id", "view", "ord", "score", "filled"], ["flag", "status"])
    won = votes.field_vote(long)
    plan = _plan(won)
    assert plan.count("Exchange") == 1 and "Expand" not in plan[plan.index("Exchange"):]
    found = {(r["group_id"], r["field"]): (r["value"], r["votes"], r["score"], r["filled"], r["ord"], r["source_view"]) for r in won.collect()}
    assert found == {(1, "flag"): ("a", 2, 3, 1, 1, "v2"), (1, "status"): ("x", 1, 2, 1, 1, "v1"), (2, "status"): ("y", 1, 0, 0, 1, "v1")}


def test_codes_are_counted_in_one_shuffle(spark):
    rows = [(1, 1, "4600000000015"), (1, 2, "46-0000-0000015"), (1, 3, "4600000000022"), (1, 4, "4600000000016"), (1, 5, None), (2, 1, "x")]
    long = spark.createDataFrame(rows, "group_id long, ord long, value string").select(
        "*", F.concat(F.lit("v"), "ord").alias("view"), F.lit(1).alias("score"), F.lit(1).alias("filled"), F.lit("barcode").alias("field")
    )
    good = [c for c in ("4600000000015", "4600000000022") if sum(int(d) * (1 if i % 2 == 0 else 3) for i, d in enumerate(c)) % 10 == 0]
    found = votes.barcode_vote(long)
    assert _plan(found).count("Exchange") == 1
    by = {r["group_id"]: r for r in found.collect()}
    assert (by[1]["codes"], by[1]["ignored"]) == (len(good), 5 - 2 * ("4600000000015" in good) - ("4600000000022" in good))
    assert (by[2]["codes"], by[2]["ignored"], by[2]["value"], by[2]["votes"]) == (0, 1, None, None)


def test_codes_are_checked_without_lambdas(spark):
    codes = ["4006381333931", "4006381333932", "0000000000000", "400638133393", "40063813339310", "400638133393a", "", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string").select("c", S.valid_ean13(F.col("c")).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True, False, True, False, False, False, False, False]
    assert "lambda" not in _plan(df)


def test_only_wholes_in_reach_get_endings(spark):
    rows = [("1234567 1000", 1000.0), ("1234", 1264.0), ("1234", 1265.5), ("1030 1031", 1000.0), ("9", 1000.0), (None, 1000.0), ("1000", None)]
    df = spark.createDataFrame(rows, "t string, e double").select(S.derived_prices(F.col("t"), F.col("e")).alias("p"), "t", "e")

    def plain(t, e):
        d = "".join(c for c in t or "" if c.isdigit())
        every = [round(int(d[i : i + 4]) + k / 100, 2) for i in range(len(d) - 3) if int(d[i : i + 4]) >= 1000 for k in S.KOPECKS]
        return sorted({p for p in every if e is not None and abs(p - e) <= max(30, e * 0.05)})

    assert [sorted(r["p"] or []) for r in df.collect()] == [plain(t, e) for t, e in rows]


def test_only_postings_of_asked_tokens_are_kept(spark):
    from tagloom.plans import match_queries as M

    asked = spark.createDataFrame([(1, ["red", "wine"], ["wine"])], "item_id long, tokens array<string>, strong array<string>")
    items = spark.createDataFrame([(7, ["red", "tea"]), (8, ["wine", "red"]), (9, ["tea"])], "doc_id long, item_tokens array<string>")
    index = M._asked_index(asked, items)
    assert {tuple(r) for r in index.select("doc_id", "token").collect()} == {(7, "red"), (8, "red"), (8, "wine")}
    assert [(r["item_id"], r["doc_id"]) for r in M._candidates(asked, index).collect()] == [(1, 8)]


def test_prices_gather_an_image_once(spark):
    from tagloom.operators import prices

    block = "image string, ord int, text string, conf double, box array<struct<x: double, y: double>>"
    made = [("a", 1, "без карты", 0.9, [(0.0, 0.0), (90.0, 20.0)]), ("a", 2, "1315", 0.9, [(60.0, 20.0), (100.0, 40.0)]), ("a", 3, "78", 0.9, [(105.0, 20.0), (120.0, 40.0)])]
    rows = spark.createDataFrame(made, block)
    for find, want in ((prices.red_full_price, 1315.78), (prices.card_price, 1315.78), (prices.price_without_card, 1315.78), (prices.red_card_price, 1315.78)):
        got = find(rows)
        assert "Join" not in _plan(got)
        assert [r["price"] for r in got.collect()] in ([want], [])
    assert [r["price"] for r in prices.red_full_price(rows).collect()] == [1315.78]


def test_payloads_are_sorted_not_their_pairs(spark):
    from tagloom.operators import payloads

    rows = [(1, "https://a.b/q?p1=1,5&x=1;p1=2&x=%32"), (1, "p1=3"), (2, '{"barcode": "4006381333931", "in": {"price1": "7 0", "y": "{bad"}}'), (3, " "), (4, None), (5, "b=12&&=")]
    found = payloads.qr_fields(spark.createDataFrame(rows, "k int, p string"), "k", "p")
    plan = _plan(found)
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan
    got = {r["k"]: (r["qr_code_barcode"], r["price1_qr"], r["price2_qr"], r["unknown"]) for r in found.where("k != 1").collect()}
    assert got == {2: ("4006381333931", "70", "нет", {"y": "{bad"}), 5: ("", "нет", "нет", {"": ""})}
    (one,) = found.where("k = 1").collect()
    assert one["unknown"] == {"x": "2"} and one["price1_qr"] in ("2", "3")


def test_fields_of_a_label_take_one_pass(spark):
    from tagloom.operators import blocks as B
    from tagloom.operators import families
    from tagloom.operators import labels as L

    block = "image string, ord int, text string, conf double, box array<struct<x: double, y: double>>"
    texts = ["1315", "78", "01.02.2024", "02.03.2024 10:30", "1234567890", "-22%", "ш", "к", "__99", "229"]
    made = [(i, n, t, 0.9, [(10.0 * n, 30.0 * (n * k % 11)), (10.0 * n + 9, 30.0 * (n * k % 11) + 9 + n)]) for i, k in (("a", 1), ("b", 3), ("c", 7)) for n, t in enumerate(texts)]
    rows = spark.createDataFrame([*made, ("d", 1, "x", 0.9, None)], block)
    placed = B.bounds(rows)
    read = L.read_fields(placed)
    plan = _plan(read)
    assert plan.count("Exchange") == 1 and plan.count("- Sort ") <= 1 and "Join" not in plan
    types = rows.groupBy("image").agg(F.min(F.lit("x")).alias("family"))
    assert _plan(L.extract(placed, types)).count("Exchange hashpartitioning") <= 2
    assert _plan(families.generic(rows)).count("Exchange") == 1
    got = {r["image"]: r for r in read.collect()}
    each = {"price": B.main_price(placed), "date": B.latest_date(placed), "id_sku": B.stock_number(placed), "long_code": L.long_code(placed), "discount_amount": L.discount(placed), "special_symbols": L.symbols(placed)}
    each["first_date"] = B.text_date(placed).withColumnRenamed("date", "first_date")
    for field, alone in each.items():
        found = {r["image"]: r[field] for r in alone.collect()}
        assert {i: r[field] for i, r in got.items()} == {i: found.get(i) for i in "abcd"}
    assert got["a"]["first_date"] == "01.02.2024" and got["a"]["date"] == "02.03.2024 10:30" and got["a"]["discount_amount"] == "-22%"


def test_compared_sides_are_joined_once(spark):
    from tagloom.operators import checks

    rows = [("k1", "name", "Green tea"), ("k2", "name", "Green tea leaves"), ("k3", "name", "abc"), ("k4", "name", None), ("k1", "price", "5"), ("k2", "code", "x")]
    seen = [("k1", "name", "green  tea"), ("k2", "name", "Green tea leavs"), ("k3", "name", "xyz"), ("k4", "name", ""), ("k1", "price", "5,00"), ("k2", "code", "y")]
    of = "key string, field string, value string"
    found = checks.compare_fields(spark.createDataFrame(rows, of), spark.createDataFrame(seen, of), ["price"], ["name"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert found.columns == ["key", "field", "expected", "actual", "match"]
    got = {(r["key"], r["field"]): r["match"] for r in found.collect()}
    assert got == {("k1", "name"): True, ("k2", "name"): True, ("k3", "name"): False, ("k4", "name"): True, ("k1", "price"): True, ("k2", "code"): False}


def test_postings_are_never_broadcast(spark):
    from tagloom.plans import match_queries as M

    sf = "/root/testdata/sf0.001"
    found = _plan(M._searched(spark, sf, 1))
    assert "SortMergeJoin [doc_id" in found  # candidates with the documents' postings
    lookup = [line for line in _plan(M.catalog_candidates(spark, sf)).splitlines() if "BroadcastHashJoin [token" in line]
    assert lookup and all("BuildLeft" in line for line in lookup)  # the looked up tokens, not the postings


def test_long_names_are_not_repeated_for_their_tokens(spark):
    from tagloom.operators import catalog as C

    text = " ".join(f"word{i} merlot chateau" for i in range(300))
    items = spark.createDataFrame([(1, text, "1"), (2, "merlot rouge", "2"), (3, text, "3")], "item_id int, fullname string, code string")
    named = C.named_items(items)
    tokens = C.product_tokens(named.select("name_id", "fullname"), "name_id", "fullname")
    assert tokens.count() == 2 and {len(bytes(r["name_id"])) for r in tokens.collect()} == {32}
    sent = [line for line in _plan(tokens).splitlines() if "Exchange" in line or "collect_set" in line]
    assert sent and not any("fullname" in line for line in sent)
    assert "BroadcastHashJoin" in _plan(tokens)  # the few corrected tokens, so tokens aren't shuffled for them
    got = {r.name: (r.item_id, r.one_code, [t.item_id for t in r.top]) for r in C.search(spark.createDataFrame([("merlot word7",), ("rouge merlot",)], "name string"), items).collect()}
    assert got["merlot word7"] == (1, False, [1, 3, 2]) and got["rouge merlot"][:2] == (2, True)


def test_shuffle_files_of_stored_tables_are_removed(spark):
    import time

    from tagloom.sources.shared import CLEANED, stored

    manager = spark._jsc.sc().env().blockManager().diskBlockManager()
    listed = lambda: {n for n in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    had, rows = listed(), spark.range(100_000)
    made = stored(rows.groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum("id").alias("s")).join(rows, F.col("k") == F.col("id")), "made")
    until = time.time() + 10
    while listed() - had and time.time() < until:
        time.sleep(0.2)
    assert not listed() - had
    assert made.count() == 50_000 and spark.conf.get(CLEANED) == "false"
