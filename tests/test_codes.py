from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import blocks as B
from tagloom.operators import catalog as C
from tagloom.operators import checks, summary

BLOCK = "image long, ord long, text string, x double, y double, conf double"


def placed(spark, rows):
    """Blocks 40 wide and 10 high; without x there is no box."""
    df = spark.createDataFrame(rows, BLOCK)
    box = F.array(F.struct("x", "y"), F.struct((F.col("x") + 40).alias("x"), (F.col("y") + 10).alias("y")))
    return B.bounds(df.select("image", "ord", "text", "conf", F.when(F.col("x").isNotNull(), box).alias("box")))


def test_barcode(spark):
    high = lambda image: (image, 0, "title", 0.0, 0.0, 0.9)
    rows = [high(i) for i in (1, 2, 3, 4, 5, 7)]
    # 1: whole, though another block with an invalid code comes first; 2: parts, the middle one without its zero
    rows += [(1, 1, "4006381333930", 0.0, 100.0, 0.9), (1, 2, "4 006381 333931", 50.0, 100.0, None)]
    rows += [(2, 1, "333931", 90.0, 100.0, 0.9), (2, 2, "06381", 50.0, 101.0, 0.9), (2, 3, "4", 10.0, 99.0, 0.9)]
    # 3: a lone digit at the left; 4: in the upper zone; 5: without box; 6: no height, so no zone; 7: null texts and service text
    rows += [(3, 1, "8", 0.0, 100.0, 0.9), (3, 2, "4", 10.0, 100.0, 0.9), (3, 3, "006381", 50.0, 100.0, 0.9), (3, 4, "333931", 90.0, 100.0, 0.9)]
    rows += [(4, 1, "4006381333931", 0.0, 20.0, 0.9), (4, 2, "foot", 0.0, 100.0, 0.9), (5, 1, "4006381333931", None, None, 0.9)]
    rows += [(7, 1, None, 0.0, 100.0, 0.9), (7, 2, "__4006381333931", 0.0, 100.0, 0.9)]
    got = {r["image"]: r["barcode"] for r in B.barcode(placed(spark, rows)).collect()}
    assert got == {1: "4006381333931", 2: "4006381333931", 3: "4006381333931"}


def test_dates(spark):
    rows = [
        (1, 1, "24.12.2025  12:46", 0.0, 10.0, 0.9), (1, 2, "25.12.2025", 0.0, 90.0, 0.9), (1, 3, "x 26 12 2025 0930 y", 0.0, 50.0, 0.9),
        (2, 1, "25.12.2025", 0.0, 10.0, 0.9), (2, 2, "01.01.2026", 0.0, 90.0, 0.9), (2, 3, "02.01.20267", 0.0, 99.0, 0.9),
        (3, 1, "31.02.2025", None, None, 0.8), (3, 2, "01.03.2025", None, None, 0.5), (3, 3, "02.03.2025", None, None, 0.9),
        (4, 1, "31.02.2025", None, None, 0.2), (4, 2, "05.03.2025", None, None, 0.3), (4, 3, None, None, None, 0.9),
    ]
    blocks = placed(spark, rows)
    assert {r[0]: r[1] for r in B.latest_date(blocks).collect()} == {1: "26.12.2025 09:30", 2: "01.01.2026"}
    # of sure texts the first isn't a day, so the first day among all of enough confidence counts
    assert {r[0]: r[1] for r in B.text_date(blocks).collect()} == {1: "24.12.2025", 2: "25.12.2025", 3: "01.03.2025"}


def test_stock_number(spark):
    rows = [
        (1, 1, "24.12.2025 12:46", 0.0, 100.0, 0.9), (1, 2, "№ 1234 567890", 0.0, 100.0, 0.9), (1, 3, "123456789012", 0.0, 0.0, 0.9),
        (2, 1, "1234567890", 0.0, 0.0, 0.9), (2, 2, "99", 0.0, 100.0, 0.9), (3, 1, "12345678901", 50.0, 5.0, 0.9),
        (3, 2, "12345678902", 40.0, 5.0, 0.9),
    ]
    got = {r[0]: r[1] for r in B.stock_number(placed(spark, rows)).collect()}
    assert got == {1: "1234567890", 2: "1234567890", 3: "12345678902"}


def test_block_sets(spark):
    rows = [(1, 1, "С картой", 0.5), (1, 2, "99", 0.7), (1, 3, "5", 0.6), (1, 4, "% ", 0.6), (1, 5, "__kopeks__:99", 0.0)]
    rows += [(2, 1, "#~", 0.5), (3, 1, "__x", 0.9), (4, 1, None, None), (5, 1, "4006381333931 вино", 1.0)]
    sets = spark.createDataFrame(rows, "image long, ord long, text string, conf double")
    got = {r["image"]: r["score"] for r in B.block_set_score(sets, ["image"]).collect()}
    # 4 blocks, mean 0.6, two words, a percent over two blocks, one number of two digits, two numbers, a block of signs
    assert got[1] == round(3.2 + 4.8 + 8 + 8 + 2 + 1.6 - 1.2, 4)
    assert got[2] == round(0.8 + 4 - 1.2 - 8 - 5, 4) and got[3] == 0 and got[4] == round(0.8 - 8 - 5, 4)
    assert got[5] == round(0.8 + 8 + 4 + 8 + 0.8 - 5, 4)
    two = spark.createDataFrame([(1, v, 1, "99", 0.5) for v in "cab"] + [(2, "a", 1, "", 0.1), (2, "b", 1, "99", 0.1)], "image long, variant string, ord long, text string, conf double")
    assert {r[0]: r[1] for r in B.best_variant(two, "image", "variant").collect()} == {1: "a", 2: "b"}
    assert B.best_variant(two.limit(0), "image", "variant").count() == 0


def test_code_agreement(spark):
    names = "filename barcode qr_code_barcode price_default price1_qr price_card price2_qr"
    rows = [
        ("a", "46", " 46 ", "1 234,50", "1234.5", "10", "100"), ("b", "46", "47", "10", "100", "5", "50"), ("c", None, "46", "нет", "5", "5", None),
        ("d", "46", "НЕТ", "5", "6", "от 5", "5"), ("e", "46", "", "0", "0", "", ""),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    got = {r["filename"]: tuple(r[c] for c in ("barcode_match", "price1_match", "price2_match", "notes")) for r in checks.code_agreement(df).collect()}
    note = [checks.PER_KILOGRAM]
    assert got == {
        "a": (True, True, True, note), "b": (False, True, True, note), "c": (None, None, None, []), "d": (None, False, None, []), "e": (None, True, None, []),
    }
    shown = {r["filename"]: r for r in checks.code_report(df).collect()}
    assert shown["a"]["notes"] == checks.PER_KILOGRAM and shown["c"]["barcode_match"] == "" and shown["d"]["price1_match"] == "false"


def test_noisy_names(spark):
    texts = ["Вино красное", "Вино", "", None, "a ###%%", '"Вино" сухое', "вино 'a\"' ''''''", "чай №№ 1 ко", "  x  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tokens = F.array(F.lit("a"), F.lit("b"))
    got = [tuple(r) for r in df.select(S.noisy_name(F.col("t")), S.noisy_search_name(F.col("t"), tokens)).collect()]
    assert got == [(False, False), (True, False), (True, True), (True, True), (True, True), (False, False), (False, True), (False, False), (True, False)]


def test_candidate_items(spark):
    listed = spark.createDataFrame([(1, p, n, c) for p, n, c in ((1, "a", "x"), (2, "a", None), (3, "gone", "x"), (6, "b", ""))], "query long, place int, fullname string, code string")
    items = spark.createDataFrame([(7, "a", "x"), (9, "a", "x"), (8, "a", ""), (5, "b", "")], "item_id long, fullname string, code string")
    got = {(r["place"], r["item_id"]) for r in C.candidate_items(listed, items, "query").collect()}
    assert got == {(1, 9), (2, 8)}


def test_result_list(spark):
    rows = [(3, "failed", "unknown", 59.95), (1, "fully_matched", "wine/a", 60.0), (2, "other", "tea/b", 1006.54), (4, "failed", None, None)]
    df = spark.createDataFrame(rows, "group_id long, status string, department string, seconds double")
    got = [(r["group_id"], r["status_name"], r["status_tone"], r["department_name"], r["runtime"]) for r in summary.result_list(df).collect()]
    assert got[:2] == [(1, "Уверенно", "success", "Вино - a", "1 мин 0 сек"), (2, None, None, "tea - b", "16 мин 47 сек")]
    assert got[2][:4] == (3, "Ошибка", "danger", "Неизвестный отдел") and got[3] == (4, "Ошибка", "danger", None, None)
    assert [r["group_id"] for r in summary.result_list(df, "failed").collect()] == [3, 4]
