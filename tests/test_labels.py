"""Edge cases of payloads, label rules, summaries, reports and streams."""

from pyspark.sql import functions as F

from tagloom.functions import label_text as T
from tagloom.functions.scalars import noisy_name
from tagloom.operators import labels, payloads, summary
from tagloom.sources import reports
from tagloom.streaming.votes import windowed_votes, write_once


def test_payloads(spark):
    rows = [
        (1, '{"b": "5012909010825", "in": {"P1": "1 499,90", "odd": "x"}, "p2": ""}'),
        (2, "https://e.example/?barcode=1&p1=10&price1=20#p1=30"), (3, "p3=1;p3=2\nwl1c"), (4, ""), (5, None),
        (6, "{broken;ac=7+%2B"), (7, "b=5012909010825;b=12;p4=%zz"),
    ]
    got = payloads.qr_fields(spark.createDataFrame(rows, "id int, p string"), "id", "p")
    by = {r["id"]: r.asDict() for r in got.collect()}
    assert sorted(by) == [1, 2, 3, 6, 7]
    assert (by[1]["qr_code_barcode"], by[1]["price1_qr"], by[1]["price2_qr"], by[1]["unknown"]) == ("5012909010825", "1499.90", "нет", {"odd": "x"})
    assert (by[2]["qr_code_barcode"], by[2]["price1_qr"], by[2]["price3_qr"]) == ("", "20", "нет")
    assert (by[3]["price3_qr"], by[3]["wholesale_level_1_count"], by[3]["qr_code_barcode"]) == ("2", "нет", "нет")
    assert by[6]["action_code_qr"] == "7" and by[6]["unknown"] == {"{broken": ""}
    assert (by[7]["qr_code_barcode"], by[7]["price4_qr"]) == ("5012909010825", "%zz")
    assert got.limit(0).count() == 0


def test_label_rules(spark):
    rows = [
        (1, 1, "с картой", 0.0), (1, 2, "без карты", 50.0), (1, 3, "за 1 кг", 80.0), (1, 4, "ш", 90.0), (1, 5, "Ш", 95.0),
        (2, 1, "-22 %", 10.0), (2, 2, "45", 60.0), (3, 1, "__x__", 0.0),
    ]
    blocks = spark.createDataFrame(rows, "image int, ord int, text string, top double").withColumns(
        {"left": F.lit(0.0), "right": F.lit(10.0), "bottom": F.col("top") + 5, "conf": F.lit(0.9)}
    )
    colors = spark.createDataFrame([(1, "white"), (2, "red")], "image int, color string")
    types = labels.classify(blocks, colors)
    by = {r["image"]: r for r in types.collect()}
    assert [by[i]["family"] for i in (1, 2, 3)] == [labels.REGULAR, labels.RED, "unknown"]
    assert (by[1]["unit_type"], by[2]["confidence"], by[3]["confidence"], by[3]["format"]) == ("kg", 0.7, 0.0, "unknown")
    fields = {r["image"]: r for r in labels.extract(blocks, types).collect()}
    assert (fields[1]["special_symbols"], fields[1]["discount_amount"], fields[2]["discount_amount"]) == ("Ш", None, "-22%")
    marked = labels.absent_policy(spark.createDataFrame([(labels.RED, "", None), ("unknown", "", None)], "family string, discount_amount string, price_discount string"))
    assert [tuple(r) for r in marked.collect()] == [(labels.RED, "", "нет"), ("unknown", "", None)]


def test_conflicts_and_summary(spark):
    kinds = "query int, place int, name string, tokens array<string>"
    known = spark.createDataFrame(
        [(1, 1, "a", ["wine", "merlot"]), (1, 2, "b", ["wine", "syrah"]), (2, 1, "a", ["wine"]), (3, 1, "a", ["rose"]), (3, 2, "b", ["dry"])], kinds
    )
    said = spark.createDataFrame([(1, ["merlot", "wine"]), (2, ["wine"]), (3, ["rose", "dry"])], "query int, tokens array<string>")
    got = {r["query"]: (r["confidence"], r["bonus"], r["matched"]) for r in summary.resolve_conflict(known, said, "query").collect()}
    assert got == {1: ("high", 15, ["merlot"]), 2: ("conflict", 0, ["wine"]), 3: ("conflict", 0, ["rose"])}
    kinds = "group_id string, confidence string, product_name string, price_card string, color string, discount_amount string, barcode string, qr_code_barcode string, total_views int, processed_views int, early_stopped boolean, seconds double"
    rows = spark.createDataFrame([("g", "low", None, "нет", "red", None, None, "нет", 3, 3, False, 1.0), ("h", "high", "Green tea", "1", None, None, "1", None, 5, 2, True, 1.0)], kinds)
    judged = rows.withColumn("reasons", summary.problem_reasons(noisy_name(F.col("product_name"))))
    assert [r["reasons"] for r in judged.orderBy("group_id").collect()] == [["not_high", "bad_name", "no_card_price", "red_without_discount", "no_code", "all_views_used"], []]
    whole = summary.run_summary(judged).first()
    assert (whole["total_groups"], whole["processed_views_ratio"], whole["problem_count"], whole["slowest_group"]) == (2, 0.625, 1, "h")
    none = summary.run_summary(judged.limit(0)).first()
    assert (none["total_groups"], none["total_views"], none["processed_views_ratio"], none["slowest_group"]) == (0, 0, 0.0, None)


def test_grouped_views_and_manifest(spark, tmp_path):
    root = tmp_path / "run (1)"
    for p in ("b/2.jpg", "b/1.PNG", "b/deep/0.jpg", "a/x/y/9.jpeg", "c/note.txt", "0.jpg"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")
    rows = reports.read_grouped_views(spark, str(root)).orderBy("group_id", "view_ord").collect()
    assert [(r["group_id"], r["path"].rsplit("/", 1)[1], r["view_ord"]) for r in rows] == [("a", "9.jpeg", 1), ("b", "1.PNG", 1), ("b", "2.jpg", 2)]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "1.jpg").write_bytes(b"x")
    assert [r["group_id"] for r in reports.read_grouped_views(spark, str(tmp_path / "flat")).collect()] == ["flat"]
    for text, want in (
        (None, ("unknown", "name_json_not_found")), ("{x", ("unknown", "name_json_invalid")), ('{"department": 1}', ("unknown", "department_missing_or_invalid")),
        ("[1]", ("unknown", "department_missing_or_invalid")), ('﻿{"department": " wine/25 "}', ("wine/25", "department_read")),
    ):
        if text is not None:
            (root / "name.json").write_text(text, encoding="utf-8")
        assert tuple(reports.read_manifest(spark, str(root)).first()) == want


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("g", ["a", "b"], 1.5)], "group_id string, reasons array<string>, score double")
    reports.write_report(rows, "catalogue_match", str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True, escape='"')
    assert back.columns == reports.REPORTS["catalogue_match"] and back.first()["reasons"] == '["a","b"]'
    assert [len(reports.REPORTS[k]) for k in ("debug", "reference_match", "catalogue_match", "qr_check", "timing")] == [41, 30, 16, 11, 4]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    schema = "ts timestamp, group_id int, field string, value string, score int"
    early = [("2024-01-01 00:00:05", 1, "f", "a", 1), ("2024-01-01 00:00:09", 1, "f", "b", 2), ("2024-01-01 00:03:00", 1, "f", None, 9)]
    late = [("2024-01-01 00:00:07", 1, "f", "a", 1), ("2024-01-01 00:30:00", 2, "f", "z", 1)]

    def table(rows):
        return spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in (early, late):  # the second run takes up the state of the first
        table(rows).coalesce(1).write.mode("append").parquet(source)
        write_once(windowed_votes(spark.readStream.schema(schema).parquet(source), "1 minute", "5 minutes"), out, mark)
    got = [tuple(r)[1:] for r in spark.read.parquet(out).collect()]
    assert got == [(1, "f", "a", 2)]
    assert sorted(tuple(r)[1:] for r in windowed_votes(table(early + late), "1 minute", "5 minutes").collect()) == [(1, "f", "a", 2), (2, "f", "z", 1)]


def test_block_texts(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]

    for text, reason in (
        (None, "empty"), (" ", "empty"), ("__k", "service"), ("01.02.2024", "date"), ("10:30", "time"), ("-22 %", "discount"), ("1 499,90", "numeric"),
        ("a12345678", "long_digits"), ("12_3-4", "layout_code"), ("Цена", "service_label"), ("#1", "no_letters"), ("##a#", "too_many_specials"), ("Вино бел", None),
    ):
        assert one(T.rejected_name, text) == reason, text
    for text, price in (("1 499,90 p", "1499.90"), ("149990", "1499.90"), ("14999", "1499.90"), ("1.2.3", None), ("12", None), (None, None)):
        assert one(T.red_price, text) == price
    assert one(T.without_card, "Б8З  карты") and one(T.without_card_red, "6 e з к а р т ы") and not one(T.without_card, None)
    assert one(T.scale_label, "Hoмep на вecах") is False and one(T.scale_label, "Номep на веcах") is False and one(T.scale_label, "Номер на вeсах")
    assert one(T.clean_name, "Внмо  HAUТ , 0 , 75 l бел: сух") == "Вино HAUT, 0.75L бел. сух."
    assert one(lambda c: T.likely_quantity(F.lit(10.0), c), "в уп. 10 ШТ") and not one(lambda c: T.likely_quantity(F.lit(10.5), c), "10 шт")
    assert not one(lambda c: T.likely_quantity(F.lit(10.0), c), "110 шт")
    assert [one(T.lenient_int, t) for t in ("3.7", "x", None)] == [3, 0, 0] and one(T.lenient_bool, " Yes ") and not one(T.lenient_bool, None)
    assert one(T.lenient_object, '{"a": 1}') == {"a": "1"} and one(T.lenient_object, "[1]") == {} and one(T.lenient_object, "{") == {}
