"""Round trips of the file sources and sinks."""

import json

from tagloom.schema import COLUMNS
from tagloom.sources import files, views


def test_reference_and_results(spark, tmp_path):
    (tmp_path / "7_1.csv").write_text('﻿filename,product_name,wholesale_level_1_coun,price_card\na,"x ""y""\nz",3,\n', encoding="utf-8")
    rows = files.read_reference(spark, str(tmp_path / "7_1.csv"))
    row = rows.first()
    assert (row["filename"], row["product_name"], row["wholesale_level_1_count"], row["price_card"]) == ("a", 'x "y"\nz', "3", None)
    assert row["reference_key"] == "7_1"
    out = str(tmp_path / "out")
    files.write_results(rows, out)
    files.write_results(rows, out, mode="append")
    again = files.read_reference(spark, out)
    assert again.count() == 2 and again.columns[1:] == COLUMNS and again.first()["product_name"] == 'x "y"\nz'


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("fullname;code\nТовар 1; 12\n ;3\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_catalogue(spark, str(tmp_path / "c.csv")).collect()] == [("Товар 1", "12")]


def test_catalogue_encodings(spark, tmp_path):
    """Windows-1251, UTF-8 (the byte 152 isn't Windows-1251), a broken UTF-8 and one with a byte order mark."""
    text = "fullname;code\nИкра;1\n\"а;б\n\"\"в\"\"\";2\n"
    for name, data in (
        ("cp", text.encode("cp1251")), ("utf", text.encode("utf-8")), ("bad", text.encode("utf-8") + b"\xff\xd0\x98;3\n"),
        ("mark", "code;fullname\n1;Вино\n".encode("utf-8-sig")),
    ):
        (tmp_path / f"{name}.csv").write_bytes(data)
    both = sorted([("а;б\n\"в\"", "2"), ("Икра", "1")])
    got = lambda name: sorted(tuple(r) for r in files.read_catalogue(spark, str(tmp_path / name), encoding="auto").collect())
    assert got("cp.csv") == both and got("utf.csv") == both
    assert got("bad.csv") == sorted([*both, ("\ufffdИ", "3")]) and got("mark.csv") == [("Вино", "1")]
    (tmp_path / "mixed").mkdir()
    for name in ("cp", "utf"):
        (tmp_path / "mixed" / f"{name}.csv").write_bytes((tmp_path / f"{name}.csv").read_bytes())
    assert got("mixed") == sorted(both * 2)


def test_views_and_their_metadata(spark, tmp_path):
    root = tmp_path / "run 1+2"
    meta = {
        "a/data.json": '\ufeff{"frame_index": 3, "bbox": [1, 2, 5, "4,5"], "item_id": 0, "product_id": 7}', "a/1.json": '{"score": 1}',
        "b/2.json": '{"score": "0,5", "center": {"x": 9}, "bbox_size": {"w": 3}, "filename": "v"}', "b/0.json": '{"blur_score": 2, "bbox": {"x_min": 1}}',
        "c/deep/z.json": "[1]", "d/x.txt": "",
    }
    for p, text in meta.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text, encoding="utf-8")
    for p in ("a/1.jpg", "b/2.jpg", "b/3.png", "c/deep/4.jpeg", "e/5.jpg", "6.jpg"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")
    rows = {r.path[len(str(root)) + 1 :]: r for r in views.read_views(spark, str(root)).collect()}
    picked = {k: r.metadata and r.metadata[len(str(root)) + 1 :] for k, r in rows.items()}
    assert picked == {"a/1.jpg": "a/data.json", "b/2.jpg": "b/2.json", "b/3.png": "b/0.json", "c/deep/4.jpeg": "c/deep/z.json", "e/5.jpg": None}
    a, b, c = rows["a/1.jpg"], rows["b/2.jpg"], rows["b/3.png"]
    assert (a.group_id, a.frame_timestamp, a.x_max, a.y_max, a.bbox_width, a.center_y, a.area, a.product_id_above_tag) == ("a", "3", 5.0, 4.5, 4.0, 3.25, 10.0, "7")
    assert (b.confidence, b.center_x, b.bbox_width, b.bbox_height, b.video_filename, b.view_ord) == (0.5, 9.0, 3.0, None, "v", 1)
    assert (c.sharpness, c.x_min, c.area, c.view_ord) == (2.0, 1.0, None, 2) and rows["c/deep/4.jpeg"].frame_timestamp is None
    plan = views.list_files(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and views.list_files(spark, str(root)).count() == 12


def test_blocks_metadata_and_traces(spark, tmp_path):
    block = {"text": "12", "confidence": 0.5, "bbox": [[0, 1], [2, 3]], "source": "s"}
    for name, version in (("a", "v1"), ("b", "v0")):
        stored = {"image_path": name, "ocr_profile": "p", "cache_version": version, "results": [block]}
        (tmp_path / f"{name}.json").write_text(json.dumps(stored))
    rows = files.read_blocks(spark, str(tmp_path / "*.json")).collect()
    assert [(r["image"], r["ord"], r["text"], r["box"][1]["y"]) for r in rows] == [("a", 0, "12", 3.0)]
    (tmp_path / "m").mkdir()
    for name, text in (("1", '﻿{"a": 1}'), ("2", "[1]"), ("3", "{broken")):
        (tmp_path / "m" / name).write_text(text, encoding="utf-8")
    meta = files.read_metadata(spark, str(tmp_path / "m"))
    assert [r[0] for r in meta.orderBy("path").selectExpr("try_variant_get(meta, '$.a', 'int')").collect()] == [1, None, None]
    files.write_traces(spark.createDataFrame([(1, "x")], "g int, v string"), str(tmp_path / "t"), "g")
    assert spark.read.json(str(tmp_path / "t")).first()["trace"]["v"] == "x"
