"""Files in and out: reference and catalogue tables, stored blocks, view metadata, results and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.schema import COLUMNS, result_row

#: Header names that occur misspelt, and the layout of stored blocks.
HEADERS = {"wholesale_level_1_coun": "wholesale_level_1_count"}
BLOCKS = (
    "image_path string, ocr_profile string, cache_version string, "
    "results array<struct<text: string, confidence: double, bbox: array<array<double>>, source: string>>"
)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Result columns of comma-separated files with quoted line breaks, and the file's name as reference_key.

    All strings; the byte order mark and misspelt headers are seen to, empty strings are unknown."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    for name in rows.columns:
        plain = name.strip().strip("﻿")
        rows = rows.withColumnRenamed(name, HEADERS.get(plain, plain))
    key = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    return result_row(rows.withColumn("reference_key", key), "reference_key")


#: The characters of bytes 128 to 255 in Latin-1, which keeps every byte, and in Windows-1251, which lacks 152.
_BYTES = bytes(b for b in range(128, 256) if b != 152)
_KEPT, _CYRILLIC = _BYTES.decode("latin-1"), _BYTES.decode("cp1251")


def read_catalogue(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """fullname, code of semicolon-separated files with a header; rows without a name are dropped, further columns too.

    encoding="auto": each file is read as Windows-1251 if all its bytes are that (only 152 isn't), else as UTF-8, else as
    UTF-8 with replacement characters; a byte order mark says UTF-8 at once. Files are parsed byte for byte (as Latin-1),
    each file's fields are checked, and then decoded."""
    auto = encoding == "auto"
    options = {"sep": ";", "header": True, "quote": '"', "escape": '"', "multiLine": True}
    rows = spark.read.csv(path, encoding="ISO-8859-1" if auto else encoding, **options)
    plain = {c: c.strip().removeprefix("\ufeff").removeprefix("\xef\xbb\xbf") for c in rows.columns}
    file = F.col("_metadata.file_path").alias("file")
    fields = [F.col(f"`{c}`").alias(n) for c, n in plain.items() if n in ("fullname", "code")]
    raw = rows.select(file, *fields)
    if "code" not in raw.columns:
        raw = raw.withColumn("code", F.lit(None).cast("string"))
    if auto:
        marked = any(c.startswith("\xef\xbb\xbf") for c in rows.columns)
        both = F.concat_ws(" ", "fullname", "code")
        as_bytes = lambda c: F.encode(c, "ISO-8859-1").cast("string")
        kinds = raw.groupBy("file").agg(F.bool_and(~F.contains(both, F.lit("\x98"))).alias("cyrillic"))
        kind = F.col("cyrillic") & F.lit(not marked)
        # of what isn't UTF-8, only the wrong bytes are replaced
        decoded = lambda c: F.when(kind, F.translate(c, _KEPT, _CYRILLIC)).otherwise(F.make_valid_utf8(as_bytes(F.col(c))))
        raw = raw.join(kinds, "file").select(decoded("fullname").alias("fullname"), decoded("code").alias("code"))
    return raw.select(F.trim("fullname").alias("fullname"), F.trim("code").alias("code")).where("fullname != ''")


def read_blocks(spark: SparkSession, path: str, version: str = "v1") -> DataFrame:
    """image, profile, ord, text, conf, box: stored blocks of this version; others, and broken files, count as missing."""
    stored = spark.read.json(path, schema=BLOCKS, multiLine=True).where(F.col("cache_version") == version)
    rows = stored.select("image_path", "ocr_profile", F.posexplode("results").alias("ord", "b"))
    box = F.transform("b.bbox", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(
        F.col("image_path").alias("image"), F.col("ocr_profile").alias("profile"), "ord", "b.text",
        F.col("b.confidence").alias("conf"), box.alias("box"), "b.source",
    )


def read_metadata_text(spark: SparkSession, root: str) -> DataFrame:
    """path, json of all JSON files under a folder, as text without a byte order mark; paths as a listing has them."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return rows.select(path.alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("json"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, meta: a variant for each file; null where it is broken or no object."""
    text = F.regexp_replace("value", "^﻿", "")
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.alias("t"))
    meta = F.when(F.trim("t").startswith("{"), F.try_parse_json("t"))
    return rows.select("path", meta.alias("meta"))


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The result columns in order with a header, unknown as empty; mode append adds files of the same layout."""
    out = rows.select(*(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))
    out.write.mode(mode).csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_traces(rows: DataFrame, path: str, key: str) -> None:
    """One nested JSON object for each row, dealt over folders by nothing: the key stays a field."""
    out = rows.select(key, F.struct(*(c for c in rows.columns if c != key)).alias("trace"))
    out.write.mode("overwrite").json(path)
