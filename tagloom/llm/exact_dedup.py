"""Exact de-duplication by a tree merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import ascii_lower, stage

KEY = ["digest", "check", "n_bytes"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row per document in sorted runs, a run for each input partition: digest, a second hash and the length.

    Equality rests on SHA-256, a second 64-bit hash and the length; texts themselves aren't compared. `row` tells repeated rows apart."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    runs = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(runs.sortWithinPartitions(*KEY), "digest-runs")


def tree_merge(runs: DataFrame, order: int = 3) -> tuple[DataFrame, DataFrame]:
    """Merges the runs in binomial rounds: in each, 2**order neighbouring runs become one sorted run.

    Every round keeps, for each verified key, the best identifier and the number of documents. A key held by a third of
    all documents has a row for each run at most. Returns the first level (for the way back) and the last."""
    merged = first = runs.groupBy(*KEY, "run").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    width = max(1, runs.agg(F.max("run").alias("r")).first()["r"] or 0)
    while width:
        width >>= order
        merged = merged.groupBy(*KEY, F.shiftright("run", order).alias("run")).agg(
            F.max("best").alias("best"), F.sum("n").alias("n")
        )
    return first, merged.drop("run")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.

    Texts are equal when they are after lower-casing A-Z; a null text counts as empty. The row with the largest doc_id
    of a group stays (a null id only where all are null, and then keep_id is null); of repeated rows with that id one.
    An empty table gives an empty result, and further columns of docs play no part."""
    runs = digest_runs(docs)
    first, last = tree_merge(runs)
    # down the tree: the winners reach the first level by key, and the documents by key and run, so no key is hot
    down = first.select(*KEY, "run").join(last, KEY)
    return runs.join(down, [*KEY, "run"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the columns of docs, whatever their names.

    A null text counts as empty, so of rows with null and empty texts one stays. Of repeated rows one stays. An empty
    table stays empty."""
    _, last = tree_merge(digest_runs(docs))
    # identifier and digest in one string: the same partitioning serves the join and the choice among repeated rows
    name = next(n for n in (f"_row{i}_" for i in range(len(docs.columns) + 1)) if not any(c.startswith(n) for c in docs.columns))

    def key(doc_id: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), digest).alias(name)

    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    keep = last.select(key(F.col("best.doc_id"), F.lower(F.hex("digest"))))
    marked = docs.select("*", key(F.col("doc_id"), digest))
    turn = F.row_number().over(Window.partitionBy(name).orderBy(name))
    kept = marked.join(keep, name, "left_semi").select("*", turn.alias(f"{name}turn"))
    return kept.where(F.col(f"{name}turn") == 1).select(*docs.columns)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
