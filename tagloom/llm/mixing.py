"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of word
counts, and a cut at each source's exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import stage

SPACES = " \t\n\x0b\x0c\r"
#: Weights of the sources in code-point order, repeating; all sources together get SHARE of all words, none more than
#: MOST times its own.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
ORDER = ["key", "doc_id", "tie"]


def word_count(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; null has none. Each run becomes one character, so a long text
    makes no array of its words."""
    runs = F.regexp_replace(F.btrim(text, F.lit(SPACES)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", ".")
    return F.coalesce(F.char_length(runs), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of the rows (source, source_size), of which there is one for each source.

    What a source can't take goes to the others by weight, again and again: in the end every source takes the same words
    per weight, but for those that this fills. These are the sources of least size per weight, so running sums in that
    order find them at once. Sources are a recipe's, so their table passes one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    limit = F.col("source_size") * most
    w = sizes.select("source", "source_size", weight.alias("weight"), limit.alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything).cast("double") * share
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    w = w.select("*", budget.alias("budget"), (level > F.col("limit") / F.col("weight")).alias("full"))
    filled = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    even = (F.col("budget") - filled) / open_weight * F.col("weight")
    return w.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(even).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 1,
    texts: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and place, one row for each row of docs; with texts the text too.

    Documents of a source are ordered by MD5 of seed and doc_id. The mix takes the whole source as often as its target
    holds it, and then words from the start of that order until the target, rounded to words, is met: the document at
    the cut gives its first words. `place` is the number of words of the source before the document.

    A null text has no words, a null source is the last source, documents with a null id share a key. Rows with equal ids
    are ordered by a hash of their texts, repeated rows are alike, so which comes first changes nothing. An empty table
    gives none, and further columns of docs play no part. The order is kept as ranges of a table: a source that holds
    most rows has many ranges, each with one sum, and no task sees more than a range or the sums of one source."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    slim = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"),
        *(["text"] if texts else []),
    )
    ranged = stage(slim.repartitionByRange("source", *ORDER).select("*", F.spark_partition_id().alias("part")), "mix")
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    wanted = targets(ranged.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    words = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    wanted = wanted.select(F.col("source").alias("of"), "source_size", "target", words.alias("words"), rounds.alias("rounds"))
    ranges = sums.join(wanted, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("of"), F.col("part").alias("range"), "before", "source_size", "target", "rounds",
        (F.col("words") - F.col("rounds") * F.col("source_size")).alias("rest"),
    )
    joined = ranged.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("range")))
    inside = Window.partitionBy("source", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("place")))
    return joined.select("*", place.alias("place")).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + last).cast("long").alias("taken"), "place", *(["text"] if texts else []),
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 1), words and text, one row each time a document is taken. The document
    at a source's cut keeps its text up to the last word taken. Documents without words are not taken."""
    taken = mix(docs, texts=True, **options).where(F.col("taken") > 0)
    epochs = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = taken.select("*", F.explode(epochs).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    trimmed = F.ltrim(F.col("text"), F.lit(SPACES))
    rest = F.element_at(F.split(trimmed, r"[\x20\x09-\x0D]+", (F.col("words") + 1).cast("int")), -1)
    head = F.rtrim(F.left(trimmed, F.char_length(trimmed) - F.char_length(rest)), F.lit(SPACES))
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text"))
    return rows.select("*", words.alias("words")).select("doc_id", "source", "epoch", "words", text.alias("text"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('1:' || doc_id) AS key
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2 AS most,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget,
    (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE
      > most / weight AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE
    (budget - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)::DOUBLE)
    / sum(CASE WHEN NOT is_full THEN weight END) OVER ()::DOUBLE * weight END AS target FROM l),
r AS (SELECT *, round(target)::BIGINT AS words,
    CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d)
SELECT doc_id, p.source, size, source_size, target,
  (rounds * size + greatest(0, least(size, words - rounds * source_size - place)))::BIGINT AS taken, place
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
