"""Benchmark decontamination by spaced seeds.

Fixed masks over consecutive words ignore some positions, so that a seed is hit in spite of substituted words there. The
seeds of training documents are joined with those of the benchmark, and around each hit the item is laid along the
document: it is found if a stretch of the overlap agrees but for a few substitutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bit_filter, bound_batches, in_filter, mix, row_key, stage, text_blocks
from tagloom.llm.tokens import word_hashes

#: Fixed masks; 1 is a word that counts, 0 one that may differ. With any two words of 13 substituted one of them is hit,
#: and likewise of 12 for the second set.
MASKS = ("111101111", "1110111011", "11010011111", "111110100011", "110001111011")
MASKS_12 = ("11111011", "110101111", "11101100011", "110000011111")
#: Words of the overlap that must agree but for a sixth of them. Items with fewer words must agree as a whole, but for a
#: sixth as well.
OVERLAP = 13


def masks_of(n: int) -> tuple[str, ...]:
    """Masks for an item of n words, one of which is hit wherever a sixth of an overlap's words is substituted."""
    if n >= 12:
        return MASKS if n >= OVERLAP else MASKS_12
    if n < 6:
        return ("=" + "1" * n,)  # no word may differ: a seed apart from others, of which one place in a text is enough
    third = -(-n // 3)  # one substitution lies in the first third, in the last one, or between them
    return "1" * (n - third), "1" * third + "0" * (n - 2 * third) + "1" * third


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words that the mask counts, at each place."""
    exact, mask = mask.startswith("="), mask.lstrip("=")
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = [i for i, c in enumerate(mask) if c == "1"]
    total = np.full(n, len(mask) * 1000 + len(at) + 500 * exact, np.uint64)
    for i in at:
        total = (total ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return mix(total)


def overlap_found(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The agreeing stretch (first, last in the document, words that agree) of the item laid at doc[shift], if long
    enough: all its windows of OVERLAP words have a sixth of substitutions at most."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(OVERLAP, len(item))
    if b - a < width:
        return None
    same = item[a:b] == doc[a + shift : b + shift]
    sums = np.cumsum(np.concatenate(([0], same)))
    good = np.flatnonzero(sums[width:] - sums[:-width] >= width - width // 6)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + width
    return first + a + shift, last + a + shift, int(sums[last] - sums[first])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, words, places and seeds of each item, by the masks of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = (c.to_pylist() for c in batch.columns)
            for key, i, text in zip(keys, ids, texts, strict=True):
                words, _ = word_hashes([text or ""])
                if not len(words):
                    continue
                found = [seeds(words, m) for m in masks_of(len(words))]
                places = np.concatenate([np.arange(len(s)) for s in found]).astype(np.int32)
                row = [key, i, words.view(np.int64), places, np.concatenate(found).view(np.int64)]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                    names=["item_key", "item_id", "words", "places", "seeds"],
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    return rows.select(row_key(F.col("i"), F.col("t")), "i", "t").mapInArrow(
        run, "item_key long, item_id long, words array<long>, places array<int>, seeds array<long>"
    )


def candidates(docs: DataFrame, bits: np.ndarray, masks: list[str]) -> DataFrame:
    """key, words, places and seeds of the documents with seeds that may be of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for some, texts in text_blocks(batch.column(1)):
                words, counts = word_hashes(texts)
                ends = np.cumsum(counts)
                text = np.repeat(np.arange(len(some)), counts)
                owners, places, values = [], [], []
                for mask in masks:
                    value = seeds(words, mask)
                    at = np.flatnonzero(in_filter(known, value))
                    at = at[ends[text[at]] - at >= len(mask.lstrip("="))]
                    if mask.startswith("="):  # the first place of each seed in a text
                        at = at[np.sort(np.unique(mix(value[at]) ^ mix(text[at].astype(np.uint64) + np.uint64(1)), return_index=True)[1])]
                    owners.append(text[at])
                    places.append(at - (ends - counts)[text[at]])
                    values.append(value[at])
                owner, place, value = map(np.concatenate, (owners, places, values))
                order = np.argsort(owner, kind="stable")
                owner, place, value = owner[order], place[order], value[order]
                have = np.unique(owner)
                if not len(have):
                    continue
                cut = np.append(np.searchsorted(owner, have), len(owner)).astype(np.int32)
                own_words = [words[ends[t] - counts[t] : ends[t]].view(np.int64) for t in have]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[np.array(some)[have]]),
                        pa.array(own_words, pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(place.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(value.view(np.int64))),
                    ],
                    names=["key", "words", "places", "seeds"],
                )

    rows = docs.select(row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.col("text").cast("string"))
    return rows.mapInArrow(run, "key long, words array<long>, places array<int>, seeds array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, item_id, first, last, agree: verified overlaps of documents (by row key) with items, in words."""
    bound_batches(docs.sparkSession)
    items = stage(benchmark_seeds(benchmark), "benchmark-seeds")
    each = items.select("item_key", F.explode(F.arrays_zip("places", "seeds")).alias("s"))
    each = each.select("item_key", F.col("s.places").alias("item_at"), F.col("s.seeds").alias("seed"))
    sizes = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < OVERLAP).distinct().collect()]
    masks = sorted({m for n in (OVERLAP, *sizes) for m in masks_of(n)})  # a few for each length under OVERLAP, at most
    found = stage(candidates(docs, bit_filter(each, "seed", 25), masks), "seed-hits").dropDuplicates(["key"])
    hits = found.select("key", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select(
        "key", F.col("s.places").alias("at"), F.col("s.seeds").alias("seed")
    )
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    # a text meets an item once, with the words of both and all shifts (no more than the words of both)
    laid = hits.join(each, "seed").groupBy("key", "item_key").agg(F.collect_set(shift).alias("shifts"))
    texts = items.dropDuplicates(["item_key"]).select("item_key", "item_id", F.col("words").alias("item_words"))
    both = laid.join(texts, "item_key").join(found.select("key", "words"), "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, shifts, item_id, item, words in zip(*batch.columns, strict=True):
                item, words = item.values.to_numpy(), words.values.to_numpy()
                for shift in shifts.values.to_pylist():
                    got = overlap_found(item, words, shift)
                    if got:
                        rows.append((key.as_py(), item_id.as_py(), *got))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["key", "item_id", "first", "last", "agree"]
            )

    return both.select("key", "shifts", "item_id", "item_words", "words").mapInArrow(
        verify, "key long, item_id long, first long, last long, agree long"
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), longest (words of the longest overlap), a row for each row.

    Null texts count as empty and are clean; items without words, and an empty benchmark, find nothing. An item of a few
    words is found wherever these stand in a row, so a benchmark of single words marks most texts. Repeated rows get the same result; a null item_id counts as an item but isn't listed."""
    found = leaks(docs, benchmark).groupBy("key").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max(F.col("last") - F.col("first")).alias("longest"),
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"),
    )
    return rows.join(found, "key", "left").select(
        "doc_id",
        F.col("longest").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of docs, with the columns of docs.

    Rows with null texts and repeated clean rows stay, and of repeated rows with an overlap all go; an empty benchmark or
    table changes nothing. Column names of docs may be any."""
    key = row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = stage(leaks(docs, benchmark).select(F.col("key").alias("_leak_")).distinct(), "leaks")
    return docs.join(found, key == found["_leak_"], "left_anti")
