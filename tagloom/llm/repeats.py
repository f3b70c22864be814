"""Finding windows that occur more than once in a corpus, the common part of substring and suffix de-duplication.

A window is a run of `width` symbols of one document. Of the runs of `gram` symbols inside a window, the one with the
least hash is its anchor (the leftmost of equal ones); equal windows have equal anchors at equal places. Consecutive
windows with the same anchor form a segment, which travels as one string. Longer windows may be judged in the same pass:
their anchor is that of the window they begin with, and strings reach as far as the longest of them.

1. `anchors`: each document's anchor hashes. An anchor that occurs once can't lie in a repeated window.
2. `flag`: counts anchors over all documents and gives each document its repeated anchors. Anchors that hold over a
   thousandth of all segments are hot; there are a thousand at most.
3. `segments`: documents with repeated anchors send those segments, equal ones of a batch as one row with the list of
   their places. Segments of a hot anchor are split by the next best anchor that isn't hot, so that a passage that many
   documents share doesn't lead all their contexts into one task.
4. `repeated_runs`: the segments of an anchor meet in a task, in a stream of whole groups, and a `judge` says which
   windows of each segment are repeated.
5. The runs go back to their documents by row key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blocks, bound_batches, mix, rolling, row_key, stage

#: Windows of a document looked at at once; a longer document is cut into such parts, which overlap by width - 1.
PART = 1 << 20
#: Share of all segments over which an anchor is hot.
HOT_SHARE = 1000
_LOW = np.uint64((1 << 22) - 1)
PLACE = np.dtype([("key", "<i8"), ("start", "<i8")])


@dataclass(frozen=True)
class Kind:
    """What symbols are. `symbols` maps texts to one array of symbol values, their counts per text, and a function that
    cuts the string of symbols [a, b) out of the whole."""

    width: int
    gram: int
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]]
    longest: int = 0
    """Symbols of the longest windows that are judged, if longer than width."""


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of `width` values."""
    n, size, least = len(values) - width + 1, 1, values
    while 2 * size <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


@dataclass
class Segments:
    """Segments of a batch: text index, first window, windows, anchor place and hash (all by the symbols of the batch)."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def cut(values: np.ndarray, counts: np.ndarray, kind: Kind, hot: np.ndarray | None = None) -> Segments:
    """The segments of texts laid end to end. With `hot`, windows with a hot anchor are cut anew, see the module."""
    found = []
    ends = np.cumsum(counts)
    starts = ends - counts
    whole = kind.width - kind.gram + 1
    long = counts > PART
    spans = []
    at = 0
    while at < len(counts):  # runs of short texts together, long texts in parts
        if long[at]:
            a, b = int(starts[at]), int(ends[at])
            spans += [(p, min(b, p + PART + kind.width - 1)) for p in range(a, max(a + 1, b - kind.width + 1), PART)]
            at += 1
        else:
            last = at
            while last < len(counts) and not long[last] and ends[last] - starts[at] <= 2 * PART:
                last += 1
            last = max(last, at + 1)
            spans.append((int(starts[at]), int(ends[last - 1])))
            at = last
    for a, b in spans:
        if b - a < kind.width:
            continue
        grams = rolling(values[a:b], kind.gram)
        place = np.arange(len(grams), dtype=np.uint64)
        best = _least((grams & ~_LOW) | place, whole)
        n = len(best)
        text = np.searchsorted(ends, np.arange(a, a + n), side="right")
        valid = ends[text] - np.arange(a, a + n) >= kind.width
        anchor = (best & _LOW).astype(np.int64)
        key = grams[anchor]
        if hot is not None and len(hot):
            warm = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
            if warm.any():
                top = np.uint64(1 << 63)
                second = _least((((grams >> np.uint64(1)) | np.where(warm, top, np.uint64(0))) & ~_LOW) | place, whole)
                other = (second & _LOW).astype(np.int64)
                again = warm[anchor]
                key = np.where(again, mix(key ^ mix(grams[other] + np.uint64(1))), key)
                anchor = np.where(again, other, anchor)
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        first = np.flatnonzero(change & valid)
        if not len(first):
            continue
        # a segment ends at the next change or where windows leave the text
        bound = np.flatnonzero(np.append(change | ~valid, True))
        stop = bound[np.searchsorted(bound, first, side="right")]
        found.append(
            Segments(text[first], first + a, stop - first, anchor[first] + a, key[first])
        )
    if not found:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none.astype(np.uint64))
    return Segments(*(np.concatenate([getattr(s, f) for s in found]) for f in Segments.__dataclass_fields__))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with nothing but doc_id, text (null: empty) and the row key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "key", row_key(F.col("doc_id"), F.col("text"))
    )


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def anchors(rows: DataFrame, kind: Kind) -> DataFrame:
    """key and the anchors of each document's segments, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
            for some in blocks(texts, [len(t) for t in texts]):
                values, counts, _ = kind.symbols([texts[i] for i in some])
                seg = cut(values, counts, kind)
                order = np.lexsort((seg.key, seg.text))
                text, key = seg.text[order], seg.key[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
                # how often an anchor starts a segment of the document; all that counts is whether it is once
                size = np.diff(np.append(np.flatnonzero(new), len(text)))
                text, key = np.repeat(text[new], np.minimum(size, 2)), np.repeat(key[new], np.minimum(size, 2))
                offsets = np.searchsorted(text, np.arange(len(some) + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), lists], names=["key", "anchors"])

    return rows.select("key", "text").mapInArrow(run, "key long, anchors array<long>")


def flag(found: DataFrame) -> tuple[DataFrame, list[int]]:
    """Each document's repeated anchors (only documents that have any), and the hot anchors."""
    each = found.select("key", F.explode("anchors").alias("anchor"))
    counts = stage(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    total = found.agg(F.sum(F.size("anchors")).alias("n")).first()["n"] or 0
    bar = max(100, total // HOT_SHARE)
    hot = [r["anchor"] for r in counts.where(F.col("n") > bar).select("anchor").collect()]  # under HOT_SHARE of them
    spark = found.sparkSession
    known = F.broadcast(spark.createDataFrame([(a,) for a in hot], "anchor long"))
    flagged = each.join(known, "anchor", "left_semi").unionByName(
        each.join(known, "anchor", "left_anti").join(counts.where(F.col("n") <= bar).select("anchor"), "anchor")
    )
    return flagged.groupBy("key").agg(F.collect_set("anchor").alias("flags")), hot


def segments(flagged: DataFrame, kind: Kind, hot: list[int]) -> DataFrame:
    """The segments of repeated anchors of rows (key, text, flags): anchor key, place of the anchor, windows, string, places.

    `places` are packed pairs of row key and first window. Equal segments of a batch are one row."""
    hot_keys = np.sort(np.array(hot, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
            flags = batch.column(2)
            for some in blocks(texts, [len(t) for t in texts]):
                values, counts, string = kind.symbols([texts[i] for i in some])
                own = flags.take(pa.array(some))
                sizes = own.value_lengths().to_numpy()
                marks = own.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(some)), sizes).astype(np.uint64)
                plain = cut(values, counts, kind)
                wanted = np.isin(mix(plain.key ^ mix(plain.text)), mix(marks ^ mix(owner)))
                warm = np.isin(plain.key, hot_keys)
                parts = [(plain, wanted & ~warm)]
                if (wanted & warm).any():
                    # cut by the next anchors, and take the parts of these segments only
                    other = cut(values, counts, kind, hot_keys)
                    heads = plain.start[wanted & warm]
                    tails = heads + plain.n[wanted & warm]
                    at = np.searchsorted(heads, other.start, side="right") - 1
                    inside = (at >= 0) & (other.start < tails[np.maximum(at, 0)])
                    parts.append((other, inside))
                first = np.cumsum(counts) - counts
                limit, reach = np.cumsum(counts).tolist(), max(kind.width, kind.longest)
                gathered: dict[tuple[int, int, int, bytes], list[tuple[int, int]]] = {}
                for seg, take in parts:
                    for t, start, n, anchor, key in zip(
                        *(getattr(seg, f)[take].tolist() for f in ("text", "start", "n", "anchor", "key")), strict=True
                    ):
                        place = (int(keys[some[t]]), start - int(first[t]))
                        whole = (key, anchor - start, n, string(start, min(start + n + reach - 1, limit[t])))
                        gathered.setdefault(whole, []).append(place)
                if not gathered:
                    continue
                anchor_keys, at, windows, strings = zip(*gathered, strict=True)
                places = [np.array(p, PLACE).tobytes() for p in gathered.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(anchor_keys, np.uint64).view(np.int64)),
                        pa.array(at, pa.int32()),
                        pa.array(windows, pa.int32()),
                        pa.array(strings, pa.binary()),
                        pa.array(places, pa.binary()),
                    ],
                    names=["anchor", "at", "n", "segment", "places"],
                )

    return flagged.select("key", "text", "flags").mapInArrow(
        run, "anchor long, at int, n int, segment binary, places binary"
    )


#: A judge gets groups: for each, the distinct segments as (anchor place, windows, string) and the weight of each, which
#: is how often it occurs unless `weigh` says otherwise. It returns, for each group, for each segment its runs of repeated
#: windows as (first, end, width of the windows).
Judge = Callable[[list[tuple[list[tuple[int, int, bytes]], list]]], list[list[list[tuple[int, int, int]]]]]
#: Bytes of segments that a judge gets at once; a larger group is alone.
GROUP_BYTES = 4 << 20


def occurrences(rows: list[tuple]) -> int:
    return sum(len(row[0]) for row in rows) // PLACE.itemsize


def repeated_runs(sent: DataFrame, judge: Judge, weigh: Callable[[list[tuple]], object] = occurrences) -> DataFrame:
    """key, first, last, width: runs [first, last) of repeated windows, for all places of the segments.

    `weigh` gets the rows of a segment: their places and whatever columns follow."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        current, group, size = None, {}, 0
        for batch in batches:
            for anchor, at, n, segment, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != current:
                    if group:
                        yield group, size
                    current, group, size = anchor, {}, 0
                known = group.get((at, n, segment))
                if known is None:
                    group[at, n, segment] = [rest]
                    size += len(segment)
                else:
                    known.append(rest)
        if group:
            yield group, size

    def judged(some: list[dict]) -> pa.RecordBatch:
        asked = [(list(g), [weigh(rows) for rows in g.values()]) for g in some]
        keys, firsts, lasts, widths = [], [], [], []
        for group, answer in zip(some, judge(asked), strict=True):
            for rows, runs in zip(group.values(), answer, strict=True):
                if runs:
                    spots = np.frombuffer(b"".join([row[0] for row in rows]), PLACE)
                    for a, b, width in runs:
                        widths.append(np.full(len(spots), width))
                        keys.append(spots["key"])
                        firsts.append(spots["start"] + a)
                        lasts.append(spots["start"] + b)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, firsts, lasts, widths)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "first", "last", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, total = [], 0
        for group, size in groups(batches):
            if some and total + size > GROUP_BYTES:
                yield judged(some)
                some, total = [], 0
            some.append(group)
            total += size
        if some:
            yield judged(some)

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        sent.repartition(n, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(run, "key long, first long, last long, width int")
    )


def rows_with_runs(docs: DataFrame, kind: Kind, judge: Judge) -> DataFrame:
    """doc_id, text and the runs of repeated windows (array of first, last, width; null where there are none) of each row."""
    bound_batches(docs.sparkSession)
    rows = keyed(docs)
    found = stage(anchors(rows, kind), "segment-anchors")
    flags, hot = flag(found)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key")  # read twice, shuffled once
    flagged = dealt.join(stage(flags, "flags"), "key").select("key", "doc_id", "text", "flags")
    runs = repeated_runs(segments(flagged, kind, hot), judge)
    own = runs.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last", "width"))).alias("runs"))
    return dealt.join(own, "key", "left").select("doc_id", "text", "runs")
