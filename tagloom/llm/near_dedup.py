"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Document frequencies of shingles are held in a count-min sketch of fixed size, which covers all documents.
2. Each distinct text gets K samples: for each, the shingle with the least value of Ioffe's improved consistent weighted
   sampling, with its quantised weight. Two texts agree in a sample with the probability of their weighted Jaccard
   similarity. Texts with the same words in a row are one text from here on.
3. Samples are banded. In a bucket each text is paired with the least and the greatest of the bucket, and of the bucket
   refined by the next band.
   Pairs that agree in too few of all samples for the similarity are left out; the samples are far smaller than texts.
4. Pairs are verified by the weighted Jaccard similarity of the whole texts. Their connected components, by star
   contraction, are classes so far.
5. Buckets that still hold several classes are compared out: all their pairs of different classes, in tiles of two salted
   blocks, by samples and then by whole texts. The work grows with the square of the texts of a bucket that are not of
   its largest class.
6. Connected components of the classes over these pairs are the classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import bit_filter, blocks, bound_batches, in_filter, mix, row_key, stage, text_blocks
from tagloom.llm.tokens import shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band once in 300,000 times.
BANDS, ROWS = 24, 4
#: Samples that a pair must agree in: five standard deviations below the mean at similarity 0.8 (lost: 1 in a million).
AGREE = 56
#: Counters of a row of the sketch, rows, and counters of a block that travels as one row.
WIDTH, DEPTH, BLOCK = 1 << 18, 2, 1 << 12
#: Entries of the tables of random variates; a shingle picks one from each of three tables.
VARIATES = 1 << 12
#: Texts of a salted block of a bucket, about; a tile has two blocks, of under a megabyte of samples.
TILE = 1024


def _buckets(h: np.ndarray, row: int) -> np.ndarray:
    return ((h >> np.uint64(20 * row)) & np.uint64(WIDTH - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The count-min sketch [DEPTH, WIDTH] of the number of documents with each shingle, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, texts in text_blocks(batch.column(0)):
                _, value, _ = shingles(texts, SHINGLE)
                for row in range(DEPTH):
                    sketch[row] += np.bincount(_buckets(value, row), minlength=WIDTH)
        if n:
            parts = sketch.reshape(-1, BLOCK)
            yield _sketch_rows([*range(len(parts)), -1], [*parts, np.array([n])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # as many as there are blocks, at most
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = np.frombuffer(data, np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield _sketch_rows(list(sums), list(sums.values()))

    kind = "block int, data binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, kind)
    for width in (16, 1):  # a tree of two levels: no block's parts all meet at once
        spread = F.pmod(F.spark_partition_id(), F.lit(width)).alias("turn")
        parts = parts.select("block", "data", spread).repartition("block", "turn").select("block", "data").mapInArrow(add, kind)
    sketch, n = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.int64), 0
    for r in parts.collect():  # of the size of the sketch, once more for each partition that holds part of a block
        if r["block"] < 0:
            n += int(np.frombuffer(r["data"], np.int64)[0])
        else:
            sketch[r["block"]] += np.frombuffer(r["data"], np.int64)
    return sketch.reshape(DEPTH, WIDTH), n


def _sketch_rows(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    data = [np.ascontiguousarray(p, np.int64).tobytes() for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


class Weights:
    """TF-IDF weights of shingles: (1 + ln tf) times a smooth idf between 1 (in all documents) and 2 (in one)."""

    def __init__(self, sketch: np.ndarray, n: int):
        noise = (sketch.sum(axis=1, keepdims=True) - sketch) / (WIDTH - 1)  # what other shingles add to a counter
        df = np.clip(sketch - noise, 1, max(1, n))
        idf = 1 + np.log((1 + n) / (1 + df)) / np.log(max(2.0, 1 + n))
        self.idf = np.round(idf * 32) / 32

    def of(self, value: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.maximum(self.idf[0][_buckets(value, 0)], self.idf[1][_buckets(value, 1)])
        return (1 + np.log(times)) * idf


_variates: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def variates(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, beta and ln c of improved consistent weighted sampling, the same in every process."""
    if k not in _variates:
        rng = np.random.Generator(np.random.PCG64(20111211))
        shape = (k, VARIATES)
        r, c = rng.gamma(2, 1, shape), rng.gamma(2, 1, shape)
        _variates[k] = r.astype(np.float32), rng.random(shape, np.float32), np.log(c).astype(np.float32)
    return _variates[k]


def samples(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """K samples of n texts as 32-bit names of (shingle, quantised weight); texts without shingles have zeros."""
    out = np.zeros((n, k), np.uint32)
    if not len(owner):
        return out
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    have = owner[first]
    r_, beta_, c_ = variates(k)
    low = np.uint64(VARIATES - 1)
    a, b, c = ((value >> np.uint64(s) & low).astype(np.int32) for s in (0, 12, 24))
    log_w = np.log(weight).astype(np.float32)
    name = (value >> np.uint64(32)).astype(np.uint32)
    for i in range(k):
        r, beta = r_[i][a], beta_[i][b]
        t = np.floor(log_w / r + beta)
        key = (c_[i][c] - r * (t - beta + np.float32(1))).view(np.int32)
        key = key ^ ((key >> 31) & np.int32(0x7FFFFFFF))  # in the order of the floats
        own = (name ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))).astype(np.uint64)
        both = (key.astype(np.int64) << np.int64(32)) | own.view(np.int64)
        out[have, i] = (np.minimum.reduceat(both, first) & np.int64(0xFFFFFFFF)).astype(np.uint32)
    return out


def sketched(docs: DataFrame, weights: Weights) -> DataFrame:
    """key, doc_id, same (a digest of the words in a row; null without words), bands, names (16 bits of each sample)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for some, own in text_blocks(batch.column(2)):
                owner, value, times = shingles(own, SHINGLE)
                got = samples(owner, value, known.of(value, times), len(own), BANDS * ROWS).astype(np.uint64)
                band = np.full((len(own), BANDS), 7, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + got[:, j::ROWS])
                words, counts = word_hashes(own)
                ends = np.cumsum(counts)
                same = [words[e - c : e].tobytes() if c else None for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(some)),
                        ids.take(pa.array(some)),
                        pa.array([None if s is None else _digest(s) for s in same], pa.binary()),
                        pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                        pa.array([row.tobytes() for row in mix(got).astype(np.uint16)], pa.binary()),
                    ],
                    names=["key", "doc_id", "same", "bands", "names"],
                )

    rows = docs.select(
        row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "key long, doc_id long, same binary, bands array<long>, names binary")


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=16).digest()


def bucketed(reps: DataFrame) -> DataFrame:
    """key, names, bands and `met`, for the texts that share a bucket: met is how many texts all its buckets hold."""
    each = reps.select("key", F.explode("bands").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = each.join(sizes, "bucket").groupBy("key").agg(F.sum("n").alias("met"))
    return stage(reps.select("key", "names", "bands").join(met, "key"), "bucketed")


def candidate_pairs(near: DataFrame) -> DataFrame:
    """a, b: each text of a bucket with the one of it that meets the most texts, and with the least key, once.

    Of a group of near copies, the text that the others are edits of shares the most buckets, so most pairs of a group
    are links at once."""
    bands = F.posexplode("bands").alias("j", "bucket")
    refined = F.xxhash64("bucket", F.element_at("bands", (F.col("j") + 1) % BANDS + 1))
    each = near.select("key", "met", "bands", bands).select("key", "met", F.explode(F.array("bucket", refined)).alias("bucket"))
    ends = each.groupBy("bucket").agg(
        F.max(F.struct("met", "key"))["key"].alias("hub"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    ends = ends.where("low < high").select("bucket", "hub", "low")
    met = each.join(ends, "bucket").select("key", F.explode(F.array("hub", "low")).alias("other"))
    return met.where(F.col("key") != F.col("other")).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that agree in AGREE of their samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in batch.columns[2:])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(
                pa.array((x == y).sum(axis=1) >= AGREE)
            )

    one = pairs.join(reps.select(F.col("key").alias("a"), F.col("names").alias("names_a")), "a")
    two = one.join(reps.select(F.col("key").alias("b"), F.col("names").alias("names_b")), "b")
    return two.select("a", "b", "names_a", "names_b").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of the documents with these row keys, once each.

    A bit map of fixed size leaves most other texts out before any shuffle; the join after it is exact. The texts are
    written, so that joins with them begin with a shuffle of their own and adaptive execution can split a hot key."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(keys, "key", 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    key = row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key")
    some = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = some.mapInArrow(run, "key long, text string")
    return stage(some.join(keys.hint("merge"), "key", "left_semi").dropDuplicates(["key"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs whose whole texts have the weighted Jaccard similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = shared.value, {}

        def profile(key: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in memo:
                if len(memo) > 64:
                    memo.clear()
                _, value, times = shingles([text], SHINGLE)
                memo[key] = value, known.of(value, times)
            return memo[key]

        for batch in batches:
            a, b, text_a, text_b = batch.columns
            keep = []
            for i in range(batch.num_rows):
                (va, wa), (vb, wb) = profile(b[i].as_py(), text_b[i].as_py()), profile(a[i].as_py(), text_a[i].as_py())
                _, x, y = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
                shared_ = np.minimum(wa[x], wb[y]).sum()
                keep.append(shared_ >= similarity * (wa.sum() + wb.sum() - shared_) - 1e-9)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the same plan at every size: both joins shuffle
    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    two = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def open_tiles(rooted: DataFrame) -> DataFrame:
    """tile, key, root, band, block, whole: the texts of the buckets that hold several roots, in tiles of two blocks.

    Any two texts of a bucket with different roots meet in one tile of it. The texts of the bucket's most frequent root
    have blocks of their own, which meet the blocks of the others only; whole: both blocks of the tile are the same."""
    c = F.col
    each = rooted.select("key", "root", F.posexplode("bands").alias("band", "bucket"))
    roots = each.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = roots.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    sizes = sizes.where("n > main.n").select(
        "bucket",
        c("main.root").alias("main"),
        F.ceil((c("n") - c("main.n")) / TILE).alias("others"),
        F.ceil(c("main.n") / TILE).alias("mains"),
    )
    turn, is_main = F.xxhash64("key", "bucket"), c("root") == c("main")
    block = F.when(is_main, c("others") + F.pmod(turn, "mains")).otherwise(F.pmod(turn, "others"))
    partners = F.sequence(F.lit(0).cast("long"), F.when(is_main, c("others")).otherwise(c("others") + c("mains")) - 1)
    met = each.join(sizes, "bucket").select("bucket", "key", "root", "band", block.alias("block"), F.explode(partners).alias("with"))
    tile = F.xxhash64("bucket", F.least("block", "with"), F.greatest("block", "with"))
    return met.select(tile.alias("tile"), "key", "root", "band", "block", (c("block") == c("with")).alias("whole"))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile from batches in the order of tiles."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        tile = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)
        rest = batch.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def tile_pairs(placed: DataFrame, reps: DataFrame) -> DataFrame:
    """tile, key, others: texts of tiles, with the keys they have to be verified with there (none for the other side).

    Those are of another root and agree in AGREE samples. A pair that shares several bands counts in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            tile, key, root, band, block, whole = (t.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            names = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
            bands = t.column(7).flatten().to_numpy().reshape(-1, BANDS)
            others: dict[int, list[int]] = {}
            for i in range(len(key) - 1):
                new = np.flatnonzero((root[i + 1 :] != root[i]) & ((block[i + 1 :] != block[i]) | whole[i])) + i + 1
                new = new[(names[new] == names[i]).sum(axis=1) >= AGREE]
                new = new[(bands[new] == bands[i]).argmax(axis=1) == band[i]]
                if len(new):
                    others.setdefault(i, []).extend(key[new].tolist())
                    for j in new.tolist():
                        others.setdefault(j, [])
            if others:
                rows = sorted(others)
                columns = [pa.array(tile[rows]), pa.array(key[rows]), pa.array([others[i] for i in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["tile", "key", "others"])

    both = placed.join(reps.select("key", "names", "bands"), "key")
    both = both.select("tile", "key", "root", "band", "block", "whole", "names", "bands")
    return both.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "tile long, key long, others array<long>")


def verified_tiles(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """a, b: the pairs of tiles whose whole texts have the weighted Jaccard similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(keys: list[int], own: list[str], wanted: list[list[int]]) -> Iterator[tuple[int, int]]:
        owner, value, times = shingles(own, SHINGLE)
        weight = shared.value.of(value, times)
        vocabulary, at = np.unique(value, return_inverse=True)
        ends = np.searchsorted(owner, np.arange(len(own) + 1))
        total = np.add.reduceat(weight, ends[:-1])
        mine = np.zeros(len(vocabulary))
        for i, some in enumerate(wanted):
            if not some:
                continue
            here = slice(ends[i], ends[i + 1])
            mine[at[here]] = weight[here]
            flat = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in some])
            starts = np.cumsum([0, *(ends[j + 1] - ends[j] for j in some[:-1])])
            both = np.add.reduceat(np.minimum(mine[at[flat]], weight[flat]), starts)
            for j in np.array(some)[both >= similarity * (total[i] + total[some] - both) - 1e-9].tolist():
                yield keys[i], keys[j]
            mine[at[here]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            keys, others, own = (t.column(i).to_pylist() for i in (1, 2, 3))
            parts = list(blocks(own, [len(x) for x in own]))
            found = []
            for x, first in enumerate(parts):  # one, unless texts are long
                for second in parts[x:]:
                    some = first if second is first else first + second
                    place = {keys[i]: n for n, i in enumerate(some)}
                    left = {keys[i] for i in first}
                    wanted = [
                        [place[k] for k in others[i] if k in place and (second is first or (k in left) != (keys[i] in left))]
                        for i in some
                    ]
                    if any(wanted):
                        found += compare([keys[i] for i in some], [own[i] for i in some], wanted)
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    both = pairs.join(texts.hint("merge"), "key").select("tile", "key", "others", "text")
    return both.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for all nodes of the edges (a, b).

    Large-star and small-star contraction: each round links every node's larger, then its smaller neighbours to the least
    one, until nothing changes. A node's neighbours are never gathered; only their minimum is."""

    def star(links: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        met = both.where("b > a") if larger else both
        new = met.join(least, "a").select(F.col("root").alias("a"), "b")
        if not larger:
            new = new.unionByName(least.select(F.col("root").alias("a"), F.col("a").alias("b")))
        return new.where("a != b").distinct()

    links, seen = stage(edges.where("a != b").select("a", "b").distinct(), "links"), None
    while True:
        links = stage(star(star(links, True), False), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state == seen:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen = state


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, kept (it is that document): a row for each row of docs.

    A class is a connected component of texts with the same words or a verified similarity. A null text counts as empty;
    a text without words is a class of its own, and so is a row with a null doc_id and no words. Texts of fewer than
    SHINGLE words have one shingle of all of them. Repeated rows are in one class and marked alike. A class of rows with
    null ids only has a null class_id. An empty table gives an empty result."""
    return keyed_classes(docs, similarity).drop("key")


def keyed_classes(docs: DataFrame, similarity: float) -> DataFrame:
    """The rows of `near_classes` with the row keys of the documents."""
    bound_batches(docs.sparkSession)
    weights = Weights(*document_frequencies(docs))
    rows = stage(sketched(docs, weights), "samples")
    named = rows.where(F.col("same").isNotNull())
    # texts with the same words: the one with the least key stands for all
    alike = named.groupBy("same").agg(F.min("key").alias("rep"))
    reps = named.join(alike, (named["key"] == alike["rep"]) & (named["same"] == alike["same"]), "left_semi").dropDuplicates(["key"])
    near = bucketed(reps)
    pairs = stage(likely(candidate_pairs(near), near), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    found = components(verified(pairs, texts_of(docs, ends), weights, similarity))
    rooted = near.select("key", "bands").join(found.withColumnRenamed("node", "key"), "key", "left")
    rooted = rooted.select("key", "bands", F.coalesce("root", "key").alias("root"))
    left = stage(tile_pairs(open_tiles(rooted), near), "tiles")
    links = verified_tiles(left, texts_of(docs, left.select("key").distinct()), weights, similarity)
    for end in ("a", "b"):
        root = found.select(F.col("node").alias(end), F.col("root").alias("root_"))
        links = links.join(root, end, "left").withColumn(end, F.coalesce("root_", end)).drop("root_")
    joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("last"))
    first = alike.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("root"))
    roots = first.join(joined, "root", "left").select("same", F.coalesce("last", "root").alias("root"))
    # from classes to documents over the texts' digests: each digest's documents are counted before classes are
    each = named.groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, "same")
    sizes = each.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = each.select("same", "root").join(sizes, "root").select("same", "class_id", "class_size")
    classed = named.select("key", "doc_id", "same").join(by_text, "same").select("key", "doc_id", "class_id", "class_size")
    alone = rows.where(F.col("same").isNull()).select(
        "key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return classed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs but one document of each class, with the columns of docs. Of repeated rows one stays.

    Rows go by id and text together: a row stays though another one with its id goes. Of a class of rows with null ids
    only, each text stays once."""
    key = next(name for name in (f"_key{i}_" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    rows = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    gone = keyed_classes(docs, similarity).where("NOT kept").select(F.col("key").alias("_gone_")).distinct()
    gone = stage(gone, "near-copies")
    left = rows.join(gone, rows[key] == gone["_gone_"], "left_anti")
    # the join has brought the rows of a key together already
    turn = F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(key))
    return left.select("*", turn.alias(f"{key}turn")).where(F.col(f"{key}turn") == 1).select(*docs.columns)
