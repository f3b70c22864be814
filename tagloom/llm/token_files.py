"""Token ids in a binary file format: id blocks as byte planes, each compressed with zstandard, and a chunk index.

A container (one row of the written table) holds whole documents in ascending doc_id order:

    "PLN1" | n_docs, n_null, n_ids, n_blocks: u32 each | doc_id: i64 x n_docs | n_tokens: u64 x n_docs
    | chunk index: for each block its offset u64, ids u32 and plane lengths u32 x 4 | planes

The first n_null documents have no id (0 is written for them). A block is BLOCK_IDS ids (the last may be shorter), transposed into four byte planes, most significant last. The table is
partitioned by nothing and sorted; `shard` and `seq` give the order of containers."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import SPACE, blocks, bound_batches, mix

BLOCK_IDS = 1 << 16
#: Ids after which a container is closed; a longer document has one of its own.
CONTAINER_IDS = 1 << 20
#: Bytes of text in a range of doc_id, about, at most.
RANGE_BYTES = 256 << 20
MAGIC = b"PLN1"
_HEAD, _INDEX = struct.Struct("<4s4I"), np.dtype([("offset", "<u8"), ("ids", "<u4"), ("planes", "<u4", 4)])


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A container of the documents' ids, one after the other; documents without an id come first."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    index = np.zeros(-(-len(ids) // BLOCK_IDS), _INDEX)
    planes, offset = [], 0
    for k in range(len(index)):
        block = np.ascontiguousarray(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS], "<u4")
        rows = np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T)
        packed = [squeeze(row.tobytes()) for row in rows]
        index[k] = (offset, len(block), tuple(map(len, packed)))
        planes += packed
        offset += sum(map(len, packed))
    head = _HEAD.pack(MAGIC, len(doc_ids), doc_ids.count(None), len(ids), len(index))
    return b"".join(
        [head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array(counts, "<u8").tobytes(), index.tobytes(), *planes]
    )


def unpack(data: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """doc_ids, how many of the first are null, counts and ids of a container."""
    magic, n_docs, n_null, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a container of token ids")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    index = np.frombuffer(data, _INDEX, n_blocks, at)
    at += index.nbytes
    ids, done, expand = np.zeros(n_ids, "<u4"), 0, zstandard.ZstdDecompressor().decompress
    for entry in index:
        rows, start = np.zeros((4, entry["ids"]), np.uint8), at + int(entry["offset"])
        for k, length in enumerate(entry["planes"].tolist()):
            rows[k] = np.frombuffer(expand(data[start : start + length], max_output_size=int(entry["ids"])), np.uint8)
            start += length
        ids[done : done + entry["ids"]] = np.ascontiguousarray(rows.T).view("<u4").ravel()
        done += int(entry["ids"])
    return doc_ids, n_null, counts, ids


#: Words whose ids a worker remembers (about 100 MB); a full memo is emptied.
MEMO = 1_500_000
#: Bytes of text whose words are looked up at once.
LOOKUP_BYTES = 2_000_000
#: Bytes of a word that two 64-bit numbers hold; longer words are looked up one by one.
PACKED = 16
_encoders: dict[str, WordEncoder] = {}


def separator(tokenizer) -> tuple[str, int] | None:
    """A special token of the tokenizer that may stand between words: it is cut out first and merges with nothing."""
    for i, token in tokenizer.get_added_tokens_decoder().items():
        if token.special and not (token.lstrip or token.rstrip or token.single_word):
            return token.content, i
    return None


def encode_words(tokenizer, mark: tuple[str, int] | None, words: list[bytes]) -> list[bytes]:
    """The ids of each word, by one call for all words with a special token between them."""
    if mark is None or any(mark[0].encode() in w for w in words):
        found = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]
    joined = mark[0].join(b"\n".join(words).decode("utf-8", "replace").split("\n"))
    ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
    data, cuts = ids.tobytes(), (np.flatnonzero(ids == mark[1]) * 4).tolist()
    return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]


class Texts:
    """The words of an Arrow column of texts without nulls: runs of bytes without ASCII white space."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
        buf = np.frombuffer(self.data, np.uint8)
        edges = offsets - offsets[0]
        word = ~SPACE[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = edges[(edges > 0) & (edges < len(buf))]  # a word ends where its text ends
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        self.start, self.size = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.size -= self.start
        #: words of all texts before each text, and of all
        self.before = np.searchsorted(self.start, edges)
        self.padded = np.concatenate([buf, np.zeros(PACKED, np.uint8)])

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The first 8 bytes of each word and the next 8, as numbers; 0 stands for bytes after its end."""
        at8 = np.lib.stride_tricks.as_strided(self.padded, (len(self.padded) - 7, 8), (1, 1))
        left = np.minimum(self.size, 8)
        right = np.clip(self.size - 8, 0, 8)
        low = at8[self.start].view("<u8").ravel() & _LEAST[left]
        high = at8[self.start + left].view("<u8").ravel() & _LEAST[right]
        return low, high

    def word(self, i: int) -> bytes:
        at = int(self.start[i])
        return bytes(self.data[at : at + int(self.size[i])])


#: Masks of the first k bytes of a number.
_LEAST = np.array([(1 << (8 * k)) - 1 for k in range(9)], "<u8")


class Memo:
    """Short words, as (first 8 bytes, next 8, size), and where their ids lie in a pool: a hash table in arrays."""

    def __init__(self, entries: int):
        self.slots = np.zeros(1 << (2 * entries).bit_length(), np.int32)  # number of the entry, 0 where free
        self.words = np.zeros((entries + 1, 3), np.uint64)
        self.place = np.zeros((entries + 1, 2), np.int64)  # start and number of ids in the pool
        self.pool = np.zeros(1 << 16, np.uint32)
        self.n = self.used = 0

    def find(self, words: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The entry of each word, 0 for a new one."""
        mask = np.uint64(len(self.slots) - 1)
        at, found, open_ = (name & mask).astype(np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        while len(open_):
            entry = self.slots[at[open_]]
            same = (entry > 0) & (self.words[entry] == words[open_]).all(axis=1)
            found[open_[same]] = entry[same]
            open_ = open_[(entry > 0) & ~same]
            at[open_] = (at[open_] + 1) & int(mask)
        return found

    def add(self, words: np.ndarray, name: np.ndarray, ids: list[bytes]) -> None:
        """Distinct new words and their ids."""
        some = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(some) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(some)] = some
        own = np.arange(self.n + 1, self.n + 1 + len(words))
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        self.words[own], self.place[own] = words, np.stack([self.used + np.cumsum(sizes) - sizes, sizes], axis=1)
        self.n, self.used = self.n + len(words), self.used + len(some)
        mask = np.uint64(len(self.slots) - 1)
        at, open_ = (name & mask).astype(np.int64), np.arange(len(words))
        while len(open_):
            free = open_[self.slots[at[open_]] == 0]
            self.slots[at[free]] = own[free]  # of several for a slot the last gets it
            open_ = open_[self.slots[at[open_]] != own[open_]]
            at[open_] = (at[open_] + 1) & int(mask)


class WordEncoder:
    """Encodes texts by the tokenizers library, each distinct word once.

    The tokenizer drops white space and never merges across it, so the ids of a text are its words' ids in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = separator(self.tokenizer)
        self.memo = Memo(MEMO)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        found = []
        for at in range(0, len(words), 256):
            found += encode_words(self.tokenizer, self.mark, words[at : at + 256])
        return found

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id after it, and their number for each text."""
        texts = Texts(column)
        low, high = texts.packed()
        size = texts.size.astype(np.uint64)
        name = mix(low ^ mix(high ^ mix(size)))
        _, first, kind = np.unique(name, return_index=True, return_inverse=True)
        # equal numbers and sizes are equal words, if short; the others are told apart by their bytes
        alike = (texts.size <= PACKED) & (low == low[first[kind]]) & (high == high[first[kind]]) & (size == size[first[kind]])
        short = alike[first]
        first, kind = first[short], (np.cumsum(short) - 1)[kind]
        name = name[first]
        words = np.stack([low[first], high[first], size[first]], axis=1)
        memo = self.memo
        entry = memo.find(words, name)
        if memo.n + (entry == 0).sum() > MEMO:
            self.memo = memo = Memo(max(MEMO, len(words)))
            entry = memo.find(words, name)
        new = np.flatnonzero(entry == 0)
        memo.add(words[new], name[new], self.ids_of([texts.word(i) for i in first[new].tolist()]))
        entry[new] = np.arange(memo.n - len(new) + 1, memo.n + 1)
        rest: dict[bytes, int] = {}
        for i in np.flatnonzero(~alike).tolist():
            kind[i] = len(first) + rest.setdefault(texts.word(i), len(rest))
        others = self.ids_of(list(rest))
        own = np.frombuffer(b"".join(others) + struct.pack("<I", end_id), "<u4")
        sizes = np.array([len(x) // 4 for x in others] + [1], np.int64)
        start = np.concatenate([memo.place[entry, 0], memo.used + np.cumsum(sizes) - sizes])
        sizes = np.concatenate([memo.place[entry, 1], sizes])
        pool = np.concatenate([memo.pool[: memo.used], own])
        order = np.insert(kind, texts.before[1:], len(sizes) - 1)  # the end follows each text's words
        sizes = sizes[order]
        ends = np.cumsum(sizes)
        where = np.repeat(start[order] - (ends - sizes), sizes)
        last = ends[texts.before[1:] + np.arange(len(column))]
        return pool[where + np.arange(len(where))], np.diff(last, prepend=0)


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, kept for later tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, partitions: int | None = None) -> None:
    """Encodes every whole text (null: empty), appends end_id to each and writes the containers at `path`.

    Documents are dealt out by ranges of doc_id and sorted inside, so containers are in ascending doc_id order, null ids
    first and read back as null. Repeated rows are written each, an empty table gives no container, other columns play no
    part. There are as many ranges as shuffle partitions, more where a range would hold over RANGE_BYTES of text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        doc_ids, counts, parts, total, seq, shard = [], [], [], 0, 0, 0
        fields = ["shard", "seq", "n_ids", "data"]

        def close() -> pa.RecordBatch:
            row = [shard, seq, total, pack(doc_ids, counts, np.concatenate(parts))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=fields)

        for batch in batches:
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for some in blocks(sizes, sizes, LOOKUP_BYTES):
                own = batch.slice(some[0], len(some))
                ids, n = words.encode(own.column(1), end_id)
                doc_ids += own.column(0).to_pylist()
                counts += n.tolist()
                parts.append(ids)
                total += len(ids)
                if total >= CONTAINER_IDS:
                    yield close()
                    doc_ids, counts, parts, total, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange(partitions, "doc_id")
        .sortWithinPartitions("doc_id")
        .withColumn("shard", F.spark_partition_id())
    )
    containers = dealt.mapInArrow(run, "shard int, seq int, n_ids long, data binary")
    containers.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as u32 bytes, with_ids) of each document in the containers.

    `start` counts the ids of all documents before it, in the order of the containers; documents without an id have a
    null doc_id and come first. Without containers (of an empty table) there are no rows."""
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, n_null, counts, ids = unpack(data.as_py())
                ends = np.cumsum(counts)
                own = [ids[e - c : e].tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                columns = [base + ends - counts, counts, np.array([zlib.crc32(x) for x in own], np.int64)]
                arrays = [pa.array(doc_ids, pa.int64(), mask=np.arange(len(doc_ids)) < n_null)]
                arrays += [pa.array(c, pa.int64()) for c in columns] + [pa.array(own, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    files = spark.read.parquet(path)
    # a number for each shard, not for each document, goes through the driver
    shards = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    bases, total = [], 0
    for shard, n in sorted(shards.items()):
        bases.append((shard, total))
        total += n
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seqs = files.select("shard", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inside"))
    starts = seqs.join(F.broadcast(spark.createDataFrame(bases, "shard int, base long")), "shard")
    starts = starts.select("shard", "seq", (F.col("base") + F.col("inside")).alias("start"))
    return files.join(starts, ["shard", "seq"]).select("start", "data").mapInArrow(run, out)
