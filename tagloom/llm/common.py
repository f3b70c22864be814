"""Helpers that the corpus operators share: shared-folder tables, text batching, bounded bit filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; a little under a power of two, as tables of powers are.
BLOCK_BYTES = 1_000_000
#: Bytes of rows that go to a Python worker at once, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local session
    gets a temporary folder of its own; on a cluster it has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. All of an application lie in one folder, to be removed once it has ended."""
    return f"{shared_dir(spark)}/tagloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches for Python workers in bytes, as texts may be long, where the session has no bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only. Texts of ASCII characters take the faster built-in, which is the same for them."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def row_key(id_col: Column, text: Column) -> Column:
    """A key of a row for joins: repeated rows share it, rows with equal ids and different texts don't."""
    return F.xxhash64(id_col, text)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a multiply and xor-shift finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """S with S[i] the sum of values[j] * base**j for j < i, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), equal for equal runs wherever they lie."""
    _, down = powers(len(s))
    return (s[end] - s[start]) * down[start]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values."""
    s = prefix_hashes(values)
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(s))
    return mix((s[width:] - s[:n]) * down[:n])


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    word = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def blocks(items: list, sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[list[int]]:
    """Indexes of items in runs of about `limit` bytes; a larger item is alone."""
    run, total = [], 0
    for i, n in enumerate(sizes):
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(i)
        total += n
    if run:
        yield run


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Indexes and texts of a batch's column in runs of about `limit` bytes, null as empty: only one run at a time is
    held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for some in blocks(sizes, sizes, limit):
        yield some, [t or "" for t in column.slice(some[0], len(some)).to_pylist()]


def bit_filter(hashes: DataFrame, col: str, log2_bits: int = 23) -> np.ndarray:
    """A bitmap of fixed size (1 MB at 23) with two bits for each value of the column.

    Only this map goes to the driver, however many values there are; it is a pre-filter and exact joins follow it."""
    mask = (1 << log2_bits) - 1
    probes = F.explode(F.array(F.col(col).bitwiseAND(mask), F.shiftrightunsigned(col, 32).bitwiseAND(mask)))
    found = (
        hashes.where(F.col(col).isNotNull())
        .select(probes.alias("b"))
        .select(F.shiftrightunsigned("b", 6).alias("w"), F.expr("shiftleft(1L, int(b & 63))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
    )
    bits = np.zeros(1 << (log2_bits - 6), np.int64)
    got = found.toPandas()
    bits[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return bits.view(np.uint64)


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 64 - 1)
    hit = np.ones(len(h), bool)
    for b in (h & mask, (h >> np.uint64(32)) & mask):
        hit &= (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return hit
