"""Byte-level BPE by a tree reduction: halves are encoded and joined by re-encoding windows at their boundary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches

#: Entries of each memo of a worker; a full memo is emptied.
MEMO = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBpe:
    """Encodes a piece as the merges by rank would.

    A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay apart when encoded alone.
    So two encoded halves may be joined by encoding anew a window at the boundary, and by widening it until its first
    and last token stay apart from the tokens beside it; what lies outside can't change any more."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The definition: the lowest rank of two neighbours is merged first. For windows of a few tokens."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two neighbours: the pair itself if they stay apart."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        a, b = left[-1], right[0]
        window = self.pair(a, b)
        if window == (a, b):
            return left + right
        i = j = 1
        while True:
            wider_left = i < len(left) and self.pair(left[-i - 1], window[0]) != (left[-i - 1], window[0])
            wider_right = j < len(right) and self.pair(window[-1], right[j]) != (window[-1], right[j])
            if not wider_left and not wider_right:
                return left[:-i] + window + right[j:]
            i, j = min(len(left), 2 * i if wider_left else i), min(len(right), 2 * j if wider_right else j)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))

    def half(self, data: bytes) -> tuple[int, ...]:
        tokens = self.known.get(data)
        if tokens is None:
            tokens = self.encode_bytes(data)
            if len(data) <= 16:
                if len(self.known) > MEMO:
                    self.known.clear()
                self.known[data] = tokens
        return tokens

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(data)
        if rank is not None:
            return (rank,)
        if not data:
            return ()
        middle = len(data) // 2
        return self.join(self.half(data[:middle]), self.half(data[middle:]))

    def forget(self) -> None:
        """Empties the memos: an idle worker keeps no memory that later stages in the same process need."""
        self.known.clear()
        self.pairs.clear()
        self.pieces.clear()

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up the tree, halves of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_coders: dict[tuple[str, str], tuple[TreeBpe, regex.Pattern]] = {}
#: A space between two white-space characters (or before the end) belongs to a longer piece; elsewhere a text may be
#: cut before each space without any piece being cut.
_INNER = regex.compile(r"\s (?=\s|\Z)")


def coder(ranks_path: str, pattern: str) -> tuple[TreeBpe, regex.Pattern]:
    """The coder of this worker process; its tables are built once and kept for later tasks."""
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = TreeBpe(read_ranks(ranks_path)), regex.compile(pattern)
    return _coders[ranks_path, pattern]


def encode(text: str, tree: TreeBpe, pieces: regex.Pattern) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    parts = [text] if "\0" in text or _INNER.search(text) else text.replace(" ", "\0 ").split("\0")
    memo, out = tree.pieces, []
    for part in parts:
        ids = memo.get(part)
        if ids is None:
            tokens: list[int] = []
            for piece in pieces.findall(part):
                tokens += tree.encode_bytes(piece.encode())
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
            if len(part) <= 64:
                if len(memo) > MEMO:
                    memo.clear()
                memo[part] = ids
        out.append(ids)
    return b"".join(out)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids as binary, with_ids), a row for each row of docs.

    A null text counts as empty: no ids, and the digests of no bytes. Rows are independent: repeated rows give repeated
    results, an empty table none; further columns of docs play no part."""
    bound_batches(docs.sparkSession)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, pieces = coder(ranks_path, pattern)
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", tree, pieces)
                tokens = np.frombuffer(ids, "<u4").tolist()
                row = [len(tokens), hashlib.sha256(ids).hexdigest(), hashlib.sha256(tree.decode(tokens)).hexdigest()]
                rows.append((*row, ids) if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
            )
        tree.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)
