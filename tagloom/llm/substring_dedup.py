"""Substring de-duplication over words by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string of words to the minimiser's bucket, where sorting
the windows counts them exactly (see `repeats` for the partitioning, which also splits hot minimisers)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import mix, prefix_hashes, span_hash, words_of
from tagloom.llm.repeats import Kind, rows_with_runs

WIDTH = 35
GRAM = 8


def word_symbols(texts: list[bytes]):
    """Words of texts as hashes. The strings have one space between words, whatever white space was there."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = words_of(buf)
    hashes = mix(span_hash(prefix_hashes(buf.astype(np.uint64) + np.uint64(1)), starts, ends))
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    keep = np.zeros(len(buf), bool)
    edges = np.zeros(len(buf) + 1, np.int8)
    edges[starts] = 1
    edges[ends + 1] = edges[ends + 1] - 1  # the byte after a word is kept as its space
    keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
    plain = buf.copy()
    plain[ends] = 0x20
    packed = plain[keep].tobytes()
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    head, tail = at.tolist(), (at + sizes).tolist()
    return hashes, counts, lambda a, b: packed[head[a] : tail[b - 1]]


def count_windows(width: int):
    """A judge that sorts the windows of a bucket's distinct strings and counts equal neighbours."""

    def judge(groups):
        answers = []
        for strings, counts in groups:
            if len(strings) == 1:
                answers.append([[(0, strings[0][1], width)] if counts[0] > 1 else []])
                continue
            windows = []
            for k, (_, _, packed) in enumerate(strings):
                words = packed.split(b" ")
                at, head, tail = 0, [], []
                for word in words:
                    head.append(at)
                    at += len(word) + 1
                    tail.append(at - 1)
                windows += [(packed[head[i] : tail[i + width - 1]], k, i) for i in range(len(words) - width + 1)]
            windows.sort()
            repeated: list[list[int]] = [[] for _ in strings]
            i = 0
            while i < len(windows):
                j, n = i, 0
                while j < len(windows) and windows[j][0] == windows[i][0]:
                    n += counts[windows[j][1]]
                    j += 1
                if n > 1:
                    for _, k, place in windows[i:j]:
                        repeated[k].append(place)
                i = j
            answers.append([[(a, b, width) for a, b in runs_of(sorted(places))] for places in repeated])
        return answers

    return judge


def runs_of(places: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for p in places:
        if runs and runs[-1][1] == p:
            runs[-1] = (runs[-1][0], p + 1)
        else:
            runs.append((p, p + 1))
    return runs


def covered(n: int, runs: list[dict] | None, width: int) -> np.ndarray:
    """Which of n symbols lie in a window of the runs of this width."""
    edges = np.zeros(n + 1, np.int64)
    for run in runs or ():
        if run["width"] == width:
            edges[run["first"]] += 1
            edges[run["last"] + width - 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def drop_repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, with_text), a row for each row of docs.

    Words are runs without ASCII white space. Each word goes that is covered by a window of `width` words which also
    starts anywhere else, in the same document or in a repeated row too. A null or empty text has no words and the
    digest of an empty string; a text shorter than a window keeps all. An empty table gives an empty result."""
    kind = Kind(width, gram, word_symbols)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = text.as_py().split()
                gone = covered(len(words), runs.as_py(), width)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                row = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode()) if with_text else row)
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names) - 1]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return rows_with_runs(docs, kind, count_windows(width)).mapInArrow(run, out)
