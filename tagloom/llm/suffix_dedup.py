"""Suffix-array de-duplication over bytes with a hash-compared suffix sort.

Two suffixes are compared by the length they share, found by binary search over prefix polynomial hashes: a logarithmic
number of steps whatever the lengths. A merge sort of all groups of a batch at once uses this comparison, and the bytes
that neighbours share are compared afterwards, so that a collision of hashes can't decide anything.

`repeats` brings together the segments with a common anchor. Equal windows have the anchor at the same place, so a
window with j bytes before the anchor is known by its j bytes to the left and its width - j bytes to the right: by its
place among the suffixes from the anchor on and among the reversed prefixes. Both orders and the lengths that neighbours
share give the classes of equal windows for every j, and for windows of several widths: those that are removed, and
shorter ones that only mark passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import prefix_hashes, span_hash
from tagloom.llm.repeats import Kind, rows_with_runs
from tagloom.llm.substring_dedup import covered

WIDTH = 400
#: Bytes of a passage of 50 words, at six a word; passages are marked, not removed.
PASSAGE = 300
GRAM = 48


def byte_symbols(texts: list[bytes]):
    whole = b"".join(texts)
    return np.frombuffer(whole, np.uint8), np.array([len(t) for t in texts], np.int64), lambda a, b: whole[a:b]


class Suffixes:
    """Suffixes (start, length) of one buffer, compared by prefix hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buf, self.start, self.length = buf, start, length
        self.hashes = prefix_hashes(buf.astype(np.uint64) + np.uint64(1))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes a and b, by binary search."""
        x, y = self.start[a], self.start[b]
        high = np.minimum(self.length[a], self.length[b])
        low = np.zeros(len(a), np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = span_hash(self.hashes, x, x + middle) == span_hash(self.hashes, y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes strictly before b."""
        n = self.shared(a, b)
        ended_a, ended_b = n == self.length[a], n == self.length[b]
        last = len(self.buf) - 1
        less = self.buf[np.minimum(self.start[a] + n, last)] < self.buf[np.minimum(self.start[b] + n, last)]
        return np.where(ended_a, ~ended_b, ~ended_b & less)

    def sort(self, sizes: np.ndarray) -> np.ndarray:
        """Merge sort inside groups of consecutive suffixes, all groups at once: the sorted order."""
        order = np.arange(len(self.start))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            place = np.arange(len(order)) - first
            run = place // width
            other = (run ^ 1) * width
            at = np.flatnonzero(other < size)
            low, high = other[at].copy(), np.minimum(other[at] + width, size[at])
            left = run[at] % 2 == 0
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                mine, theirs = order[at[open_]], order[first[at[open_]] + middle]
                # equal suffixes of the left run come first
                up = np.where(left[open_], True, False)
                step = np.empty(len(open_), bool)
                step[up] = self.before(theirs[up], mine[up])
                step[~up] = ~self.before(mine[~up], theirs[~up])
                low[open_] = np.where(step, middle + 1, low[open_])
                high[open_] = np.where(step, high[open_], middle)
            target = np.arange(len(order))
            target[at] = first[at] + (run[at] & ~1) * width + (place[at] - run[at] * width) + (low - other[at])
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared length of each suffix in order with the one before it in its group (0 for the first), and whether all
        bytes agree with it: the shared bytes are equal and the next ones in order."""
        shared = np.zeros(len(order), np.int64)
        head = np.zeros(len(order), bool)
        head[np.cumsum(sizes) - sizes] = True
        at = np.flatnonzero(~head)
        a, b = order[at - 1], order[at]
        n = self.shared(a, b)
        shared[at] = n
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = self.buf[np.repeat(self.start[a], n) + offset] == self.buf[np.repeat(self.start[b], n) + offset]
        wrong = np.bincount(np.repeat(np.arange(len(at)), n)[~equal], minlength=len(at)) > 0
        last = len(self.buf) - 1
        ended = n == self.length[a]
        x, y = self.buf[np.minimum(self.start[a] + n, last)], self.buf[np.minimum(self.start[b] + n, last)]
        wrong |= ~ended & ((n == self.length[b]) | (x >= y))
        good = np.ones(len(order), bool)
        good[at[wrong]] = False
        return shared, good


def plain_order(strings: list[list[int]]) -> tuple[list[int], list[int]]:
    """Order and shared lengths by comparing symbols; where hashes collided."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        x, y = strings[a], strings[b]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        shared.append(n)
    return order, shared


def suffix_orders(buf: np.ndarray, at: np.ndarray, length: np.ndarray, sizes: np.ndarray):
    """For each group of strings laid end to end: its slice, the order of the strings from the anchor on with the lengths
    that neighbours share, and the same of their reversed beginnings."""
    start = np.cumsum(length) - length
    anchor, sides = start + at, []
    for suffixes in (Suffixes(buf, anchor, length - at), Suffixes(buf[::-1].copy(), len(buf) - anchor, at)):
        order = suffixes.sort(sizes)
        sides.append((order, *suffixes.neighbours(order, sizes)))
    (right, right_shared, right_good), (left, left_shared, left_good) = sides
    first = 0
    for c in sizes.tolist():
        own = slice(first, first + c)
        r, rs, le, ls = right[own] - first, right_shared[own], left[own] - first, left_shared[own]
        if not (right_good[own].all() and left_good[own].all()):  # hashes collided
            places = list(zip(start[own].tolist(), anchor[own].tolist(), (start + length)[own].tolist(), strict=True))
            r, rs = map(np.array, plain_order([buf[a:e].tolist() for _, a, e in places]))
            le, ls = map(np.array, plain_order([buf[b:a][::-1].tolist() for b, a, _ in places]))
        yield own, (r, rs, le, ls)
        first += c


def classes(width: int, at, n, several, right, right_shared, left, left_shared) -> list[list[tuple[int, int]]]:
    """The repeated windows of the segments of one group, from both orders and shared lengths. `several` says of segments
    and their classes which are of a class that is repeated."""
    c = len(at)
    low, high = at - n + 1, at  # bytes before the anchor, least and most, of each segment's windows
    points = np.unique(np.concatenate([width - right_shared[1:], left_shared[1:] + 1, low, high + 1]))
    points = points[(points >= low.min()) & (points <= high.max() + 1)]
    runs: list[list[tuple[int, int]]] = [[] for _ in range(c)]
    by_right, by_left = np.empty(c, np.int64), np.empty(c, np.int64)
    for p, q in zip(points[:-1].tolist(), points[1:].tolist(), strict=True):
        there = np.flatnonzero((low <= p) & (p <= high))
        if not len(there):
            continue
        by_right[right] = np.cumsum(right_shared < width - p)
        by_left[left] = np.cumsum(left_shared < p)
        _, same = np.unique(by_right[there] * (c + 1) + by_left[there], return_inverse=True)
        for s in there[several(there, same)].tolist():
            a, b = int(at[s]) - q + 1, int(at[s]) - p + 1
            if runs[s] and runs[s][-1][0] == b:
                runs[s][-1] = (a, runs[s][-1][1])
            else:
                runs[s].append((a, b))
    return runs


def sort_suffixes(widths: list[int]):
    """A judge that finds repeated windows of each width by one suffix sort."""

    def judge(groups):
        answers: list = [None] * len(groups)
        several = []
        for g, (segments, counts) in enumerate(groups):
            if len(segments) > 1:
                several.append(g)
            else:
                _, n, string = segments[0]
                ends = [(min(n, len(string) - w + 1), w) for w in widths]
                answers[g] = [[(0, end, w) for end, w in ends if end > 0] if counts[0] > 1 else []]
        if not several:
            return answers
        strings = [s for g in several for _, _, s in groups[g][0]]
        at = np.array([a for g in several for a, _, _ in groups[g][0]], np.int64)
        windows = np.array([n for g in several for _, n, _ in groups[g][0]], np.int64)
        counts = np.array([n for g in several for n in groups[g][1]], np.int64)
        sizes = np.array([len(groups[g][0]) for g in several], np.int64)
        length = np.array([len(s) for s in strings], np.int64)
        buf = np.frombuffer(b"".join(strings), np.uint8)
        for g, (own, sides) in zip(several, suffix_orders(buf, at, length, sizes), strict=True):
            (_, right_shared, _, left_shared), c, count = sides, len(groups[g][0]), counts[own]
            answers[g] = [[] for _ in range(c)]
            for w in widths:
                n = np.minimum(windows[own], length[own] - w + 1)
                if c == 2 and count.max() == 1:
                    # the bytes before the anchor of the windows that both have and that agree
                    high = min(int(left_shared[1]), int(at[own].min()))
                    low = max(w - int(right_shared[1]), int((at[own] - n).max()) + 1)
                    found = [[(a - high, a - low + 1)] if low <= high else [] for a in at[own].tolist()]
                elif (n > 0).any():
                    found = classes(w, at[own], n, lambda t, same, k=count: np.bincount(same, weights=k[t])[same] > 1, *sides)
                else:
                    continue
                for all_, runs in zip(answers[g], found, strict=True):
                    all_ += [(a, b, w) for a, b in runs]
        return answers

    return judge


def drop_repeated_bytes(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, passage: int = PASSAGE, with_bytes: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage (and the kept bytes, with_bytes), a row for each row.

    Texts are UTF-8 bytes. Each byte goes that is covered by a string of `width` bytes which also starts anywhere else,
    in the same document or in a repeated row too; no string crosses documents. n_passage is the number of bytes that such
    strings of `passage` bytes (no longer than `width`) cover: repeated passages that may be too short to go. A null text counts as empty: no bytes and
    the digest of none. An empty table gives an empty result; other columns play no part."""
    kind = Kind(passage, gram, byte_symbols, longest=width)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"
    out += ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                if runs.is_valid:
                    gone = covered(len(data), runs.as_py(), width)
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept, removed = data[~gone].tobytes(), int(gone.sum())
                    marked = int(covered(len(data), runs.as_py(), passage).sum())
                else:
                    kept, removed, spans, marked = data.tobytes(), 0, 0, 0
                row = (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), marked)
                rows.append((*row, kept) if with_bytes else row)
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names) - 1]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return rows_with_runs(docs, kind, sort_suffixes(sorted({width, passage}))).mapInArrow(run, out)
