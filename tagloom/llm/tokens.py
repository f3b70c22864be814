"""Words of many texts at once, as hashes: lower case, runs of letters and digits (any byte of a non-ASCII character
counts as a letter)."""

from __future__ import annotations

import numpy as np

from tagloom.llm.common import mix, prefix_hashes, rolling, span_hash

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    word = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes = mix(span_hash(prefix_hashes(buf.astype(np.uint64) + np.uint64(1)), starts, ends))
    limits = np.cumsum([len(d) + 1 for d in data])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, times it occurs in the text), sorted. A text with fewer words has one shingle of all."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    grams = rolling(words, size)
    text = np.repeat(np.arange(len(texts)), counts)
    whole = ends[text[: len(grams)]] - np.arange(len(grams)) >= size
    owner, value = text[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = span_hash(prefix_hashes(words), ends[short] - counts[short], ends[short])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(sums ^ np.uint64(1))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(owner)))
