"""Spelling variant grouping by frequency-vector tries.

Words within one edit agree in a half: the edit lies in the first or the second half of the shorter word. So a word goes
to the tries of its halves, and each half has a trie of its own. A trie arranges its words by how many letters of each
letter group they hold, one level for each group. A depth-first search (of many words at once, level by level of their
paths) walks down with a surplus and a deficit of one each, as an edit adds one letter, drops one or does both; a node
with one word ends a path early. The words at the leaves are verified. Halves with many words are split by the first
levels of their tries, and words also visit the nodes that their budget allows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches, stage, text_blocks

LEAST_LENGTH, LEAST_TIMES, FORM_RATIO = 7, 2, 10
#: One in DROP_IN runs of a document loses a code point.
DROP_IN = 31
#: Letter groups (code point modulo GROUPS), each a level of a trie, and bits of a count; larger counts are cut off,
#: which keeps counts of words within one edit within one of each other.
GROUPS, BITS = 12, 5
#: Words of a half beyond which it is split by the first SPLIT levels.
LIMIT, SPLIT = 20_000, 4
#: Words of a task that are searched at once, and pairs that are verified at once.
BLOCK, PAIRS = 60_000, 100_000
#: Words beyond this length are compared one by one.
WIDTH = 40

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LONG, _TAIL, _VISITS = 1, 2, 4


def word_counts(docs: DataFrame, length: int = LEAST_LENGTH, times: int = LEAST_TIMES, drop_in: int = DROP_IN) -> DataFrame:
    """word, n: distinct words of at least `length` code points and `times` occurrences in all texts.

    A run of letters loses a code point where drop_in divides the CRC-32 of its document and itself. Counts are summed
    in each block of texts before they are shuffled. A null text has no words; a null doc_id counts as empty."""
    bound_batches(docs.sparkSession)
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return out

        for b in batches:
            ids = b.column(0).to_pylist()
            for some, texts in text_blocks(b.column(1)):
                for i, text in zip(some, texts, strict=True):
                    lower = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
                    start = zlib.crc32(b"" if ids[i] is None else str(ids[i]).encode())
                    start = zlib.crc32(b":", start)
                    for word, n in Counter(pattern.findall(lower)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < length:
                                continue
                        counts[word] += n
                if len(counts) > 200_000:
                    yield batch()
        yield batch()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the length of each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


def vectors(words: list[str]) -> np.ndarray:
    """How many letters of each group a word holds, the first group in the highest bits."""
    points, lengths = _points(words)
    cells = np.repeat(np.arange(len(words)) * GROUPS, lengths) + points % GROUPS
    counts = np.bincount(cells, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    packed = np.zeros(len(words), np.int64)
    for g in range(GROUPS):
        packed = packed << BITS | np.minimum(counts[:, g], (1 << BITS) - 1)
    return packed


def with_vectors(counts: DataFrame) -> DataFrame:
    """word, n, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = pa.array(vectors(b.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], ["word", "n", "vec"])

    return counts.select("word", "n").mapInArrow(run, "word string, n long, vec long")


def _halves(word: Column, length: int) -> Column:
    """Halves of a word by the length of the shorter word of a pair: its own, or one less where it is the longer one."""
    own = F.char_length(word)
    rows = []
    for shorter, flags in ((own, 0), (own - 1, _LONG)):
        head = F.floor(shorter / 2).cast("int")
        usable = shorter >= length
        for side, half in ((0, F.left(word, head)), (_TAIL, F.right(word, shorter - head))):
            key = F.xxhash64(shorter, F.lit(side), half)
            rows.append(F.when(usable, F.struct(key.alias("key"), F.lit(flags | side).alias("flags"))))
    return F.array_compact(F.array(*rows))


def _cells(vec: Column) -> Column:
    """Nodes at level SPLIT that a budget of one surplus and one deficit reaches from a vector's own, which is first."""
    own = F.shiftright(vec, BITS * (GROUPS - SPLIT))
    units = [1 << BITS * (SPLIT - 1 - i) for i in range(SPLIT)]
    top = (1 << BITS) - 1
    count = [F.shiftright(own, BITS * (SPLIT - 1 - i)).bitwiseAND(top) for i in range(SPLIT)]
    more = [count[i] < top for i in range(SPLIT)]
    less = [count[i] > 0 for i in range(SPLIT)]
    steps = [F.when(more[i], own + units[i]) for i in range(SPLIT)] + [F.when(less[i], own - units[i]) for i in range(SPLIT)]
    steps += [F.when(more[i] & less[j], own + units[i] - units[j]) for i in range(SPLIT) for j in range(SPLIT) if i != j]
    return F.array_compact(F.array(own, *steps))


def routed(words: DataFrame, length: int = LEAST_LENGTH, limit: int = LIMIT) -> DataFrame:
    """key, cell, flags, word, n, vec: every word with the tries it belongs to or visits."""
    rows = words.select("word", "n", "vec", F.explode(_halves(F.col("word"), length)).alias("h"))
    rows = rows.select("word", "n", "vec", "h.key", "h.flags")
    large = stage(rows.groupBy("key").count().where(F.col("count") > limit).select("key", F.lit(True).alias("large")), "halves")
    rows = rows.join(large, "key", "left").withColumn("cells", F.when(F.col("large"), _cells(F.col("vec"))))
    few = rows.where(F.col("large").isNull()).select("key", F.lit(0).cast("long").alias("cell"), "flags", "word", "n", "vec")
    # only the shorter word of a pair searches, so longer ones visit nothing
    many = rows.where(F.col("large")).select("*", F.posexplode("cells").alias("turn", "cell"))
    many = many.where((F.col("turn") == 0) | (F.col("flags").bitwiseAND(_LONG) == 0))
    visits = F.when(F.col("turn") > 0, F.col("flags").bitwiseOR(_VISITS)).otherwise(F.col("flags"))
    return few.unionByName(many.select("key", "cell", visits.alias("flags"), "word", "n", "vec"))


def search(group: np.ndarray, vec: np.ndarray, queries: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, member) whose vectors differ by one surplus and one deficit at most.

    group and vec are sorted; queries and members are indexes into them, members in order. Each group has its own trie."""
    group_m, vec_m = group[members], vec[members]
    roots = np.flatnonzero(np.concatenate(([True], group_m[1:] != group_m[:-1])))
    starts = [roots]
    changed = np.zeros(len(members), bool)
    changed[roots] = True
    for level in range(GROUPS):
        prefix = vec_m >> (BITS * (GROUPS - 1 - level))
        changed = changed | np.concatenate(([True], prefix[1:] != prefix[:-1]))
        starts.append(np.flatnonzero(changed))
    ends = [np.append(s[1:], len(members)) for s in starts]
    children = []
    for level in range(GROUPS):
        parent = np.searchsorted(starts[level], starts[level + 1], "right") - 1
        count = vec_m[starts[level + 1]] >> (BITS * (GROUPS - 1 - level)) & ((1 << BITS) - 1)
        children.append(parent << BITS | count)

    def expand(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = high - low
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        return np.repeat(query, sizes), members[at]

    root = np.searchsorted(group_m[roots], group[queries])
    found = root < len(roots)
    found[found] = group_m[roots[root[found]]] == group[queries[found]]
    query, node = queries[found], root[found]
    left = np.full(len(query), 3, np.int8)  # bit 0: the surplus is left, bit 1: the deficit is
    for level in range(GROUPS):
        alone = ends[level][node] - starts[level][node] == 1
        if alone.any():
            yield expand(query[alone], starts[level][node[alone]], ends[level][node[alone]])
            query, node, left = query[~alone], node[~alone], left[~alone]
        if not len(query):
            return
        want = vec[query] >> (BITS * (GROUPS - 1 - level)) & ((1 << BITS) - 1)
        paths = []
        for step, cost in ((0, 0), (1, 1), (-1, 2)):
            may = (left & cost == cost) & (want + step >= 0) & (want + step < 1 << BITS)
            q, target = query[may], node[may] << BITS | (want[may] + step)
            at = np.searchsorted(children[level], target)
            there = at < len(children[level])
            there[there] = children[level][at[there]] == target[there]
            paths.append((q[there], at[there], left[may][there] & ~cost))
        query, node, left = (np.concatenate(x) for x in zip(*paths, strict=True))
    yield expand(query, starts[GROUPS][node], ends[GROUPS][node])


def _first_difference(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def near(a: np.ndarray, b: np.ndarray, words: list[str], lengths: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words a and b (b as long as a or one longer) are one edit apart, and where they first differ."""
    ok, at = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    wide = (lengths[a] >= WIDTH) | (lengths[b] >= WIDTH)
    for i in np.flatnonzero(wide):
        x, y = words[a[i]], words[b[i]]
        at[i] = p = _first_difference(x, y)
        ok[i] = x != y and x[p + (len(x) == len(y)) :] == y[p + 1 :]
    n = np.flatnonzero(~wide)
    if len(n):
        x, y = table[a[n]], table[b[n]]
        differ = x != y
        at[n] = differ.argmax(1)
        same = lengths[a[n]] == lengths[b[n]]
        one = differ.sum(1) == 1
        place = np.arange(WIDTH - 1)
        shifted = (x[:, :-1] != y[:, 1:]) & (place < lengths[a[n]][:, None])  # one code point of b skipped
        last = np.where(shifted.any(1), WIDTH - 2 - shifted[:, ::-1].argmax(1), -1)
        ok[n] = np.where(same, one, last < at[n])
    return ok, at


def near_pairs(rows: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of near words of the routed rows, once."""

    def block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        key, cell, vec = (t[c].to_numpy() for c in ("key", "cell", "vec"))
        flags, n = t["flags"].to_numpy(), t["n"].to_numpy()
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        group = np.cumsum(new) - 1
        order = np.lexsort((vec, group))
        group, vec, flags, n = group[order], vec[order], flags[order], n[order]
        words = t["word"].take(pa.array(order)).to_pylist()
        points, lengths = _points(words)
        table = np.zeros((len(words), WIDTH), np.uint16)
        narrow = np.repeat(lengths < WIDTH, lengths)
        column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table[np.repeat(np.arange(len(words)), lengths)[narrow], column[narrow]] = points[narrow]
        members, queries = np.flatnonzero(flags & _VISITS == 0), np.flatnonzero(flags & _LONG == 0)
        is_long = flags & _LONG > 0
        half = lengths // 2
        if not len(members) or not len(queries):
            return
        size = np.bincount(group[members], minlength=group[-1] + 1)
        queries = queries[size[group[queries]] > (flags[queries] & _VISITS == 0)]  # alone in a trie: no pair
        for some in range(0, len(queries), 8_192):
            for query, member in search(group, vec, queries[some : some + 8_192], members):
                before = (vec[query] < vec[member]) | ((vec[query] == vec[member]) & (query < member))
                fit = np.where(is_long[member], True, before) & (query != member)
                query, member = query[fit], member[fit]
                for i in range(0, len(query), PAIRS):
                    a, b = query[i : i + PAIRS], member[i : i + PAIRS]
                    ok, at = near(a, b, words, lengths, table)
                    ok &= (flags[a] & _TAIL == 0) | (at < half[a])  # where the first half agrees too, its trie has the pair
                    a, b = a[ok], b[ok]
                    if len(a):
                        names = pa.array(words)
                        columns = [names.take(pa.array(a)), pa.array(n[a]), names.take(pa.array(b)), pa.array(n[b])]
                        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            if len(cut):
                yield from block(t.slice(0, cut[-1] + 1).to_batches())
                held, count = t.slice(cut[-1] + 1).to_batches(), t.num_rows - cut[-1] - 1
            else:
                held = t.to_batches()
        if count:
            yield from block(held)

    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(run, "word string, n long, other string, other_n long")


def spelling_variants(
    docs: DataFrame,
    length: int = LEAST_LENGTH,
    times: int = LEAST_TIMES,
    ratio: int = FORM_RATIO,
    drop_in: int = DROP_IN,
    limit: int = LIMIT,
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each distinct word.

    A word's form is its near word (one code point inserted, deleted or replaced) of the largest n, ties to the smallest
    in code-point order, if that n is at least ratio times its own; its root is the last of the forms of forms. A null
    text has no words, so rows with null or empty texts, or an empty table, add none; repeated rows count as often as
    they occur; further columns of docs play no part."""
    counts = stage(word_counts(docs, length, times, drop_in), "words")
    words = stage(with_vectors(counts), "word-vectors")
    pairs = near_pairs(routed(words, length, limit))
    ends = F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    links = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    found = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.m") >= F.col("n") * ratio, F.col("best.near")).alias("form"), (-F.col("best.m")).alias("best_n"),
    )
    found = stage(found, "forms")
    # n grows tenfold from word to form, so a chain has as many steps as n has digits; each round doubles what is known
    most = counts.agg(F.max("n")).first()[0] or 1
    steps = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log(most, max(2, ratio)) + 1)))):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stage(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"),
    )
