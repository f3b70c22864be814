"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alikes, normalised by length.

The lexicon is learned from labelled rows: beginnings of words and whole words that are much more frequent in toxic
texts, with the logarithm of their odds as weight. Words and pairs of neighbouring words that contain an entry but are
of clean texts are exception phrases: such a match cancels the entry inside it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches

#: Labelled rows that the lexicon is learned from, the first by a hash of doc_id; a bound on what is fitted, no more.
TRAIN_ROWS = 12_000
#: Lengths of beginnings of words that may become entries.
STEM = range(4, 10)
#: Share of the toxic training texts that hold an entry, and of the clean ones that hold an exception, and texts at least.
SUPPORT, LEAST = 0.004, 5


#: Characters that look like Latin letters, and what digits stand for inside words.
LOOKS = str.maketrans("аеорсухіјѕԁһкмтвнαοερικντυχ", "aeopcyxijsdhkmtbhaoepikvtux")
DIGITS = str.maketrans("0134578", "oieastb")
_INNER = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])")
_SIGNS = str.maketrans("@$!", "asi")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The words of a text, each between single spaces: lower case, look-alikes as Latin letters (in words that have
    Latin letters), digits and signs inside words as the letters that they stand for."""
    low = text.lower()
    if not low.isascii():
        low = re.sub(r"\w*[a-z]\w*", lambda m: m[0] if m[0].isascii() else m[0].translate(LOOKS), low)
    low = _INNER.sub(lambda m: m[0].translate(DIGITS).translate(_SIGNS), low)
    return f" {_OTHER.sub(' ', low).strip()} "


class Lexicon:
    """Entries (a folded string that begins with a space, its weight) and exceptions, in one automaton."""

    def __init__(self, entries: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for phrase, weight in entries.items():
            self.automaton.add_word(phrase, (len(phrase), weight))
        self.empty = not entries and not exceptions
        if not self.empty:
            self.automaton.make_automaton()

    def features(self, folded: str) -> list[float]:
        """1, weight of the matches and of the best ones by length of the text, and the greatest weight."""
        best: dict[int, float] = {}
        dropped = []
        if not self.empty:
            for end, (size, weight) in self.automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    dropped.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for start, end in dropped:
            for at in [s for s in best if start <= s <= end]:
                del best[at]
        words = max(1, folded.count(" ") - 1)
        total = sum(best.values())
        return [1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), max(best.values(), default=0.0) / 5]

    def contexts(self, folded: str) -> set[str]:
        """The words with an entry, alone and with each neighbour: what may be an exception phrase."""
        found = set()
        for end, (size, _) in self.automaton.iter(folded) if not self.empty else ():
            start = end - size + 1
            stop = folded.index(" ", start + 1)
            found.add(folded[start : stop + 1])
            if start > 0:
                found.add(folded[folded.rindex(" ", 0, start) : stop + 1])
            if stop + 1 < len(folded):
                found.add(folded[start : folded.index(" ", stop + 1) + 1])
        return found


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of the labelled rows to learn from: none that is held out, TRAIN_ROWS at most."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).dropDuplicates(["doc_id"])
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def counted(rows: DataFrame, phrases: Callable[[str], set[str]]) -> DataFrame:
    """phrase, toxic, clean: training texts of each label that have the phrase, for all phrases of their folded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            found = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array([sums[k][p] for p in found], pa.int64()) for k in (1, 0)]
            sums[0].clear()
            sums[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *columns], names=["phrase", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[label].update(phrases(fold(text.as_py())))
                if len(sums[0]) + len(sums[1]) > 100_000:
                    yield flush()
        yield flush()

    sums = rows.mapInArrow(run, "phrase string, toxic long, clean long")
    return sums.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def stems(folded: str) -> set[str]:
    """The words of a folded text and their beginnings."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEM if n <= len(word))
    return found


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[str], np.ndarray]:
    """Entries, exceptions and the coefficients of a logistic regression on the features.

    What reaches the driver is of the size of the TRAIN_ROWS training texts at most: phrases of several of them."""
    bound_batches(docs.sparkSession)
    rows = training_rows(docs, labels).persist()
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    # the share of toxic texts among those with the phrase, less two standard errors
    share, of = F.col("toxic") / (F.col("toxic") + F.col("clean")), F.col("toxic") + F.col("clean")
    sure = share - 2 * F.sqrt((share * (1 - share) + 1 / of) / of)
    base = (toxic + 1) / (toxic + clean + 2)
    strong = (F.col("toxic") >= max(LEAST, SUPPORT * toxic)) & (sure > min(0.5, 2 * base)) & (odds > 1)
    picked = counted(rows, stems).where(strong).select("phrase", odds.alias("w"))
    entries = {r["phrase"]: float(r["w"]) for r in picked.collect()}
    bare = Lexicon(entries, [])
    often = (F.col("toxic") == 0) & (F.col("clean") >= max(LEAST, SUPPORT * clean / 4))
    exceptions = [r["phrase"] for r in counted(rows, bare.contexts).where(often).select("phrase").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, exceptions)
        for batch in batches:
            x = [lexicon.features(fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
            )

    sample = rows.mapInArrow(run, "x array<double>, toxic int").collect()  # TRAIN_ROWS small rows at most
    rows.unpersist()
    return entries, exceptions, fit([r["x"] for r in sample], [r["toxic"] for r in sample])


def fit(rows: list[list[float]], labels: list[int]) -> np.ndarray:
    """Logistic regression by Newton's method, with a little shrinkage."""
    if not rows:
        return np.array([-2.0, 0.0, 0.0, 0.0])
    x, y = np.array(rows), np.array(labels, float)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), slope)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    Only texts are inputs of a score; a null text counts as empty and, like any text without an entry, gets the least
    score. Rows with a null doc_id are not held out, as they can't be labelled. Without labelled rows of both kinds the
    lexicon is empty. Repeated rows get the same score, an empty table gives an empty result."""
    entries, exceptions, b = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = Lexicon(entries, exceptions), b.tolist()
        for batch in batches:
            scores = []
            for text in batch.column(2):
                z = sum(w * x for w, x in zip(weights, lexicon.features(fold(text.as_py() or "")), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            marks = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(marks, pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, judged inside the same pass: nothing is joined.

    Rows with null texts count as empty texts, repeated rows are judged alike, an empty table stays empty, and columns of
    docs may have any names."""
    entries, exceptions, b = learn(docs, labels)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = Lexicon(entries, exceptions), b.tolist()
        for batch in batches:
            keep = []
            for text in batch.column(at):
                z = sum(w * x for w, x in zip(weights, lexicon.features(fold(text.as_py() or "")), strict=True))
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
