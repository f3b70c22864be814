"""Fill-in-middle transformation by secondary-sort assembly.

Documents are cut into chunks of code points that carry their document and their place in the output. The pieces are
dealt out by document and sorted within partitions by place (repartition with sortWithinPartitions, which is
repartitionAndSortWithinPartitions for tables), so a task reads each output from start to end, one piece at a time, and
feeds digests. To restore, it looks for the marks in that stream and sends the pieces on with their place in the text;
they lie in the right partition already, so only the sort within partitions comes again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Marks of a form in the order of its output; a document that stays plain has none.
FORMS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of a mark's section in the text.
SECTION = {PREFIX: 1, MIDDLE: 2, SUFFIX: 3}
#: Code points of a piece.
UNIT = 1 << 16
_STEP = 1 << 40
#: Percentages of documents that stay plain, and of the others those with the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20

_PLAN = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long"


def cuts(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, text (null: empty), n, form and the two cuts low <= high in code points (null where the form is plain),
    all drawn from SHA-256 of seed and doc_id. A null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n"), digest.alias("digest"))
    d = d.select("doc_id", "text", "n", *(x.alias(f"h{i}") for i, x in enumerate(draws, 1)))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    return d.select(
        "doc_id", "text", "n", form.alias("form"),
        F.when(~plain, F.least(first, second)).alias("low"), F.when(~plain, F.greatest(first, second)).alias("high"),
    )


def pieces(docs: DataFrame, **options) -> DataFrame:
    """Pieces of the outputs: key and part (of the document), place (in the output), piece; the first piece of each
    document, place 0, is its plan (doc_id, n, form, prefix_chars, middle_chars).

    The key is MD5 of id and text, so it is the same whenever a task runs again; rows that agree in both differ by the
    partition they were read from, or come as several pieces of one place."""
    bound_batches(docs.sparkSession)
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")))
    made = cuts(docs, **options).select(key.alias("key"), F.spark_partition_id().alias("part"), "*")
    plan = _PLAN.format(id=made.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(schema)
            for key, part, doc_id, text, n, form, low, high in zip(*(c for c in batch.columns), strict=True):
                key, part, form, text = key.as_py(), part.as_py(), form.as_py(), text.as_py()
                low, high, n = low.as_py(), high.as_py(), n.as_py()
                out.add(key, part, 0, None, doc_id.as_py(), n, form, low, None if low is None else high - low)
                place = 1
                sections = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
                for mark in FORMS[form] or (None,):
                    start, end = sections[mark] if mark else (0, n)
                    lead = mark or ""
                    for at in range(start, max(end, start + 1), UNIT):
                        out.add(key, part, place, lead + text[at : min(at + UNIT, end)])
                        place, lead = place + 1, ""
                    if out.size > (4 << 20):
                        yield out.batch()
            yield out.batch()

    spark_schema = f"key binary, part int, place long, piece string, {plan}"
    schema = _arrow(made, spark_schema)
    return made.mapInArrow(run, spark_schema)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Rows:
    """Rows on their way into an Arrow batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.size, self.rows = schema, 0, []

    def add(self, *values) -> None:
        """Columns at the end may be left out; they are null."""
        self.rows.append(values + (None,) * (len(self.schema) - len(values)))
        self.size += 64 + len(values[3] or "")

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def sorted_pieces(made: DataFrame) -> DataFrame:
    return made.repartition("key", "part").sortWithinPartitions("key", "part", "place")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, once for each place of a document, with the number of rows that share it."""
    held, copies = None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[:3] == row[:3]:
                copies += 1
                continue
            if held is not None:
                yield held, copies
            held, copies = row, 1
    if held is not None:
        yield held, copies


def texts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, form, n, prefix_chars, middle_chars, output: the transformed texts, joined from the sorted pieces."""
    made = sorted_pieces(pieces(docs, **options))
    ddl = f"{_PLAN.format(id=made.schema['doc_id'].dataType.simpleString())}, output string"
    schema = _arrow(made, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            whole = (*plan, "".join(parts))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, whole, strict=True))] * copies, schema=schema)

        plan, parts, copies = None, [], 0
        for row, times in _documents(batches):
            if row[2] == 0:
                if plan is not None:
                    yield emit()
                plan, parts, copies = row[4:], [], times
            else:
                parts.append(row[3])
        if plan is not None:
            yield emit()

    return made.mapInArrow(run, ddl)


class Sections:
    """Finds the marks of a form in a stream of pieces of its output and gives (section, text) of what lies between."""

    def __init__(self, form: str):
        self.marks, self.held, self.section = list(FORMS[form]), "", 1

    def feed(self, piece: str, end: bool = False) -> Iterator[tuple[int, str]]:
        text = self.held + piece
        while self.marks and (at := text.find(self.marks[0])) >= 0:
            yield self.section, text[:at]
            text, self.section = text[at + len(self.marks[0]) :], SECTION[self.marks.pop(0)]
        keep = 0 if end or not self.marks else len(self.marks[0]) - 1
        self.held = text[len(text) - keep :] if keep else ""
        yield self.section, text[: len(text) - keep] if keep else text


def restored_pieces(made: DataFrame) -> DataFrame:
    """Of sorted pieces of outputs: the pieces of the texts, found by the marks in the output. The last row of each
    document, at the greatest place, has its plan and the digest of its output. No row leaves its partition."""
    ddl = f"key binary, part int, place long, piece string, {_PLAN.format(id=made.schema['doc_id'].dataType.simpleString())}"
    ddl += ", output_sha256 string, copies int"
    schema = _arrow(made, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, plan, copies, seen = Rows(schema), None, 0, 0

        def take(found: Iterator[tuple[int, str]]) -> None:
            nonlocal seen
            for section, text in found:
                if text:
                    out.add(*plan[:2], section * _STEP + seen, text)
                    seen += 1

        def close() -> None:
            take(state.feed("", end=True))
            out.add(*plan[:2], 9 * _STEP, None, *plan[4:], digest.hexdigest(), copies)

        for row, times in _documents(batches):
            if row[2] == 0:
                if plan is not None:
                    close()
                plan, copies, seen = row, times, 0
                digest, state = hashlib.sha256(), Sections(row[6])
            else:
                digest.update(row[3].encode())
                take(state.feed(row[3]))
            if out.size > (4 << 20):
                yield out.batch()
        if plan is not None:
            close()
        yield out.batch()

    return made.mapInArrow(run, ddl).sortWithinPartitions("key", "part", "place")


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, one row for each row of docs.

    Null and empty texts stay plain, as do texts that hold a mark. Documents with a null id draw alike; repeated rows
    give as many rows; an empty table gives none; further columns of docs play no part. A task holds one text while it
    cuts it, and one piece at a time afterwards."""
    back = restored_pieces(sorted_pieces(pieces(docs, **options)))
    ddl = f"{_PLAN.format(id=back.schema['doc_id'].dataType.simpleString())}, output_sha256 string, restored_sha256 string"
    schema = _arrow(back, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, rows = hashlib.sha256(), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] is not None:
                    digest.update(row[3].encode())
                else:
                    rows += [(*row[4:10], digest.hexdigest())] * row[10]
                    digest = hashlib.sha256()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
            rows = []

    return back.mapInArrow(run, ddl)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, low) AS p, substr(t, low + 1, high - low) AS m, substr(t, high + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""
