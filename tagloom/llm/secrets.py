"""Secret scans with multipart linking: identifiers, secrets and endpoints within a scope, by an interval join.

An access key or a named id identifies; an assigned value, a hex run or a long mixed run is secret; an endpoint locates.
Each identifier is joined with every secret within SCOPE characters of it. Such a pair is a link, with the nearest
endpoint in scope of either part. Weak parts are reported if they belong to a link, and every link as a span of its own."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches

#: The three base kinds in their order, with the least length of what must be long enough.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
ORDER = {"assign": 0, "access": 1, "hex": 2, "id": 3, "secret": 4, "endpoint": 5, "link": 6}

#: Weak parts, reported only when complementary parts lie in the same scope.
WEAK = {
    "id": re.compile(
        r"""(?:access_?key_?id|client_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""",
        re.I | re.A,
    ),
    "secret": re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"),
    "endpoint": re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}", re.A),
}
#: (start, end, kind) in code points, end exclusive.
Span = tuple[int, int, str]
#: Characters around a part within which a complementary part counts.
SCOPE = 200


def base_spans(text: str) -> list[Span]:
    """Base matches as (start, end, kind): leftmost, not overlapping within a kind, failing lengths dropped."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def weak_parts(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "id") for m in WEAK["id"].finditer(text)]
        found += [(m.start(), m.end(), "endpoint") for m in WEAK["endpoint"].finditer(text)]
    for m in WEAK["secret"].finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isupper() for c in run) and any(c.islower() for c in run):
            found.append((m.start(), m.end(), "secret"))
    return found


ROLE = {"access": "id", "id": "id", "assign": "secret", "hex": "secret", "secret": "secret", "endpoint": "endpoint"}


class Intervals:
    """Parts in order of their start, to be asked which of them lie within a distance."""

    def __init__(self, parts: list[Span]):
        self.parts = sorted(parts)
        self.starts = [p[0] for p in self.parts]
        self.reach = list(accumulate((p[1] for p in self.parts), max))  # the greatest end so far

    def near(self, start: int, end: int, scope: int) -> list[Span]:
        first, last = bisect_left(self.reach, start - scope), bisect_right(self.starts, end + scope)
        return [p for p in self.parts[first:last] if p[1] >= start - scope]


def gap(a: Span, b: Span) -> int:
    return max(0, a[0] - b[1], b[0] - a[1])


def links_of(parts: list[Span], scope: int = SCOPE) -> list[tuple[Span, Span, Span | None]]:
    """(identifier, secret, endpoint or None) for each identifier and secret at most `scope` characters apart.

    As parts of a role don't overlap much, an identifier has a bounded number of secrets in scope."""
    by_role: dict[str, list[Span]] = {"id": [], "secret": [], "endpoint": []}
    for part in parts:
        by_role[ROLE[part[2]]].append(part)
    if not by_role["id"] or not by_role["secret"]:
        return []
    secrets, endpoints = Intervals(by_role["secret"]), Intervals(by_role["endpoint"])
    found = []
    for name in sorted(by_role["id"]):
        for secret in secrets.near(name[0], name[1], scope):
            places = {p for x in (name, secret) for p in endpoints.near(x[0], x[1], scope)}
            found.append((name, secret, min(places, key=lambda p: (min(gap(p, name), gap(p, secret)), p), default=None)))
    return found


def render(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def parts_of(text: str, base: list[Span]) -> list[Span]:
    """Base spans and weak parts; a part that lies inside a base span is no part of its own."""
    taken = sorted((s, e) for s, e, _ in base)
    parts, k, reach = list(base), 0, -1
    for s, e, kind in sorted(weak_parts(text)):
        while k < len(taken) and taken[k][0] <= s:
            reach = max(reach, taken[k][1])
            k += 1
        if s >= reach and not (k < len(taken) and taken[k][0] < e and kind != "endpoint"):
            parts.append((s, e, kind))
    return parts


def scan(text: str) -> tuple[int, int, int, str, str, str]:
    base = base_spans(text)
    links = links_of(parts_of(text, base))
    spans = {*base, *(p for link in links for p in link if p)}
    for name, secret, place in links:
        ends = [p for p in (name, secret, place) if p]
        spans.add((min(p[0] for p in ends), max(p[1] for p in ends), "link"))
    kinds = [k for _, _, k in base]
    digest = hashlib.sha256(render(base).encode()).hexdigest()
    listed = sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))
    together = ",".join("+".join(f"{k}:{s}:{e}" for s, e, k in filter(None, link)) for link in links)
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, render(listed), together


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, links: a row for each row of docs.

    `links` lists the parts that belong together, as kind:start:end of identifier, secret and endpoint joined by "+". A
    null text counts as empty: no spans, and the digest of an empty string. Offsets are code points. Rows are
    independent, so repeated rows give repeated results; an empty table gives none; other columns play no part."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string"
    )
