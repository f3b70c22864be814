"""Main text of web pages, with a suffix order over each host's pages for boilerplate.

Markup says which blocks are of the article, which are boilerplate (menus, adverts, forms ...) and which may be either.
The tokens of all blocks outside articles are a page's stream; runs may cross the borders of its blocks. The suffixes of
all streams of a host are ordered: neighbours that share a long beginning and are of several distinct pages are repeated
boilerplate. What they cover in the main text is removed where it reaches a block's border, and what is unique stays,
with quotations in its midst. Text that only articles share
(syndicated texts) is no boilerplate, and pages of a host with equal streams (mirrors) are one page.

A host's suffixes aren't gathered: `repeats` deals them out by host and the least hash of a few tokens in a window, so
that a host of a third of all pages is spread over all tasks, and equal runs of a batch travel once. The suffix sort of
such a group, by tokens themselves, says which windows are equal and on which pages they stand."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bit_filter, blocks, bound_batches, in_filter, mix, stage
from tagloom.llm.repeats import PLACE, Kind, cut, repeated_runs
from tagloom.llm.substring_dedup import covered, word_symbols
from tagloom.llm.suffix_dedup import classes, suffix_orders

#: Tokens of a repeated run, those that decide where it is sent, and distinct pages of the host that it must be on.
WINDOW, GRAM, PAGES = 8, 3, 3
#: Tokens of a run that goes from blocks that markup says are of the article.
STRICT = 30
ARTICLE, EITHER, BOILERPLATE = 0, 1, 2
#: Regions that a whole page decides: an article that stands in a form or in what class names call boilerplate, that
#: boilerplate itself, and a form.
DOUBT, NAMED, FORM = 3, 4, 5
#: Words of a form that may be the main text of a page which has none outside it.
FORM_WORDS = 100

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|math|object)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notice|alert|sidebar"
    r"|side-bar|comments?|disqus|replies|related|recommended|share|sharing|social|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|header|masthead|topbar|popup|modal|newsletter|subscribe|signup|login|search|widget|complementary"
    r"|contentinfo|toolbar|pagination|skip-link|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Within an article each part of a class name has to be a word for boilerplate or one of these: `comment-list` goes,
#: `related-work`, `article-header` and `has-sidebar` stay.
_PLAIN = frozenset(
    "article articles story stories list box block container wrapper wrap inner outer bar area section item items row col column unit slot link links"
    " button buttons form site page main top bottom left right body content thread count title icon icons js post posts".split()
)
_HEADS = frozenset("header masthead".split())
#: Beginnings of class names that speak of what an element holds or lacks.
_SAYS = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "without_")
_OUT = frozenset("nav footer aside form head button menu dialog header title label".split())
_BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th section article main blockquote pre figure"
    " figcaption header footer nav aside form address details summary body html head title hr fieldset center menu dialog"
    " button label caption legend".split()
)
#: Elements whose end tag is needed to know where a region ends; paragraphs and the like are closed by what follows.
_NESTED = _BLOCKS - frozenset("p li dt dd tr td th hr h1 h2 h3 h4 h5 h6".split())


def boilerplate_names(names: str, inside: bool) -> bool:
    """Whether class names and the like tell boilerplate; within an article and for one, whole names have to."""
    names = [name for name in names.lower().split() if not name.startswith(_SAYS)]
    if not inside:
        return any(_JUNK.search(name) for name in names)
    for name in names:
        parts = [p for p in re.split(r"[_-]+", name) if p and not p.isdigit()]
        if _JUNK.search(name) and all(p in _PLAIN or (_JUNK.search(p) and p not in _HEADS) for p in parts):
            return True
    return False


def entered(region: int, name: str, names: str) -> int:
    """The region of an element within a region, by its name and its class names.

    Class names and forms don't decide on an article that they enclose: it is in doubt, and counts if the page has no
    other. Tags do: an article in `aside` or `nav` is boilerplate, as is a reader's comment within an article."""
    if name in ("article", "main"):
        junk = bool(names) and boilerplate_names(names, True)
        if region in (ARTICLE, DOUBT):
            return BOILERPLATE if junk else region
        if region == BOILERPLATE:
            return region
        return ARTICLE if region == EITHER and not junk else DOUBT
    inside = region in (ARTICLE, DOUBT)
    if name in _OUT and not (inside and name == "header"):
        return {EITHER: FORM, FORM: FORM, NAMED: NAMED}.get(region, BOILERPLATE) if name == "form" else BOILERPLATE
    if names and region != BOILERPLATE and name not in ("body", "html") and boilerplate_names(names, inside):
        return BOILERPLATE if inside else NAMED
    return region


def decided(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Blocks by the three regions that remain: articles in doubt count where no other does, and a long form where nothing
    else does."""
    have = {region for region, _ in found}
    becomes = {DOUBT: BOILERPLATE if ARTICLE in have else ARTICLE, NAMED: BOILERPLATE, FORM: BOILERPLATE}
    if not have & {ARTICLE, DOUBT, EITHER} and sum(len(text.split()) for region, text in found if region == FORM) >= FORM_WORDS:
        becomes[FORM] = EITHER
    return [(becomes.get(region, region), text) for region, text in found]


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(region, text) of a page's blocks in order, character references decoded, white space made single spaces."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", EITHER)]

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((stack[-1][1], text))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in _BLOCKS:
            if name == "br":
                parts.append(" ")
            continue
        if not m[2]:
            flush()
            if name in _NESTED:
                names = " ".join(x.strip("\"'") for x in _NAMES.findall(m[4])) if m[4] else ""
                region = entered(stack[-1][1], name, names)
                if not m[4].rstrip().endswith("/"):
                    stack.append((name, region))
        else:
            flush()
            if name in _NESTED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
    parts.append(page[at:])
    flush()
    return decided(out)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\s]*)", url or "")
    return m[1].lower() if m else f"no host: {' '.join((url or '').split())}"


def stream_key(host: str, stream: str, article: bool) -> int | None:
    """A name of a host's stream; those of articles are odd."""
    if not stream:
        return None
    digest = hashlib.blake2b(f"{host}\n{stream}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) & ~1 | article


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks with their regions, and the names of the streams outside and of the article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts, regions, outside, article = [], [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = blocks_of(page.as_py() or "")
                hosts.append(host_of(url))
                texts.append([t for _, t in found])
                regions.append([r for r, _ in found])
                outside.append(stream_key(hosts[-1], " ".join(t for r, t in found if r != ARTICLE), False))
                article.append(stream_key(hosts[-1], " ".join(t for r, t in found if r == ARTICLE), True))
            columns = [
                pa.array(hosts, pa.string()),
                pa.array(texts, pa.list_(pa.string())),
                pa.array(regions, pa.list_(pa.int8())),
                pa.array(outside, pa.int64()),
                pa.array(article, pa.int64()),
            ]
            names = ["page_id", "url", "host", "blocks", "regions", "outside", "article"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=names)

    columns = [F.col("page_id").cast("long").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in ("url", "html"))]
    out = "page_id long, url string, host string, blocks array<string>, regions array<byte>, outside long, article long"
    return pages.select(*columns).mapInArrow(run, out)


def page_symbols(texts: list[bytes]):
    """Symbols of streams, each with its host in the line before it: equal words of two hosts are two symbols."""
    hosts, streams = zip(*((h, s) for h, _, s in (t.partition(b"\n") for t in texts)), strict=True)
    words, counts, string = word_symbols(list(streams))
    names = np.array([int.from_bytes(hashlib.blake2b(h, digest_size=8).digest(), "little") for h in hosts], np.uint64)
    ends = np.cumsum(counts)
    whole = lambda a, b: hosts[int(np.searchsorted(ends, a, side="right"))] + b"\n" + string(a, b)
    return mix(words ^ np.repeat(names, counts)), counts, whole


KIND = Kind(WINDOW, GRAM, page_symbols, longest=STRICT)


def streams_of(batch: pa.RecordBatch, articles: bool) -> Iterator[tuple[list[int], list[bytes], list[bool]]]:
    """Distinct streams of parsed pages in blocks: names, host and stream, and whether the main text is in it."""
    found: dict[int, tuple[bytes, bool]] = {}
    for host, texts, regions, outside, article in zip(*(batch.column(c) for c in ("host", "blocks", "regions", "outside", "article")), strict=True):
        own, texts = regions.as_py(), texts.as_py()
        for key, inside in ((outside, False), (article, True)):
            if key.is_valid and key.as_py() not in found and (articles or not inside):
                stream = " ".join(t for r, t in zip(own, texts, strict=True) if (r == ARTICLE) == inside)
                found[key.as_py()] = f"{host.as_py()}\n{stream}".encode(), inside or not article.is_valid
    keys, rest = list(found), list(found.values())
    for some in blocks(rest, [len(t) for t, _ in rest]):
        yield [keys[i] for i in some], [rest[i][0] for i in some], [rest[i][1] for i in some]


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """anchor: those that several streams outside articles have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts, _ in streams_of(batch, False):
                values, counts, _ = page_symbols(texts)
                seg = cut(values, counts, KIND)
                owner = np.array(keys, np.int64)[seg.text]
                order = np.lexsort((owner, seg.key))
                anchor, owner = seg.key[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, int)
                last = np.append(first[1:], len(anchor))[: len(first)] - 1
                columns = [anchor[first].view(np.int64), owner[first], owner[last]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "low", "high"])

    found = rows.mapInArrow(run, "anchor long, low long, high long")
    met = found.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return stage(met.where("low < high").select("anchor"), "page-anchors")


def page_segments(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Segments whose anchor may be repeated: anchor, its place, windows, string, places in main texts, and the names of
    the pages (as many as matter) that have it outside an article. Equal segments of a batch are one row."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts, main in streams_of(batch, True):
                values, counts, string = page_symbols(texts)
                seg = cut(values, counts, KIND)
                take = in_filter(shared.value, seg.key)
                limit = np.cumsum(counts)
                first, limit = limit - counts, limit.tolist()
                gathered: dict[tuple[int, int, int, bytes], tuple[list, set]] = {}
                for t, start, n, at, anchor in zip(
                    *(getattr(seg, f)[take].tolist() for f in ("text", "start", "n", "anchor", "key")), strict=True
                ):
                    whole = (anchor, at - start, n, string(start, min(start + n + STRICT - 1, limit[t])))
                    places, pages = gathered.setdefault(whole, ([], set()))
                    if main[t]:
                        places.append((keys[t], start - int(first[t])))
                    if not keys[t] & 1:
                        pages.add(keys[t])
                if gathered:
                    anchors, at, windows, strings = zip(*gathered, strict=True)
                    columns = [
                        pa.array(np.array(anchors, np.uint64).view(np.int64)),
                        pa.array(at, pa.int32()),
                        pa.array(windows, pa.int32()),
                        pa.array(strings, pa.binary()),
                        pa.array([np.array(p, PLACE).tobytes() for p, _ in gathered.values()], pa.binary()),
                        pa.array([sorted(k)[:PAGES] for _, k in gathered.values()], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "at", "n", "segment", "places", "pages"])

    out = "anchor long, at int, n int, segment binary, places binary, pages array<long>"
    return rows.mapInArrow(run, out)


def distinct_pages(rows: list[tuple]) -> list[int]:
    return sorted({key for _, keys in rows for key in keys})[:PAGES]


def on_several_pages(groups):
    """A judge that orders the suffixes of a group's streams and finds the windows that stand on PAGES distinct pages."""
    answers: list = [[[] for _ in segments] for segments, _ in groups]
    several = []
    for g, (segments, pages) in enumerate(groups):
        if len(set().union(*pages)) < PAGES:
            continue
        if len(segments) == 1:
            _, n, string = segments[0]
            ends = [(w, min(n, string.count(b" ") + 2 - w)) for w in (WINDOW, STRICT)]
            answers[g] = [[(0, end, w) for w, end in ends if end > 0]]
        else:
            several.append(g)
    if not several:
        return answers
    ids: dict[tuple[bytes, bytes], int] = {}
    streams, at, windows, owner, names = [], [], [], [], []
    for g in several:
        for (place, n, string), pages in zip(*groups[g], strict=True):
            host, _, stream = string.partition(b"\n")
            owner += [len(streams)] * len(pages)
            names += pages
            streams.append(np.array([ids.setdefault((host, word), len(ids)) for word in stream.split(b" ")], np.int64))
            at.append(place)
            windows.append(n)
    at, windows, owner, names = (np.array(x, np.int64) for x in (at, windows, owner, names))
    sizes, length = np.array([len(groups[g][0]) for g in several]), np.array([len(x) for x in streams])
    for g, (own, sides) in zip(several, suffix_orders(np.concatenate(streams), at, length, sizes), strict=True):
        mine = slice(*np.searchsorted(owner, [own.start, own.stop]))

        def repeated(there, same, who=owner[mine] - own.start, page=names[mine], c=own.stop - own.start):
            kind = np.full(c, -1)
            kind[there] = same
            pairs = np.unique(np.stack([kind[who], page]), axis=1)[0]
            return np.bincount(pairs[pairs >= 0], minlength=same.max() + 1)[same] >= PAGES

        for w in (WINDOW, STRICT):
            n = np.minimum(windows[own], length[own] - w + 1)
            if (n > 0).any():
                for all_, runs in zip(answers[g], classes(w, at[own], n, repeated, *sides), strict=True):
                    all_ += [(a, b, w) for a, b in runs]
    return answers


def main_text(texts: list[str], regions: list[int], runs: list[dict] | None) -> str:
    """The main text: the article's blocks, or else those that may be either, without what the runs cover."""
    inside = ARTICLE in regions
    own = [(r, t) for r, t in zip(regions, texts, strict=True) if (r == ARTICLE) == inside]
    width = STRICT if inside else WINDOW
    if not any(run["width"] == width for run in runs or ()):
        return "\n".join(t for r, t in own if r != BOILERPLATE)
    stream = [(r, t.split(" ")) for r, t in own]
    gone = covered(sum(len(words) for _, words in stream), runs, width)
    kept, at = [], 0
    for region, words in stream:
        cover, at = gone[at : at + len(words)], at + len(words)
        stay = np.flatnonzero(~cover)
        if len(stay) and region != BOILERPLATE:  # a quotation within a block is the block's own: what reaches its borders goes
            kept.append(" ".join(words[stay[0] : stay[-1] + 1]))
    return "\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages.

    A null or empty html, and a page without main text, give an empty text. Pages without a host in their url are of a
    host with those of the same url. Repeated rows are one page for the count of distinct pages and each get their
    result. An empty table gives an empty result; other columns play no part."""
    bound_batches(pages.sparkSession)
    rows = stage(parsed(pages), "page-blocks")
    anchors = repeated_anchors(rows)
    log2 = min(26, max(18, (8 * anchors.count()).bit_length()))  # 8 MB at most; beyond, more segments are sent
    runs = repeated_runs(page_segments(rows, bit_filter(anchors, "anchor", log2)), on_several_pages, distinct_pages)
    runs = runs.groupBy("key").agg(F.collect_set(F.struct("first", "last", "width")).alias("runs"))
    runs = stage(runs, "page-runs")
    out = "page_id long, url string, text string, n_chars long"

    def render(batch: pa.RecordBatch, runs: list) -> pa.RecordBatch:
        own = zip(batch.column("blocks").to_pylist(), batch.column("regions").to_pylist(), runs, strict=True)
        found = [main_text(*row) for row in own]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    # a page whose main stream has no run doesn't meet any; a bit map of the streams with runs tells most of them
    shared = pages.sparkSession.sparkContext.broadcast(bit_filter(runs, "key", min(26, max(18, (8 * runs.count()).bit_length()))))
    main = F.coalesce("article", "outside")

    def marked(batch: pa.RecordBatch) -> np.ndarray:
        keys = pc.fill_null(batch.column("main"), 0).to_numpy()
        return in_filter(shared.value, keys.view(np.uint64))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(~marked(batch)))
            yield render(some, [None] * some.num_rows)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(batch)))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield render(batch, batch.column("runs").to_pylist())

    own = rows.select("page_id", "url", "blocks", "regions", main.alias("main"))
    met = own.mapInArrow(others, own.schema).join(runs, F.col("main") == F.col("key"), "left")
    return own.mapInArrow(plain, out).unionByName(met.select("page_id", "url", "blocks", "regions", "runs").mapInArrow(without, out))
