"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
further columns of clashing names."""

import collections
import hashlib
import itertools
import random
import zlib

import ahocorasick  # noqa: F401
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import bpe, decontaminate, exact_dedup, html_text, near_dedup, repeats, secrets, token_files, toxicity
from tagloom.llm.substring_dedup import drop_repeated_words
from tagloom.llm.suffix_dedup import drop_repeated_bytes

random.seed(7)
WORDS = "ab cd ef gh ij kl mn the of and".split()
SHARED = [" ".join(random.choice(WORDS) for _ in range(60)) for _ in range(10)]
TEXTS = [None, "", "  ", "aaaa " * 300, "b" * 1500, "é" * 700, "A b C", "a b c"]
for _ in range(150):
    text = " ".join(random.choice(WORDS) for _ in range(random.randint(0, 50)))
    for _ in range(random.randint(0, 3)):
        part = random.choice(SHARED)
        at = random.randint(0, len(part) // 2)
        text += "\n" + part[at : at + random.randint(5, 300)] + " " + random.choice(["x", "y", "z\t"])
    TEXTS.append(text)
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(20, TEXTS[20]), (20, TEXTS[20]), (None, TEXTS[21]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, "s") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, anchor int, digest string").repartition(5)


def covered(symbols, width):
    counts = collections.Counter(tuple(s[i : i + width]) for s in symbols for i in range(len(s) - width + 1))
    out = []
    for s in symbols:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if counts[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("share", [1000, 20])
def test_repeats(docs, monkeypatch, share):
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    words = [(t or "").encode().split() for _, t in ROWS]
    data = [(t or "").encode() for _, t in ROWS]

    def expected(symbols, width, join):
        for (i, _), s, g in zip(ROWS, symbols, covered(symbols, width), strict=True):
            kept = join([x for x, y in zip(s, g, strict=True) if not y])
            yield i, len(s), sum(g), hashlib.sha256(kept).hexdigest()

    got = drop_repeated_words(docs, 10, 3)
    assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == order(expected(words, 10, b" ".join))
    marks = [n for _, _, n, _ in expected(data, 30, bytes)]
    wanted = [(*row, n) for row, n in zip(expected(data, 40, bytes), marks, strict=True)]
    got = drop_repeated_bytes(docs, 40, 8, 30)
    assert order((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"], r["n_passage"]) for r in got.collect()) == order(wanted)
    assert sum(r[2] < n for r, n in zip(wanted, marks, strict=True)) > 3
    for empty in (drop_repeated_words(docs.limit(0), 10, 3), drop_repeated_bytes(docs.limit(0), 40, 8, 30)):
        assert empty.count() == 0


def test_exact(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[(t or "").translate(lower)].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    clash = docs.selectExpr("*", "doc_id AS _row0_", "1 AS _row1_turn", "2 AS _sha_", "9 AS _turn_")
    dropped = exact_dedup.drop_exact_copies(clash)
    assert dropped.columns == clash.columns
    assert all(r["_row0_"] == r["doc_id"] and r["_row1_turn"] == 1 and r["_sha_"] == 2 and r["_turn_"] == 9 for r in dropped.collect())
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_bpe(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    tree, pattern = bpe.coder(path, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})
    bits = ["a", "the", " ", "  ", "\n", " \n", "é", "#", "!!!", "12", "'s", "日本", "\t", "\0"]
    for k in range(400):
        t = "".join(random.choice(bits if k % 5 else "abcdetions") for _ in range(random.randint(0, 300)))
        assert np.frombuffer(bpe.encode(t, tree, pattern), "<u4").tolist() == own.encode_ordinary(t)
    got = bpe.encode_documents(docs, path, P.PATTERN).collect()
    expected = [(i, len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    assert order((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == order(expected)


def test_token_files(spark, docs, tmp_path):
    tokenizer, at, expected = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    texts = ["Straße\u00a0naïve\u2003x", "a" * 40 + " <|endoftext|>b\0c " + "z" * 16 + " " + "z" * 17, "日本語のテキスト " * 3]
    rows = [*ROWS, (-1, "minus one"), *((1000 + i, t) for i, t in enumerate(texts)), (2000, "long word " * 120_000)]
    extra = spark.createDataFrame([(i, t, "k", 1, "s") for i, t in rows[len(ROWS) :]], docs.schema)
    token_files.write_ids(docs.unionByName(extra), P.path("word_bpe_49k.json"), 2, str(tmp_path / "ids"), partitions=3)
    found = token_files.read_ids(spark, str(tmp_path / "ids"), with_ids=True).orderBy("start").collect()
    wanted = collections.Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        wanted[i, len(ids) // 4, zlib.crc32(ids), ids] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in found) == wanted
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    token_files.write_ids(docs.limit(0), P.path("word_bpe_49k.json"), 2, str(tmp_path / "none"))
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0
    ids = np.arange(200_000, dtype="<u4")
    assert (token_files.unpack(token_files.pack([1], [200_000], ids))[3] == ids).all()


def test_secrets(spark, docs):
    key = "AKIA" + "B" * 16
    text = f'é PASSWORD = "abc" token: abcdef1 {key} near client_id=me123 and https://h.example/x ' + "0f" * 12
    base = secrets.base_spans(text)
    assert [k for _, _, k in base] == ["assign", "access", "hex"] and text[base[1][0] : base[1][1]] == key
    assert secrets.links_of(secrets.parts_of("client_id=me123 alone", [])) == []
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    got = secrets.find_secrets(rows).collect()
    assert len(got) == 4 and sum(r["n_access"] for r in got) == 2 and all(r["spans"] == "" for r in got if r["doc_id"] > 1)
    kinds = {s.split(":")[0] for s in got[0]["spans"].split(",")}
    assert kinds == {"assign", "access", "hex", "id", "endpoint", "link"}
    assert f"access:{base[1][0]}:{base[1][1]}+assign" in got[0]["links"]
    assert secrets.find_secrets(docs).count() == len(ROWS) and secrets.find_secrets(docs.limit(0)).count() == 0
    assert secrets.find_secrets(docs.withColumn("spans", F.lit(1))).columns[-1] == "links"


def test_secret_links():
    """The interval join against all pairs, on texts of parts in random places."""
    rng = random.Random(3)
    makers = [
        lambda: "AKIA" + "Q" * rng.choice([16, 20]),
        lambda: f"client_id={'n' * rng.choice([3, 150])}",
        lambda: "secret=" + "s" * rng.randint(6, 40),
        lambda: "aB3" * rng.choice([11, 60, 1700]),
        lambda: "https://h.example/" + "p" * rng.randint(0, 300),
        lambda: "word " * rng.randint(1, 60),
    ]
    seen = 0
    for _ in range(300):
        text = " ".join(rng.choice(makers)() for _ in range(rng.randint(0, 14)))
        parts = secrets.parts_of(text, secrets.base_spans(text))
        pairs = {
            (a, b)
            for a in parts
            for b in parts
            if a[2] in ("access", "id") and b[2] in ("assign", "hex", "secret") and max(a[0] - b[1], b[0] - a[1]) <= secrets.SCOPE
        }
        links = secrets.links_of(parts)
        assert {(a, b) for a, b, _ in links} == pairs and len(links) == len(pairs)
        for a, b, place in links:
            open_ = [p for p in parts if p[2] == "endpoint" and min(secrets.gap(p, a), secrets.gap(p, b)) <= secrets.SCOPE]
            best = min((min(secrets.gap(p, a), secrets.gap(p, b)) for p in open_), default=None)
            assert best == (place and min(secrets.gap(place, a), secrets.gap(place, b)))
            seen += place is not None
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in secrets.base_spans(text))
        *_, digest, spans, _ = secrets.scan(text)
        assert digest == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(spans.split(","))
    assert seen > 100


def test_long_secrets():
    run, name, rest = "aB3" * 100, "n" * 150, "x" * 900
    text = f"{run}== login={name} s3://{rest} end"
    got = secrets.links_of(secrets.parts_of(text, secrets.base_spans(text)))
    assert [[text[s:e] for s, e, _ in link] for link in got] == [[f"login={name}", f"{run}==", f"s3://{rest}"]]
    # many starts that lead nowhere: time in proportion to the text
    assert secrets.weak_parts("aB3" * 100_000 + "===") == [] and secrets.weak_parts("=" + "a+." * 100_000 + ":") == []


def test_near(docs, spark):
    words = [f"w{i}" for i in range(300)]
    edited = [*words[:100], "x", *words[101:]]
    far = [f"v{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(edited), " ".join(far), " ".join(far).upper(), None, "", "one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.near_classes(rows).collect()}
    assert got == {
        0: (0, 2, True), 1: (0, 2, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 1, True)
    }
    assert near_dedup.near_classes(docs).count() == len(ROWS)
    kept = near_dedup.drop_near_copies(rows)
    assert kept.columns == rows.columns and kept.count() == 5
    # rows go by id and text: the second row of id 2, and the row without an id that has no copy, stay
    more = spark.createDataFrame([(None, texts[0], 1), (None, "alone", 1), (2, " ".join(f"u{i}" for i in range(50)), 1)], "doc_id long, text string, _key0_ int")
    mixed = near_dedup.drop_near_copies(rows.withColumn("_key0_", F.lit(1)).unionByName(more).unionByName(more))
    assert mixed.columns == ["doc_id", "text", "_key0_"]
    assert order(r["doc_id"] for r in mixed.collect()) == order([0, 2, 2, 4, 5, 6, None])
    assert near_dedup.near_classes(rows.limit(0)).count() == 0


def test_near_recall(spark):
    """All pairs of whole texts by brute force: the same classes."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = near_dedup.Weights(*near_dedup.document_frequencies(rows))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    where, own, total = collections.defaultdict(list), {}, {}
    for i, text in sorted(texts.items()):
        _, value, times = near_dedup.shingles([text], near_dedup.SHINGLE)
        own[i] = dict(zip(value.tolist(), weights.of(value, times).tolist(), strict=True))
        total[i] = sum(own[i].values())
        for v in own[i]:
            where[v].append(i)
    both = collections.Counter()
    for v, ids in where.items():
        for i, j in itertools.combinations(ids, 2):
            both[i, j] += min(own[i][v], own[j][v])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for (i, j), shared in both.items():
        if shared >= 0.8 * (total[i] + total[j] - shared) - 1e-9:
            links += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert links > 50
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(rows).collect()} == {i: find(i) for i in texts}


def test_near_template(spark, monkeypatch):
    """Pairs of 0.82 among texts of one template, strangers of 0.78: as all pairs compared."""
    monkeypatch.setattr(near_dedup, "TILE", 40, raising=False)
    template = [f"t{i}" for i in range(300)]
    texts = [" ".join([*(f"o{i}x{k}" for k in range(17)), *template, *(f"p{i // 2}x{k}" for k in range(5))]) for i in range(240)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = near_dedup.Weights(*near_dedup.document_frequencies(rows))
    own = []
    for text in texts:
        _, value, times = near_dedup.shingles([text], near_dedup.SHINGLE)
        own.append(dict(zip(value.tolist(), weights.of(value, times).tolist(), strict=True)))
    least, strangers = list(range(len(texts))), 0
    for i, x in enumerate(own):
        for j in range(i + 1, len(own)):
            both = sum(min(w, own[j][v]) for v, w in x.items() if v in own[j])
            like = both / (sum(x.values()) + sum(own[j].values()) - both)
            strangers += 0.7 < like < 0.8
            if like >= 0.8:
                least = [least[i] if c == least[j] else c for c in least]
    assert strangers > 28_000 and len(set(least)) == 120
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(rows).collect()}
    assert got == dict(enumerate(least))


def test_decontaminate(spark):
    item = [f"q{i}" for i in range(20)]
    swapped = [*item[:6], "zz", *item[7:]]
    fill = " ".join(f"n{i}" for i in range(40))
    texts = [f"{fill} {' '.join(item)} {fill}", f"{fill} {' '.join(swapped)}", fill, None, " ".join(item[:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, None), (7, "too short")], "item_id long, text string")
    few = spark.createDataFrame([(1, "far too short"), (2, "Short, indeed!"), (3, None), (3, "so far too short too short")], "doc_id long, text string")
    marks = {r["item_ids"][0] if r["item_ids"] else None for r in decontaminate.contamination(few, bench).collect()}
    assert marks == {7, None} and decontaminate.drop_contaminated(few, bench).count() == 2
    assert decontaminate.contamination(few.limit(0), bench).count() == 0
    assert decontaminate.contamination(few.unionByName(few), bench).where("contaminated").count() == 4
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {0: (True, [5]), 1: (True, [5]), 2: (False, []), 3: (False, []), 4: (False, [])}
    clash = decontaminate.drop_contaminated(docs.selectExpr("*", "1 AS _key_", "2 AS _leak_"), bench)
    assert clash.columns == ["doc_id", "text", "_key_", "_leak_"] and clash.count() == 3
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 5


def test_decontaminate_substitutions(spark):
    """Every place of the tolerated substitutions in overlaps of 5 to 13 words, and every sixth word of a long one."""
    fill, texts, expected = " ".join(f"n{i}" for i in range(20)), [], []
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (*range(5, 14), 40)}
    for n, item in items.items():
        places = itertools.combinations(range(n), n // 6) if n < 40 else [range(phase, 40, 6) for phase in range(6)]
        for at in places:
            texts.append(f"{fill} {' '.join('zz' if k in at else w for k, w in enumerate(item))} {fill}")
            expected.append([n])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(docs, bench).collect()}
    assert got == dict(enumerate(expected)) and len(expected) == 202


def test_decontaminate_one_word(spark):
    """A long text of one word meets an item of the same word at every shift; its words travel once."""
    docs = spark.createDataFrame([(1, "na " * 16_000), (2, "na " * 12), (3, "no " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "na " * 20), (None, "no " * 20)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert got[1]["item_ids"] == [7] and got[1]["longest"] == 20 and not got[2]["contaminated"]
    assert (got[3]["contaminated"], got[3]["n_items"], got[3]["item_ids"]) == (True, 0, [])


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><div class='ad'>buy</div>"
        "<article><h1>Head &amp; tail</h1><p>One\n two<br>three<p>Four</article><footer>&copy; x</footer></body></html>"
    )
    line = " ".join(f"cookie{i}" for i in range(12))
    plain = "<body><p>{}</p><p>" + line + "</p></body>"
    rows = [(1, "http://a/x", page), (4, None, None), (5, "no url", ""), (6, "http://a/y", "<p>" + "long word &eacute; " * 100_000)]
    rows += [(10 + i, f"http://b/{i}", plain.format(f"page number {i}")) for i in range(3)]
    rows += [(20 + i, f"http://c/{i}", plain.format(f"page number {i}")) for i in range(2)]  # of too few pages of a host
    rows += [(30, "http://d/1", plain.format("mirror"))] * 2 + [(31, "http://d/2", plain.format("mirror"))]
    # what stands outside the article of three pages goes from an article if it is long enough
    long, short = " ".join(f"s{i}" for i in range(31)), " ".join(f"t{i}" for i in range(20))
    rows += [(40 + i, f"http://e/{i}", f"<div>{long} {short} {i}</div><article>the text {i}</article>") for i in range(3)]
    rows += [(45, "http://e/5", f"<article>all of <p>{long}</p> but {short}</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages).collect()}
    assert got[1] == "Head & tail\nOne two three\nFour" and got[4] == got[5] == "" and got[6] == ("long word é " * 100_000).strip()
    assert [got[10 + i] for i in range(3)] == [f"page number {i}" for i in range(3)]
    assert [got[20 + i] for i in range(2)] == [f"page number {i}\n{line}" for i in range(2)] and got[30] == f"mirror\n{line}"
    assert got[40] == "the text 0" and got[45] == f"all of\nbut {short}"
    assert html_text.extract_main_text(pages).count() == len(rows) and html_text.extract_main_text(pages.limit(0)).count() == 0


def test_html_regions():
    """Class names and forms don't take articles along, and quotations within a paragraph stay."""
    def text(page):
        found = html_text.blocks_of(page)
        return html_text.main_text([t for _, t in found], [r for r, _ in found], None)

    assert text('<main class="content has-sidebar"><p>Hello world text.</p></main>') == "Hello world text."
    assert text("<body><form><div>menu</div><article>The text</article></form></body>") == "The text"
    assert text('<div class="page sidebar-left"><article>Own</article></div>') == "Own"
    page = '<article><div class="article-header"><h1>H</h1></div>one<section class="related-work">two</section>{}</article>'
    assert text(page.format('<div class="related-posts">x</div><div class="comment-list"><article>y</article></div>')) == "H\none\ntwo"
    assert text(page.format('<article class="comment">y</article><form>z</form><div class="share-buttons">v</div>')) == "H\none\ntwo"
    assert text('<article>Own</article><div class="related"><article>Teaser</article></div>') == "Own"
    assert text("<aside><article>Teaser</article></aside><p>Own</p>") == "Own"
    assert text('<body><form><p>mail</p><button>go</button></form></body>') == ""
    long = " ".join(f"w{i}" for i in range(html_text.FORM_WORDS))
    assert text(f'<body><form><nav>n</nav><p>{long}</p></form></body>') == long
    assert text('<div class="no-footer with_sidebar"><p>Own</p></div><div class="site-footer">f</div>') == "Own"


def test_html_quotation(spark):
    quote, foot = " ".join(f"q{i}" for i in range(10)), " ".join(f"f{i}" for i in range(10))
    rows = [(i, f"http://a/{i}", f"<p>page {i} cites {quote} in its midst {i}</p><p>{foot}</p>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages).collect()}
    assert got == {i: f"page {i} cites {quote} in its midst {i}" for i in range(40)}


def test_html_boilerplate(spark, monkeypatch):
    """Boilerplate without telling tags or classes, in pieces and across blocks, against brute force."""
    rng = random.Random(5)
    menus = [[f"m{k}w{i}" for i in range(rng.randint(6, 40))] for k in range(6)]
    rows, streams = [], []
    for i in range(80):
        host, own = rng.choice("pq"), []
        for _ in range(rng.randint(1, 5)):
            own.append([f"u{i}x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 12))])
            menu = rng.choice(menus)
            first = rng.randint(0, len(menu) // 2)
            own.append(menu[first : first + rng.randint(1, 40)])
        rows.append((i, f"https://{host}/{i}", "".join(f"<p>{' '.join(b)}</p>" for b in own)))
        streams.append((host, own))
    width = html_text.WINDOW
    where = collections.defaultdict(set)
    for i, (host, own) in enumerate(streams):
        words = [w for b in own for w in b]
        for k in range(len(words) - width + 1):
            where[host, tuple(words[k : k + width])].add(i)
    expected = {}
    for i, (host, own) in enumerate(streams):
        words = [w for b in own for w in b]
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if len(where[host, tuple(words[k : k + width])]) >= html_text.PAGES:
                gone[k : k + width] = [True] * width
        left, at = [], 0
        for b in own:
            mine, at = gone[at : at + len(b)], at + len(b)
            while b and mine[0]:
                b, mine = b[1:], mine[1:]
            while b and mine[-1]:
                b, mine = b[:-1], mine[:-1]
            left.append(" ".join(b))
        expected[i] = "\n".join(filter(None, left))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages).collect()}
    assert got == expected
    assert sum(len(t) for t in expected.values()) < 0.8 * sum(len(" ".join(w)) for _, o in streams for w in o)


def test_toxicity(spark, docs):
    assert toxicity.fold("Id1ot іdiot 42") == " idiot idiot "
    rows = [(i, f"fine text number {'idiot' if i % 3 == 0 else 'person'} here") for i in range(300)] + [(900, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(texts, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0 and r["doc_id"] < 300) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert toxicity.drop_toxic(texts, labels).count() == 201
    # nulls, repeated rows, other columns of clashing names, long texts, empty tables
    clash = docs.withColumn("score", F.lit(7)).withColumn("toxic", F.lit("x")).unionByName(
        spark.createDataFrame([(5000, "person " * 200_000 + "idiot " * 9, "k", 1, "s", 7, "x")], "doc_id long, text string, key string, anchor int, digest string, score int, toxic string")
    )
    scored = toxicity.score_toxicity(clash, labels).collect()
    assert len(scored) == len(ROWS) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] == 20}) == 1
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns
    assert toxicity.score_toxicity(texts.limit(0), labels).count() == 0 and toxicity.score_toxicity(texts, labels.limit(0)).count() == 301


def test_toxicity_exceptions(spark):
    """A pair of words of clean texts cancels the entry inside it."""
    rows = [(i, f"text {i} you idiot") for i in range(0, 120, 2)] + [(i, f"text {i} idiot savant") for i in range(1, 120, 2)]
    rows += [(i, f"plain text {i}") for i in range(120, 400)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0 and i < 120)) for i, _ in rows], "doc_id long, toxic int")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    entries, exceptions, _ = toxicity.learn(texts, labels)
    assert " idiot " in entries and " idiot savant " in exceptions and " you idiot " not in exceptions
    assert all(r["predicted"] == (r["doc_id"] % 2 == 0 and r["doc_id"] < 120) for r in toxicity.score_toxicity(texts, labels).collect())


def test_toxicity_held_out(spark):
    """Held-out labels of the given table: clean texts stay, and toxic texts are found unless they hold no entry at all."""
    base = "/root/testdata/sf0.1"
    texts, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    own = texts.join(labels.select("doc_id"), "doc_id")
    got = toxicity.score_toxicity(own, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


def test_pipeline(spark, tmp_path):
    """Stage by stage: what each drops is what its operator says, nulls, empty texts and repeated rows included."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    texts = ["Fine text " + " ".join(words[:60]), "fine TEXT " + " ".join(words[:60]), " ".join([*words[60:160], "x"]), " ".join(words[60:160])]
    texts += [None, "", "", "you idiot", "quite long " * 120_000, " ".join(words[170:190])]
    labelled = [(1000 + i, f"fine text number {i} with {'idiot' if i % 3 == 0 else 'person'} and words {i * 7} {i * 11} here") for i in range(300)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in [*enumerate(texts), (9, texts[9]), *labelled]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int((i - 1000) % 3 == 0)) for i in range(1000, 1300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(words[170:190]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = sorted(r["doc_id"] for r in got if r["doc_id"] < 1000)
    # 0 equals 1, 2 is near 3 and of a lesser id, 4 to 6 are empty, 7 is toxic, 9 holds the benchmark's item
    assert kept == [1, 2, 6, 8]
    assert not {r["doc_id"] for r in got} & {i for i, _ in labelled if (i - 1000) % 3 == 0}
    own = {i: (t or "") for i, t, *_ in docs}
    assert all(r["decoded_sha256"] == hashlib.sha256(own[r["doc_id"]].encode()).hexdigest() for r in got)
