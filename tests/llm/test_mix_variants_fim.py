"""Mixing, spelling variants and fill-in-middle against plain versions, with nulls, empty and long texts, ties, repeated
rows, empty tables and further columns of clashing names."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import fim, mixing, variants

LETTERS = "abcdeé"
RARE = ["wordforms", "wordform", "wordfarms", "wxordforms", "ordforms", "z" * 60, "z" * 61, "z" * 30 + "y" + "z" * 30]
TEXTS = [None, "", " \t ", "one", "wordforms " * 40, "Wordforms WORDFORMS", " ".join(RARE), "a<P>b", "<S>", "é𝒳" * 200]
TEXTS += [" ".join((LETTERS * 3)[i % 5 : i % 5 + 7 + i % 3] for i in range(j, j + 30)) for j in range(40)]
TEXTS += [f" lead ing {i} wordform  wordforms\n" * (i % 4) for i in range(60)] + ["x <P" * 50, "<<<" * 9, "long " * 60_000]
TEXTS += ["chainlinkcc " * 16 + "chainlinkbc " * 4 + "chainlinkbb "] * 6  # a form of a form
ROWS = [(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(TEXTS)]
ROWS += [(6, TEXTS[6], "s1")] * 2 + [(None, TEXTS[4], "s1"), (None, None, None), (None, TEXTS[4], "s1"), (-5, "b a", "é")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "k", 1, 2.0, "p") for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, part int, size double, word string").repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def counted(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by handing the excess on until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_weight = sum(w for s, w in weight.items() if s not in full)
        found = {s: most * sizes[s] if s in full else rest * w / open_weight for s, w in weight.items()}
        above = {s for s in names if s not in full and found[s] > most * sizes[s]}
        if not above:
            return found
        full |= above


@pytest.mark.parametrize("weights", [(3, 1, 2), (1, 50)])
def test_mix(docs, weights):
    got = mixing.mix(docs, weights=weights).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, counted(t)) for i, t, _ in ROWS)
    sizes = collections.Counter()
    for _, t, s in ROWS:
        sizes[s] += counted(t)
    want, taken = filled(sizes, weights), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    for s in sizes:  # whole rounds, then a start of the order by key
        own = sorted((r for r in got if r.source == s), key=lambda r: r.place)
        rounds = round(want[s]) // max(1, sizes[s])
        ends = [r.taken - rounds * r.size for r in own if r.size]
        assert sum(0 < e < r.size for e, r in zip(ends, (r for r in own if r.size), strict=True)) <= 1
        assert [r.place for r in own] == [sum(x.size for x in own[:i]) for i in range(len(own))]
    assert rows_of(mixing.mix(docs.repartition(2), weights=weights)) == rows_of(mixing.mix(docs, weights=weights))


def test_mixed_texts(docs):
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    texts, got = {i: t for i, t, _ in ROWS}, collections.Counter()
    for r in mixing.mixed_texts(docs).collect():
        assert r.words == counted(r.text)
        if r.doc_id is not None:
            assert texts[r.doc_id].lstrip(mixing.SPACES).startswith(r.text.lstrip(mixing.SPACES))
        got[r.doc_id] += r.words
    assert {i: n for i, n in plan.items() if n} == got


def test_mix_of_nothing(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def plain_variants(rows, length=7, times=2, ratio=10, drop_in=31):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % drop_in == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= times}
    near = {w: {v for v in words if one_edit(w, v)} for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize(("limit", "block"), [(20_000, 60_000), (3, 10)])
def test_variants(docs, monkeypatch, limit, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "PAIRS", block)
    for drop_in, times, ratio in ((31, 2, 10), (3, 1, 2)):
        got = variants.spelling_variants(docs, limit=limit, drop_in=drop_in, times=times, ratio=ratio)
        want = plain_variants([r[:2] for r in ROWS], drop_in=drop_in, times=times, ratio=ratio)
        assert rows_of(got) == want and any(w[1] for w in want)
        assert any(w[1] != w[2] for w in want if w[1]) or ratio == 10
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_vectors_of_near_words_differ_by_one_surplus_and_one_deficit():
    a = variants.vectors(["wordforms", "wordform", "wordfarms", "z" * 60, "z" * 61])
    counts = [[v >> 5 * g & 31 for g in range(variants.GROUPS)] for v in a.tolist()]
    for x, y in ((0, 1), (0, 2), (3, 4)):
        d = [p - q for p, q in zip(counts[x], counts[y], strict=True)]
        assert sum(e for e in d if e > 0) <= 1 and -sum(e for e in d if e < 0) <= 1


def plain_fim(doc_id, text, seed=1):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [1 << 16, 1, 3])
def test_fill_in_middle(docs, monkeypatch, unit):
    monkeypatch.setattr(fim, "UNIT", unit)
    chosen = docs if unit > 3 else docs.where("length(text) < 3000 or text is null")
    kept = [r for r in ROWS if unit > 3 or len(r[1] or "") < 3000]
    want = [plain_fim(i, t) for i, t, _ in kept]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fim.fill_in_middle(chosen).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert rows_of(got) == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t, _) in zip(want, kept, strict=True)), key=str)
    got = fim.texts(chosen).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert rows_of(got) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0 and fim.texts(docs.limit(0)).count() == 0


def test_a_second_sort_needs_no_second_shuffle(docs):
    plan = fim.fill_in_middle(docs.select("doc_id", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
