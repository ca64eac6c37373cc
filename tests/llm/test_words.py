"""Collocations, spelling variants and licence scans against brute force, and on nulls, ties and very long texts."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ffspark.llm import collocations, license_scan, spelling
from ffspark.llm.shared import materialise
from oracle import rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, langs=None, ids=None):
    rows = [(ids[k] if ids else k, t, langs[k] if langs else "en", "clash", "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, key string, n int").repartition(3)


def by_sql(sql, texts, langs=None, ids=None):
    documents = pd.DataFrame({"doc_id": pd.array(ids or range(len(texts)), "Int64"), "text": pd.array(texts, "string"), "lang": pd.array(langs or ["en"] * len(texts), "string")})
    rel = duckdb.from_df(documents).query("documents", sql)
    return rows_of(rel.fetchall(), list(rel.columns))


def rows(df):
    return rows_of([tuple(r) for r in df.collect()], df.columns)


def collocations_of(texts, langs, min_count=10, percent=50, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in zip(texts, langs, strict=True):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= min_count}
    out = []
    for p, a in found.items():
        if any(len(q) > len(p) and q[0] == p[0] and 100 * b >= percent * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))) for q, b in found.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (counts[p[: k + 1]] * counts[p[:1] + p[k + 1 :]]), k, counts[p[: k + 1]], counts[p[:1] + p[k + 1 :]]) for k in range(1, len(p) - 1))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), l, r))
    want = []
    for lang, group in itertools.groupby(sorted(out), key=lambda x: x[0]):
        want += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (_, s, a, p, l, r) in enumerate(list(group)[:top])]
    return sorted(want)


def phrases(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Über", "a\x01", "tab\x00x", "it's"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for _ in range(rng.randint(0, 120)))
    texts = [text() for _ in range(n)] + [None, "", " . ,", "new york city " * 30, "new york " * 12, " x y " * 15, "x"]
    return texts, [rng.choice(["en", "de", None]) for _ in texts]


@pytest.mark.parametrize("budget", [collocations.BUDGET, 400, 30])
def test_collocations(spark, budget):
    texts, langs = phrases()
    got = collocations.collocations(frame(spark, texts, langs), budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == collocations_of(texts, langs)


def test_collocations_equal_sql_and_keep_the_first(spark):
    texts, langs = phrases(6)
    want = collocations_of(texts, langs, 3, 30, 5)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, texts, langs), 3, 30, 5).collect()) == want
    assert rows(collocations.collocations(frame(spark, texts, langs))) == by_sql(collocations.oracle_sql(), texts, langs)
    assert collocations.collocations(frame(spark, texts).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [None, "", "..."])).count() == 0


def test_heavy_prefixes_are_extended_and_groups_keep_the_budget(spark):
    texts = ["the the the cat sat on the mat the the dog "] * 200 + [f"the v{k} x{k}" for k in range(300)]
    docs = collocations.texts_of(frame(spark, texts))
    words = materialise(collocations.word_counts(docs), "words")
    plan = collocations.vertical_partitions(words, 800)
    assert plan.heavy == {"en": {w.encode() for w in "the cat sat on mat dog".split()}} and plan.groups >= 8
    runs = collocations.packed_suffixes(docs, plan).collect()
    loads = Counter()
    for r in runs:
        loads[r.grp] += len(r.counts) // 4
    assert len(loads) > 3 and max(loads.values()) <= 800


def test_chunks_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    texts = ["alpha beta gamma delta " * 40, "one two. three four, " * 40, "x" * 500 + " y z " * 20, "a b\n" * 60, " " * 200]
    for t in texts:
        data = t.encode().translate(collocations._FOLD)
        got = Counter()
        for main, tail in collocations._chunks(data):
            w = collocations._Words(main, tail)
            d = w.distinct.to_pylist()
            a, b, c, n = w.windows()
            for x in zip(a, b, c, n, strict=True):
                got[(d[x[0]], d[x[1]], d[x[2]] if x[2] >= 0 else b"")] += x[3]
        want = Counter()
        for piece in data.split(b"\n"):
            w = piece.split()
            want.update((w[i], w[i + 1], w[i + 2] if i + 2 < len(w) else b"") for i in range(len(w) - 1))
        assert got == want


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(texts, ids=None):
    counts = Counter()
    for k, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if ids and ids[k] is None else ids[k] if ids else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def garbled(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(["tion", "the", "ing", "ou", "é", "ß", "an", "re", "x"]) for _ in range(rng.randint(3, 6))) for _ in range(60)]

    def word():
        w = rng.choice(stems[: rng.randint(1, len(stems))])
        for _ in range(rng.random() < 0.3):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeéz") + w[i:], w[:i] + rng.choice("aeéz") + w[i + 1 :]])
        return w.capitalize() if rng.random() < 0.2 else w

    return [" ".join(word() for _ in range(rng.randint(0, 150))) for _ in range(80)]


@pytest.mark.parametrize("parts", [spelling.PARTS, 40, 1])
def test_spelling_variants(spark, parts):
    texts = [*garbled(parts), None, "", "1234567", "abcdefg abcdefg, abcdefg×÷ ABCDEFG", "straße" * 2 + " Ångströms Ångströms ångströms"]
    got = spelling.spelling_variants(frame(spark, texts), parts=parts)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(variants_of(texts), key=str)


def test_spelling_variants_equal_sql(spark):
    texts, ids = [*garbled(9), "lettersonly lettersonly", "lettersonly"], None
    ids = [None, 7, 7, *range(3, len(texts))]
    got = spelling.spelling_variants(frame(spark, texts, ids=ids))
    assert rows(got) == by_sql(spelling.oracle_sql(), texts, ids=ids)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(variants_of(texts, ids), key=str)
    assert spelling.spelling_variants(frame(spark, texts).limit(0)).count() == 0
    assert spelling.spelling_variants(frame(spark, [None, "", "1 2 3"])).count() == 0


def test_chains_of_forms_and_very_long_words(spark):
    base = "abcdefghijkl"
    chain = [base[:k] + "z" + base[k:] for k in (3,)] + [base, base[:-1], base[:-2]]
    counts = [2, 20, 300, 3000]
    long = "ab" * 20_000
    words = [(k, w, n) for k, (w, n) in enumerate(zip(chain, counts, strict=True))] + [(10, long, 2), (11, long[:777] + "q" + long[777:], 40), (12, long[:-5] + "q" + long[-4:], 3)]
    table = materialise(spark.createDataFrame(words, "id long, word string, n long"), "words")
    got = {r.word: r for r in spelling.spelling_forms(table).collect()}
    assert [got[w].form for w in chain] == [*chain[1:], None] and {got[w].root for w in chain} == {chain[-1]}
    assert (got[long].form, got[long].n_near) == (words[5][1], 2) and got[words[6][1]].form is None


def test_every_word_has_lists_that_survive_an_edit(spark):
    """Every word longer than seven has three grams with spans apart, every other at least a cut; both within bounds."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 12))) for _ in range(600)})
    table = materialise(spark.createDataFrame(list(enumerate(words)), "id long, word string"), "words")
    grams = spelling.gram_dictionary(table, parts=20)
    assert grams.longer.any() and len(grams.code) <= 4 * spelling.FRACTION * 20
    for size in range(7, 13):
        points = np.array([[ord(c) + 1 for c in w] for w in words if len(w) == size], np.int64) % 4095
        parts = spelling.decompose(points, grams)
        chosen, found = spelling.triples(parts)
        assert found.all() or size == 7
        at = np.flatnonzero(found)
        a, b, c = chosen[at].T
        assert (a + parts.reach[at, a] <= b).all() and (b + parts.reach[at, b] <= c).all()
        s = spelling.sides(parts)
        assert (s.first >= s.last + 2).all() and (s.first <= size - spelling.QMIN).all()


def test_lengths_around_the_borders(spark):
    """Words of seven and eight, and around the length from which words have other lists."""
    rng = random.Random(8)
    words = set()
    for size in (7, 8, spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, spelling.LONG + 2):
        for _ in range(25):
            w = "".join(rng.choice("abc") for _ in range(size))
            i = rng.randrange(size)
            words |= {w, w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    table = materialise(spark.createDataFrame([(k, w, 2) for k, w in enumerate(words)], "id long, word string, n long"), "words")
    want = {tuple(sorted((v, w), key=lambda x: (len(x), x))) for v, w in itertools.combinations(words, 2) if abs(len(v) - len(w)) < 2 and one_edit(v, w)}
    for parts in (spelling.PARTS, 10):
        assert sorted((r.a, r.b) for r in spelling.near_words(table, parts).collect()) == sorted(want)


LICENSED = [
    None, "", "no words of this kind", "MIT License", "mit license mit license", "the apache-license and CC-BY 4.0", "x gnu general public license, MIT license.", "cc by", "ccc by cc bye", "mit licenses",
    "Licensed under CC BY-NC 4.0.", "All rights\nreserved.", "All rights reserved.", " mit license", "MIT\x00LICENSE", "É mit license",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\"), to deal in\nthe Software without restriction",
    "word " * 5000 + "released under the MIT license " + "word " * 5000, "license " * 3000,
]


def licenses_of(text):
    words_in = lambda x: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", x) if w]
    text = (text or "").translate(UPPER)
    words = words_in(text)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base, found, best = {x for _, x in places}, set(), 1.0 if places else 0.0
    steps = license_scan._classes(license_scan.TEMPLATES)
    for scope, runs in (("line", [words_in(x) for x in text.split("\n")]), ("text", [words])):
        for run in runs:
            for s in range(0, max(1, len(run)), steps[scope]):
                block = set(run[s : s + 2 * steps[scope]])
                for t in license_scan.TEMPLATES:
                    own = t.text.split()
                    if (len(own) <= license_scan.SHORT) == (scope == "line") and 100 * len(block & set(own)) >= license_scan.PERCENT * len(set(own)):
                        found.add(t.label)
                        best = max(best, len(block & set(own)) / len(set(own)))
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), best


def test_license_scans(spark):
    rng = random.Random(3)
    vocabulary = license_scan.template_words(license_scan.TEMPLATES) + ["mit license", "cc by", "\n", "."]
    texts = [*LICENSED, *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 300))) for _ in range(30))]
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        texts += [" ".join(words), "noise before " + " ".join(words[:-1]) + " gap " + words[-1], " ".join(words[1:])] + [" ".join(words)] * 2
    df = license_scan.license_labels(frame(spark, texts))
    got = {r.doc_id: tuple(r)[1:8] for r in df.collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == licenses_of(t), t
    assert rows(df) == by_sql(license_scan.oracle_sql(), texts)


def test_license_scans_on_edges(spark):
    texts = ["MIT License", "MIT License", None, "all rights reserved"]
    got = license_scan.license_labels(frame(spark, texts, ids=[None, None, 4, 4])).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == [("4", ""), ("4", "all-rights-reserved"), ("None", "mit"), ("None", "mit")]
    assert license_scan.license_labels(frame(spark, texts).limit(0)).count() == 0
    found = license_scan.find_templates(frame(spark, ["x\nAll rights reserved. y"]), license_scan.template_words(license_scan.TEMPLATES), key="doc_id").first()
    assert (found.start, found.n_words, found.label, found.containment) == (1, 4, "all-rights-reserved", 1.0)
    plan = license_scan.find_templates(frame(spark, texts).withColumn("text", F.lower("text")), license_scan.template_words(license_scan.TEMPLATES), key="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
