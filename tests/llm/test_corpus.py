"""N-gram join, classifier, mixing, packing and the pipeline against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from ffspark.llm import mixing, ngram_join, packing, quality_knn, queries
from ffspark.llm.components import connected_components
from ffspark.llm.shingles import shingle_sets

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, h string, score string"


def docs(spark, texts, ids=None, parts=3):
    rows = [(ids[k] if ids else k, t, None if k % 3 else "en", "s" if k % 2 else None, None, "x", "x", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sets_of(texts, n):
    out = []
    for t in texts:
        w = [x.decode() for x in (t or "").translate(UP).encode().split()]
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def components_of(texts, n, num, den):
    s = sets_of(texts, n)
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(s))], [len(x) for x in s]


def near_texts(seed, groups=6, copies=8):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "one", "ONE", "one two", "one  TWO", "One two three four", "é è", "É è"]
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 160))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            if rng.random() < 0.3:
                w += ["tail"] * rng.randrange(4)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return texts


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_near_groups(spark, n, num, den):
    texts = near_texts(n)
    comp, sizes = components_of(texts, n, num, den)
    got = ngram_join.near_groups(docs(spark, texts), n, num, den).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], comp[r.doc_id])


def test_near_groups_of_one_large_group(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    comp, _ = components_of(texts, 4, 85, 100)
    assert {r.doc_id: r.component_id for r in ngram_join.near_groups(docs(spark, texts, parts=7), 4, 85, 100).collect()} == dict(enumerate(comp))


@pytest.mark.parametrize("block", [1000, 9])
def test_near_links_are_all_counted(spark, monkeypatch, block):
    """Against brute force over all pairs, with groups inside one block and over many of them."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    rng = random.Random(block)
    base = [f"w{k}" for k in range(120)]
    texts = near_texts(3) + [" ".join(["x"] * k + base + ["y"] * k) for k in range(3)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [frozenset(s) for s in sets_of(texts, 4)]
    distinct = {s for s in sets if s}
    want = {k: sum(100 * len(s & y) >= 85 * len(s | y) for y in distinct if y != s) if s else 0 for k, s in enumerate(sets)}
    assert max(want.values()) > 15
    for parts in (1, 5):
        assert {r.doc_id: r.n_links for r in ngram_join.near_groups(docs(spark, texts, parts=parts), 4, 85, 100, count_links=True).collect()} == want


def test_near_components_take_linear_work(spark, monkeypatch):
    """Of one group of distinct near copies, a number of pairs is compared that grows with its size, not its square."""
    compared, verify = [], ngram_join._verify

    def counted(pairs, *rest):
        compared[-1] += pairs.count()
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    for size in (2000, 8000):
        compared.append(0)
        texts = [" ".join([*base[:at], f"v{k}", *base[at + 1 :]]) for k, at in enumerate(rng.choices(range(120), k=size))]
        got = ngram_join.near_groups(docs(spark, texts), 4, 85, 100)
        assert "n_links" not in got.columns and {r.component_id for r in got.select("component_id").distinct().collect()} == {0}
    assert compared[1] < 6 * compared[0] and compared[1] < 200 * 8000, compared


def test_near_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(rows)
    comp, sizes = components_of([rows[d] for d in ids], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == {d: (n, ids[c]) for d, n, c in zip(ids, sizes, comp)} and len(set(comp)) < len(ids)


def test_near_groups_of_templated_texts(spark, monkeypatch):
    """Texts put together from common phrases, with one phrase in all: frequent prefix shingles, many blocks, few links."""
    monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", 3)
    rng = random.Random(12)
    phrases = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(14)]
    texts = [" ".join([phrases[0], *rng.sample(phrases, 7)]) for _ in range(150)] + [" ".join(phrases[:8])] * 40
    comp, _ = components_of(texts, 4, 85, 100)
    assert {r.doc_id: r.component_id for r in ngram_join.near_groups(docs(spark, texts), 4, 85, 100).collect()} == dict(enumerate(comp))


def test_near_pairs_stay_few_with_common_phrases(spark):
    """Twice the texts around one common passage, otherwise their own: no more than in proportion are compared."""
    rng = random.Random(13)
    passage = " ".join(f"c{k}" for k in range(60))
    pairs = []
    for n in (150, 300):
        texts = [passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(n)]
        made = []
        verify = ngram_join._verify
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ngram_join, "_verify", lambda p, *a: made.append(p.count()) or verify(p, *a))
            assert all(r.component_id == r.doc_id for r in ngram_join.near_groups(docs(spark, texts), 4, 85, 100).collect())
        pairs.append(sum(made))
    assert pairs[1] <= 2 * max(pairs[0], 10)


def test_near_edges(spark):
    assert ngram_join.near_groups(docs(spark, ["a"]).limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(200_000))
    got = ngram_join.near_groups(docs(spark, [long, long + " x", long, "a b", "a b", None], [7, 3, None, None, None, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 1, -1), (-1, 1, -1), (-1, 199_996, 3), (3, 199_997, 3), (7, 199_996, 3), (9, 0, 9)]
    clash = docs(spark, ["a b c", "a B c", "d"]).withColumnsRenamed({"node": "__nth", "h": "ref", "score": "key"})
    left = ngram_join.drop_near_copies(clash)
    assert sorted(r.doc_id for r in left.collect()) == [0, 2] and left.columns == clash.columns
    kept = ngram_join.drop_near_copies(docs(spark, [long, long + " x", long, "", None, "b", "b"], [7, 3, 5, 8, 9, 4, 4]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8, 9] and kept.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té\x1c", max_size=40), max_size=12), st.integers(1, 5))
def test_shingle_sets(texts, n):
    got = shingle_sets([t.encode() for t in texts], n)
    want = sets_of(texts, n)
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}


def test_classifier(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "house", "garden"]) for _ in range(60)) + "." for _ in range(60)]
    bad = [" ".join(rng.choice(["$$$", "###", "X!!", "BUY!!", "||"]) for _ in range(60)) for _ in range(60)]
    texts = [x for pair in zip(good, bad) for x in pair] + [None, "", "x" * 300_000]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    rows = quality_knn.quality_scores(docs(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == quality_knn.is_held_out(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 120]
    assert held and all(r.predicted == 1 - r.doc_id % 2 for r in held)
    again = {r.doc_id: r.score for r in quality_knn.quality_scores(docs(spark, texts, parts=1), labels.where("doc_id IS NULL OR crc32(string(doc_id)) % 3 <> 1")).collect()}
    assert again == {r.doc_id: r.score for r in rows}  # held-out labels have no influence
    assert {r.score for r in quality_knn.quality_scores(docs(spark, texts), labels.limit(0)).collect()} == {0.5}
    assert quality_knn.quality_scores(docs(spark, texts).limit(0), labels).count() == 0
    model = quality_knn.train(docs(spark, texts), labels)
    kept = quality_knn.accepted(docs(spark, texts), model)
    assert kept.columns == docs(spark, ["a"]).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    with pytest.raises(ValueError):
        quality_knn.score_documents(docs(spark, texts), model)


def test_labelled_texts_are_bounded_in_bytes(spark):
    texts = ["good words here " * 20] * 30
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    size = len(texts[0])
    assert [len(quality_knn.train(docs(spark, texts), labels, max_bytes=n, held_out=False).labels) for n in (0, 7 * size, 10**9)] == [0, 7, 30]
    assert len(quality_knn.train(docs(spark, texts), labels, max_labelled=4, held_out=False).labels) == 4
    for k in range(30):  # a text above the bound leaves out itself only
        large = [*texts[:k], "good words here " * 2000, *texts[k + 1 :]]
        if k % 10 == 0:
            assert len(quality_knn.train(docs(spark, large), labels, max_bytes=29 * size, held_out=False).labels) == 29


def test_ties_among_neighbours():
    """Of equally near texts the earlier ones vote."""
    texts = [b"the cat sat on the mat"] * 6 + [b"$$$ ### !!!"] * 3
    m = quality_knn.fit(texts, np.array([1, 0, 0, 1, 1, 1, 0, 0, 0]))
    for near, want in ((1, 1.0), (2, 0.5), (3, 1 / 3), (4, 0.5)):
        assert abs(quality_knn.vote(m, [b"the cat sat on the mat"], near)[0] - want) < 1e-6


def brute_scores(texts, labelled):
    """The classifier from its definition: texts by id, labelled [(id, label)] in the sample's order."""
    def measure(t):
        folded = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in t)
        grams = np.zeros(quality_knn.BUCKETS)
        for x, y, z in zip(folded, folded[1:], folded[2:]):
            grams[(((x * 0x9E3779B1) ^ (y * 0x85EBCA6B) ^ (z * 0xC2B2AE35)) * 0x27D4EB2F & 0xFFFFFFFF) >> 22] += 1
        n, words, lines = len(t), t.split(), t.split(b"\n")
        sets = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:-'\"()", b"!?", b"#*$%&|<>=_+@/\\~^{}[]")
        share = [sum(c in x for c in t) / n for x in sets]
        rest = [min(1, v * f) for v, f in zip([1 - sum(share), *share], (1, 1, 3, 5, 3, 5, 5, 10, 10))]
        w = max(1, len(words))
        return grams, [*rest, sum(p == q for p, q in zip(words, words[1:])) / w, 1 - len(set(words)) / w, 1 - len(set(lines)) / len(lines)]

    raw = {k: measure(t) for k, t in texts.items() if t}
    seen = sum((raw[k][0] > 0).astype(float) for k, _ in labelled)
    idf = np.log((1 + len(labelled)) / (1 + seen)) + 1

    def weighed(k):
        g = np.log1p(raw[k][0]) * idf
        return np.concatenate([g / max(np.linalg.norm(g), 1e-9), raw[k][1]])

    axes = np.linalg.svd(np.array([weighed(k) for k, _ in labelled]), full_matrices=False)[2][: quality_knn.DIMS].T
    unit = lambda v: v / np.linalg.norm(v)
    vectors = [(unit(weighed(k) @ axes), y) for k, y in labelled]
    prior = sum(y for _, y in labelled) / len(labelled)
    out = {}
    for k, t in texts.items():
        if not t:
            out[k] = prior
            continue
        v = unit(weighed(k) @ axes)
        near = sorted(((max(float(v @ u), 0), y) for u, y in vectors), key=lambda x: -x[0])[: quality_knn.NEIGHBOURS]
        out[k] = sum(c**8 * y for c, y in near) / sum(c**8 for c, _ in near)
    return out


def labelled_sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").orderBy(F.xxhash64("doc_id")).collect()
    return [(r.doc_id, r.quality) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]


def test_scores_equal_brute_force(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_scores(texts, labelled_sample(spark, sf_dir))
    got = {r.doc_id: r.score for r in queries.op5_quality_classifier(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and np.mean([abs(got[k] - want[k]) < 2e-3 for k in want]) > 0.98


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 105, rng.integers(1, 200)).astype(np.uint8)) for _ in range(90)]
    labels = rng.integers(0, 2, 60)
    m = quality_knn.fit(texts[:60], labels)
    got = quality_knn.vote(m, texts, neighbours=7)
    for t, g in zip(texts, got):
        v = quality_knn.project(quality_knn.features([t]), m.idf, m.axes)[0]
        cos = sorted(((float(v @ u), int(y)) for u, y in zip(m.vectors, labels)), reverse=True)[:7]
        w = [max(c, 0) ** 8 for c, _ in cos]
        assert abs(g - sum(a * y for a, (_, y) in zip(w, cos)) / sum(w)) < 1e-4


def test_accuracy_on_held_out_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op5_quality_classifier(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9


def shares_of(rows, dims, weight):
    out = {d: collections.Counter() for d in dims}
    for r in rows:
        for d in dims:
            out[d][r[d]] += r[weight]
    return out


def test_mixing_meets_its_targets(spark):
    """Given marginals that the cells can reach are met by weights that no cell's tokens are short of."""
    rng = random.Random(6)
    rows = [(s, l, t, rng.randrange(200, 500)) for s in ("a", "b", None) for l in ("en", "fr", None) for t in ("prose", "table")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.5, "b": 0.3, None: 0.2}, "lang": {"en": 0.5, "fr": 0.3, None: 0.2}, "topic": {"prose": 0.6, "table": 0.4}}
    targets = {d: spark.createDataFrame(list(v.items()), f"{d} string, share double") for d, v in want.items()}
    got = mixing.calibrate(cells, targets, keep=0.4, rounds=20).collect()
    total = sum(r[3] for r in rows)
    for d, sums in shares_of(got, mixing.DIMENSIONS, "weight").items():
        assert all(abs(sums[k] / total - 0.4 * x) < 1e-3 for k, x in want[d].items())
    assert len(got) == len(rows) and all(0 <= r.weight <= r.tokens and abs(r.weight - r.probability * r.tokens) < 1e-9 for r in got)


def test_sampled_shares_meet_their_targets(spark):
    """A large source, a tail of small ones, and some that have fewer tokens than their targets: what is drawn has the
    reachable shares, whose definition is computed here by bisection."""
    rng = random.Random(9)
    sizes = {"hot": 400} | {f"s{k}": int(200 * 0.75**k) + 1 for k in range(12)}
    rows = [(s, lang, " ".join(["word"] * rng.randrange(5, 30)), None) for s, n in sizes.items() for lang, w in (("en", 5), ("fr", 2), ("es", 1)) for _ in range(n * w)]
    table = spark.createDataFrame([(k, t, lang, s) for k, (s, lang, t, _) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(table).collect()
    total, tokens = sum(r.n_tokens for r in got), shares_of(got, mixing.DIMENSIONS, "n_tokens")
    kept, drawn = shares_of([r for r in got if r.kept], mixing.DIMENSIONS, "n_tokens"), sum(r.n_tokens for r in got if r.kept)
    expected = {d: collections.Counter() for d in mixing.DIMENSIONS}
    for r in got:
        for d in mixing.DIMENSIONS:
            expected[d][r[d]] += r.n_tokens * r.probability
    assert abs(drawn / total - 0.75) < 0.02 and max(r.probability for r in got) <= 1
    short = 0
    for d in mixing.DIMENSIONS:
        shares = {v: n ** mixing.FLATTEN[d] for v, n in tokens[d].items()}
        wanted = {v: 0.75 * total * x / sum(shares.values()) for v, x in shares.items()}
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(tokens[d][v], w * mid) for v, w in wanted.items()) < 0.75 * total else (lo, mid)
        for v, w in wanted.items():
            short += w > tokens[d][v]
            assert abs(expected[d][v] - min(tokens[d][v], w * lo)) < 0.005 * 0.75 * total
            assert abs(kept[d][v] / drawn - min(tokens[d][v], w * lo) / (0.75 * total)) < 0.015
    assert short


def test_mixing_residuals_on_the_table(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet").groupBy("source", "lang", mixing.topic_of(F.col("text")).alias("topic")).agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    rows = mixing.shares(mixing.calibrate(cells)).collect()
    assert len(rows) > 20 and all(abs(r.expected_share - r.target_share) < 1e-4 for r in rows)


def test_mix_edges(spark):
    texts = [f"word {k} and more" for k in range(200)] + [None, "", "a | b", "Released under the MIT License."]
    long = " ".join(["word"] * 300_000)
    assert [r.n_tokens for r in mixing.mix(docs(spark, [long, "a"])).orderBy("doc_id").collect()] == [300_000, 1]
    got = mixing.mix(docs(spark, texts), keep=0.5).collect()
    assert len(got) == len(texts) and all(0 < r.probability <= 1 for r in got)
    assert {r.doc_id: r.topic for r in got if r.doc_id > 201} == {202: "table", 203: "licence"} and next(r for r in got if r.doc_id == 200).n_tokens == 0
    again = {r.doc_id: r.kept for r in mixing.mix(docs(spark, texts, parts=1), keep=0.5).collect()}
    assert again == {r.doc_id: r.kept for r in got} and 40 < sum(again.values()) < 170
    assert mixing.mix(docs(spark, texts).limit(0)).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).where("kept").count() == 2
    kept = mixing.sample(docs(spark, texts), keep=0.5)
    assert {r.doc_id for r in kept.collect()} == {k for k, v in again.items() if v} and "score" in kept.columns
    clash = docs(spark, texts).withColumnsRenamed({"node": "cell", "h": "chance", "score": "probability"})
    kept = mixing.sample(clash, keep=0.5)
    assert {r.doc_id for r in kept.collect()} == {k for k, v in again.items() if v} and kept.columns == clash.columns


def brute_first_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(capacity)
        out.append((k, capacity - room[k]))
        room[k] -= n
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 20)
    assert list(zip(bins.tolist(), offsets.tolist())) == brute_first_fit(lengths, 20)


def test_word_cache_equals_the_tokenizer():
    rng = random.Random(1)
    parts = ["a", "B", "É", "é", "é", "İ", "ß", "K", "²", "½", "٣", "中", " ", "\x1c", "\x85", "'s", "'T", ".", ",", "..", "!", "’", "_", "1", "23", "\U0001f600", "<|endoftext|>", "<|ENDofText|>", "<|startoftext|>", "<|", " ", "\n", "ﬁ", "́", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["hello, World. it's..", ""]
    from tokenizers import Tokenizer

    cache = packing.WordCache(queries.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(queries.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert cache.encode([t.encode() for t in texts]) == want


@pytest.mark.parametrize("group_docs", [3, 1000])
def test_packing(spark, group_docs):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", " ".join("word" for _ in range(5000))] + [" ".join(rng.choice(["cat", "dog,", "tree"]) for _ in range(rng.randrange(900))) for _ in range(40)]
    rows = packing.pack_documents(docs(spark, texts), queries.tokenizer_path(), group_docs=group_docs).collect()
    check_packing(rows, texts, Tokenizer.from_file(queries.tokenizer_path()))
    assert packing.pack_documents(docs(spark, texts).limit(0), queries.tokenizer_path()).count() == 0
    twice = packing.pack_documents(docs(spark, ["a", "a", "b"], [1, 1, None]), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 2), (1, 2)] and len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_packing_deals_out_copies_and_long_texts(spark):
    """Rows without id, rows that repeat an id and the pieces of one long text don't share a group; little is padded."""
    rng = random.Random(3)
    texts = ["a b"] * 600 + ["c d e"] * 600 + ["word " * 2048 * 300] + [" ".join(["cat"] * rng.randrange(1, 700)) for _ in range(2000)]
    ids = [None] * 600 + [5] * 600 + list(range(10, 2011))
    rows = packing.pack_documents(docs(spark, texts, ids, parts=2), queries.tokenizer_path(), group_docs=200).collect()
    groups = collections.defaultdict(collections.Counter)
    for r in rows:
        groups[r.doc_id][r.sequence_id >> 32] += 1
    assert all(max(groups[k].values()) < 0.25 * sum(groups[k].values()) for k in (None, 5, 10))
    assert sum(r.length for r in rows) > 0.97 * 2048 * len({r.sequence_id for r in rows})


def test_packing_sizes_groups_by_pieces(spark):
    """Few documents with very many pieces make many groups."""
    rows = packing.pack_documents(docs(spark, ["word " * 40_000] * 12), queries.tokenizer_path(), group_docs=50).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) >= 12 * 19 and len(groups) == -(-len(rows) // 50) and max(groups.values()) <= 100


def test_packing_a_long_unbroken_text(spark):
    from tokenizers import Tokenizer

    texts = ["x" * 400_000, "\u4e2d" * 50_000, "a <|endoftext|> b"]
    check_packing(packing.pack_documents(docs(spark, texts), queries.tokenizer_path()).collect(), texts, Tokenizer.from_file(queries.tokenizer_path()))


def check_packing(rows, texts, tokenizer):
    ids = [e.ids + [1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for spans, total in [(sorted(pieces[k]), len(ids[k])) for k in range(len(ids))] + [(sorted(s), None) for s in sequences.values()]:
        at = 0
        for start, length in spans:
            assert start == at
            at += length
        assert at == total or (total is None and at <= 2048)


def brute_mix(rows):
    """Kept ids of {id: (text, source, lang)}: reachable targets by bisection, then scaling of dictionaries."""
    def topic(t):
        return "licence" if "License" in t or "Copyright" in t else "table" if " | " in t else "code" if " = " in t else "prose"

    cell = {k: (s, lang, topic(t or "")) for k, (t, s, lang) in rows.items()}
    n = {k: len((t or "").encode().split()) for k, (t, _, _) in rows.items()}
    tokens, keep = collections.Counter(), 0.75
    for k in rows:
        tokens[cell[k]] += n[k]
    goal, targets, full = keep * sum(tokens.values()), [], []
    for at, d in enumerate(mixing.DIMENSIONS):
        has = collections.Counter()
        for c, t in tokens.items():
            has[c[at]] += t
        share = {v: h ** mixing.FLATTEN[d] for v, h in has.items() if h}
        wanted = {v: goal * x / sum(share.values()) for v, x in share.items()}
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(has[v], w * mid) for v, w in wanted.items()) < goal else (lo, mid)
        targets.append({v: min(has[v], w * lo) for v, w in wanted.items()})
        full.append({v for v, w in wanted.items() if w * lo >= has[v] * (1 - 1e-12)})
    u = dict.fromkeys(tokens, keep)
    everything = {c for c in tokens if any(c[at] in full[at] for at in range(3))}
    for _ in range(mixing.ROUNDS):
        for at in range(3):
            now = collections.Counter()
            for c, t in tokens.items():
                now[c[at]] += t if c in everything else t * min(1, u[c])
            u = {c: u[c] * targets[at].get(c[at], 0) / now[c[at]] if now[c[at]] else u[c] for c in u}
    drawn = lambda k: int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:8], 16) / 2**32
    return {k for k in rows if n[k] == 0 or cell[k] in everything or drawn(k) < u[cell[k]]}


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Every stage keeps what brute force keeps of its own input, with all columns, and packing holds every token."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    extra = lambda df: df.withColumns({c: F.lit("x") for c in ("score", "key", "c0", "cell", "probability")})
    data = extra(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    columns = data.columns
    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r for r in data.collect()}
        out = stage(spark, data, sf_dir)
        out.write.parquet(str(tmp_path / f"s{k}"))
        data = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k == 4:
            break
        after = {r.doc_id: r for r in data.collect()}
        assert data.columns == columns and data.count() == len(after) and all(after[d] == before[d] for d in after)
        ids = sorted(before)
        if name == "exact dedup":
            norm = {d: before[d].text.translate(UP) for d in ids}
            assert set(after) == set({norm[d]: d for d in ids}.values())
        elif name == "n-gram Jaccard join":
            comp, _ = components_of([before[d].text for d in ids], 5, 80, 100)
            assert set(after) == {d for d, c in zip(ids, comp) if ids[c] == d}
        elif name == "mixing":
            assert set(after) == brute_mix({d: (r.text, r.source, r.lang) for d, r in before.items()})
        else:
            want = brute_scores({d: (r.text or "").encode() for d, r in before.items()}, labelled_sample(spark, sf_dir))
            assert all((d in after) == (v >= 0.5) for d, v in want.items() if abs(v - 0.5) > 2e-3)
    ids, rows = sorted(before), data.collect()
    number = {d: k for k, d in enumerate(ids)}
    check_packing([Row(**r.asDict() | {"doc_id": number[r.doc_id]}) for r in rows], [before[d].text for d in ids], Tokenizer.from_file(queries.tokenizer_path()))
    assert {r.doc_id for r in rows} == set(ids)
    one = {(r.doc_id, r.start, r.length) for r in p.run(spark, sf_dir).collect()}
    assert one == {(r.doc_id, r.start, r.length) for r in rows}


def test_no_null_trouble_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    texts = [None, "", "Some text here", "some TEXT here", "x " * 50_000]
    rows = [(k if k != 1 else None, t, None, None, None, "extra") for k, t in enumerate(texts)]
    base = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    out = p.run(spark, base).collect()
    # Without labels all stay; of the empty texts that with an id, of the equal ones the larger id; empty texts are kept
    # whatever the draw.
    assert {0} <= {r.doc_id for r in out} <= {0, 3, 4}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/e/labels.parquet")
    assert p.run(spark, f"{base}/e").count() == 0
