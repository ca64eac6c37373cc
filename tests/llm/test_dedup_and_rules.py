import hashlib
import random
import re

import pytest

from ffspark.llm import exact_dedup, quality_rules, queries
from oracle import assert_same

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, norm string"


def docs(spark, texts, ids=None, parts=3):
    rows = [(ids[k] if ids else k, t, None, "s" if k % 2 else None, None, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


TEXTS = ["Abc def", "aBC DEF", "abc  def", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "Straße", "STRASSE", "K", "k", "a\U0001f600", "A\U0001f600", " ", "Abc def"]


@pytest.mark.parametrize("salts", [1, 4])
def test_exact_groups(spark, salts):
    got = exact_dedup.exact_groups(docs(spark, TEXTS), salts=salts).collect()
    norm = [(t or "").translate(UP) for t in TEXTS]
    assert len(got) == len(TEXTS)
    for r in got:
        same = [k for k, n in enumerate(norm) if n == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_groups_edges(spark):
    assert exact_dedup.exact_groups(docs(spark, TEXTS).limit(0)).count() == 0
    got = exact_dedup.exact_groups(docs(spark, ["a", "a", "a", "b", "b", "c"], [1, 1, None, None, None, 5])).collect()
    assert sum(r.kept for r in got) == 3 and len(got) == 6
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 3), (None, 2), (5, 1)}
    kept = exact_dedup.drop_exact_copies(docs(spark, ["a", "A", "a", "b", "b", "c"], [1, 2, 2, None, None, 5])).collect()
    assert sorted((r.doc_id or 0, r.text.lower(), r.norm) for r in kept) == [(0, "b", "clash"), (2, "a", "clash"), (5, "c", "clash")]


def test_rows_without_id_are_salted(spark):
    """Very many rows of one text without ids meet in no single group, and one of them stays."""
    rows = [(None, "same Text", k) for k in range(600)] + [(None, "other", 1), (3, "other", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(5)
    got = exact_dedup.exact_groups(df).collect()
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in got if r.kept) == [("3", 2, True), ("None", 600, True)] and len(got) == 602
    assert sorted(r.text for r in exact_dedup.drop_exact_copies(df).collect()) == ["other", "same Text"]
    twins = spark.createDataFrame([(None, "a", 1)] * 4, "doc_id long, text string, place int")
    assert [r.kept for r in exact_dedup.exact_groups(twins).collect()].count(True) == 1


def repeat_words(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def brute_measures(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(words))


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [*TEXTS[:7], "a b c d e a b c d e", "x x x x x x x", "one\n\none\n one\none\f\nz", "the # & cat | sat on <b>", "\U0001f600 a\u0085b \x1c c", "a b c d"]
    texts += [" ".join(rng.choice("ab") + rng.choice("cd") for _ in range(rng.randrange(40))) for _ in range(30)]
    texts.append("The cat sat on the mat and it was a good day for us. " + " ".join(f"word{k}" for k in range(60)) + " of the of the of the")
    got = quality_rules.quality_verdicts(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert next(r for r in got if r.doc_id == len(texts) - 1).kept


def test_quality_long_text_and_empty_table(spark):
    long = " ".join(f"w{k % 4001}" for k in range(40_000))
    (r,) = quality_rules.quality_verdicts(docs(spark, [long])).collect()
    assert r.n_words == 40_000 and r.n_repeat_words == 40_000 and r.base_failed
    assert quality_rules.quality_verdicts(docs(spark, ["a"]).limit(0)).count() == 0


def test_quality_uses_no_python(spark):
    plan = quality_rules.quality_verdicts(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir)
