"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is an integer and every rule compares ``scale * measure`` with ``limit * base``, so no rounding decides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import SPACE_CLASS, WORD_CLASS


class Rule(NamedTuple):
    name: str
    measure: str
    op: str  # the document fails if  100 * measure  op  percent * base
    percent: int
    base: str
    min_words: int = 0  # the rule looks at texts of at least so many words


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by this from or an at "
    "der die das und in zu den von mit sich des auf ist im dem nicht ein eine als auch es an werden aus er "
    "le la les de des du et en un une que qui dans pour par sur pas au est ce il avec ne se plus "
    "el los las del y a una con no su lo como para al por o más pero sus"
).split()

#: The base rules fix ``base_failed``; the others give the method's own verdict.
BASE_RULES = (
    Rule("too_few_words", "n_words", "<", 1000, "one"),
    Rule("repeated_passages", "n_repeat_words", ">", 20, "n_words"),
)
RULES = (
    Rule("symbol_ratio", "n_symbols", ">", 5, "word_chars"),
    Rule("short_words", "word_chars", "<", 200, "n_words"),
    Rule("long_words", "word_chars", ">", 2000, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", ">", 50, "n_lines"),
    Rule("few_stop_words", "n_stop_words", "<", 3, "n_words", 40),
)


def failing(rules: tuple[Rule, ...]) -> Column:
    """True if any rule of the table fails."""
    out = F.lit(False)
    for r in rules:
        left, right = 100 * F.col(r.measure), r.percent * (F.lit(1) if r.base == "one" else F.col(r.base))
        out = out | ((F.col("n_words") >= r.min_words) & (left > right if r.op == ">" else left < right))
    return out


def _repeat_words(grams: Column) -> Column:
    """Words inside 5-word windows that occur twice or more: sort the windows' digests with their places, keep the
    places whose digest also stands beside them, and add up how far each window reaches beyond the one before."""
    place = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    first, last = F.slice(place, 1, F.size(place) - 1), F.slice(place, 2, F.size(place) - 1)
    both = F.flatten(F.zip_with(first, last, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(both))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """doc_id and the integer measures of every whole text. Windows are compared by chained 64-bit hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CLASS))
    step = docs.select(
        F.col(id_col).alias("doc_id"),
        F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "").alias("words"),
        line.alias("lines"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    n = F.size("h")
    step = step.withColumn("g2", F.when(n >= 5, pair(F.slice("h", 1, n - 1), F.slice("h", 2, n - 1))))
    step = step.withColumn("g4", F.when(n >= 5, pair(F.slice("g2", 1, n - 3), F.slice("g2", 3, n - 3))))
    step = step.withColumn("g5", F.when(n >= 5, pair(F.slice("g4", 1, n - 4), F.slice("h", 5, n - 4)))).drop("h", "g2", "g4")
    step = step.withColumn("starts", F.when(F.size("g5") > F.size(F.array_distinct("g5")), _repeat_words(F.col("g5")))).drop("g5")
    before = F.concat(F.array(F.lit(-5)), F.slice("starts", 1, F.size("starts") - 1))
    reach = F.aggregate(F.zip_with("starts", before, lambda a, b: F.least(F.lit(5), a - b)), F.lit(0), lambda s, v: s + v)
    return step.withColumn("n_repeat_words", F.coalesce(F.when(F.size("starts") > 0, reach), F.lit(0)).cast("long")).drop("starts")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base_rules: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept.

    A null or empty text has no words and fails. Very long texts are measured whole. Measures are integers, so no ties
    arise. Ids may be null or repeated; each row is judged on its own text. An
    empty table gives an empty result. Other columns are ignored.
    """
    m = measures(docs, id_col, text_col)
    base = failing(base_rules)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~failing(rules)).alias("kept"), "n_lines", "n_stop_words"
    )


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(string_split_regex(x, '[ \\t\\n\\v\\f\\r]+'), lambda y: y <> '') AS words,
             list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^ \\t\\n\\v\\f\\r]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i:i+4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(least(5, i - coalesce(p, i - 5))) AS n FROM
      (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda y: lower(y) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 5 * word_chars OR 100 * word_chars < 200 * n_words
           OR 100 * word_chars > 2000 * n_words OR 100 * n_dup_lines > 50 * n_lines
           OR (n_words >= 40 AND 100 * n_stop_words < 3 * n_words)) AS kept, n_lines, n_stop_words
FROM b
"""
