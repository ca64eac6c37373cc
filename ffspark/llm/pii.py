"""Personal data by bootstrapped contextual extraction, in built-in functions only.

1. Seeds: e-mail, IP, card and phone patterns with their checks (the base spans).
2. Candidates: every word with a digit or an at sign. Each has three lexical patterns: the two words before it; its shape
   between the words before and after it; its shape before the next two words.
3. The patterns and the candidates' values form a bipartite graph. Seeds have confidence 1 in their kind; in each round a
   pattern's score is the confidence in its best kind over all of its instances, shrunk by its support, and a value's
   confidence the best score of its patterns. So a pattern that precedes all kinds alike, or look-alikes that fail the
   checks, scores low. Equal edges are merged first, and what many instances look up is spread over parts; no pair of
   instances is ever made.
4. Candidates outside the base spans, with a pattern that scores at least ``accept`` and a form that agrees with the
   seeds of its kind, are added with that kind; of patterns that score alike, the kind last in the alphabet counts.
   Values that don't have the form hand no confidence on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import discard, lookup, materialise
from ffspark.llm.spans import MARKED_TEXTS_SQL, count_kind, cut_sql, listing, marked, matches, unmarked

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. ``++`` and the look-behinds only keep long runs from being tried again at each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a discovered value has in common with the seeds of a kind: an at sign between names, four short parts, or that many
#: digits and no letters; other marks may stand around it.
FORMS = {
    "email": r"[A-Za-z0-9]@[A-Za-z0-9]",
    "ip": r"^[^0-9A-Za-z]*[0-9A-Za-z]{1,3}(\.[0-9A-Za-z]{1,3}){3}[^0-9A-Za-z]*$",
    "card": r"^[^0-9A-Za-z]*[0-9](-?[0-9]){12,18}[^0-9A-Za-z]*$",
    "phone": r"^[^0-9A-Za-z]*[0-9]([().-]*[0-9]){6,14}[^0-9A-Za-z]*$",
}
#: A word that may be an identifier: no white space, at least one digit or at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
ROUNDS, ACCEPT, SUPPORT = 3, 0.8, 5
#: Characters on either side of a candidate that its patterns' words are read from; of longer words the part next to the
#: candidate counts.
CONTEXT_CHARS = 256
#: Values longer than this stand in the graph by their digest.
LONGEST = 64

SPAN = "array<struct<rank:int,start:long,kind:string,end:long>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digit sums added up, divisible by ten."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(at, lambda v: v.isNotNull()), F.lit(0), lambda s, v: s + v) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check that a match must pass."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        n = F.char_length(_digits(value))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        n = F.char_length(_digits(value))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def seeds(text: Column) -> Column:
    """The base spans of a text, by kind as listed, then start."""
    of = lambda rank, kind: F.transform(
        F.filter(matches(marked(text, PATTERNS[kind])), lambda m: holds(kind, m["value"])),
        lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")),
    )
    return F.concat(*[of(rank, kind).cast(SPAN) for rank, kind in enumerate(KINDS)])


def _words(text: Column) -> Column:
    """Words in lower case, digits as 0; marks that stand alone, such as a table's bars, are no words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"[\p{L}0]"))


def shape(value: Column) -> Column:
    """Letters as one a, digits as 0 each; of a long value the digest."""
    drawn = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "0")
    return F.when(F.char_length(drawn) > LONGEST, F.sha2(drawn, 256)).otherwise(drawn)


def lexical_patterns(before: Column, value: Column, after: Column) -> Column:
    """The three patterns of a candidate; ^ and $ stand for missing words."""
    left = lambda n: F.array_join(F.slice(F.concat(F.array_repeat(F.lit("^"), n), _words(before)), -n, n), " ")
    right = lambda n: F.array_join(F.slice(F.concat(_words(after), F.array_repeat(F.lit("$"), n)), 1, n), " ")
    return F.array(F.concat(left(2), F.lit(" _")), F.concat_ws(" ", left(1), shape(value), right(1)), F.concat_ws(" ", F.lit("_"), shape(value), right(2)))


def forms(value: Column) -> Column:
    """The kinds whose form a value has."""
    return F.filter(F.array(*[F.when(value.rlike(FORMS[k]), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())


def _candidates(text: Column) -> Column:
    return F.transform(
        matches(marked(text, CANDIDATE), CONTEXT_CHARS),
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.when(F.char_length(m["value"]) > LONGEST, F.sha2(m["value"], 256)).otherwise(m["value"]).alias("value"),
            lexical_patterns(m["before"], m["value"], m["after"]).alias("patterns"),
            forms(m["value"]).alias("forms"),
        ),
    )


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, doc_id, base spans and candidates of every whole text."""
    text = unmarked(F.coalesce(F.col(text_col), F.lit("")))
    step = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return step.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", seeds(F.col("text")).alias("base"), _candidates(F.col("text")).alias("candidates"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, score from ``edges`` (pattern, value, forms, kind; kind is null unless the value is a seed there).

    Equal edges are merged first, so one value or pattern that fills the corpus counts once per partner. A pattern of
    fewer than ``support`` values scores 0; of kinds that are equally likely the first listed one is taken.
    """
    distinct = materialise(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.min("forms").alias("forms")), "edges")
    graph = distinct.select("pattern", "value", "forms")
    seeds_ = materialise(distinct.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("c", F.lit(1.0)), "seeds")
    confident = seeds_
    for k in range(rounds):
        of = [F.sum(F.when(F.col("kind") == kind, F.col("c")).otherwise(0.0)).alias(kind) for kind in KINDS]
        sums = lookup(graph.drop("forms"), "value", confident, "left").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *of).withColumn("best", F.greatest(*KINDS))
        kind_of = F.coalesce(*[F.when(F.col(kind) == F.col("best"), F.lit(kind)) for kind in KINDS])
        scored = materialise(sums.where((F.col("n") >= support) & (F.col("best") > 0)).select("pattern", kind_of.alias("kind"), (F.col("best") / (F.col("n") + F.lit(1.0 / support))).alias("score")), f"patterns{k}")
        if k < rounds - 1:
            raised = lookup(graph, "pattern", scored).where(F.array_contains("forms", F.col("kind"))).select("value", F.struct(F.col("score").alias("c"), "kind").alias("s"))
            raised = raised.unionByName(seeds_.select("value", F.struct("c", "kind").alias("s"))).groupBy("value").agg(F.max("s").alias("s"))
            confident = materialise(raised.select("value", "s.kind", "s.c"), f"values{k}")
    discard(distinct, seeds_)
    return scored


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans.

    The counts and the digest cover the base spans; ``spans`` has those and the ``n_found`` discovered ones, by kind, then
    start, ``n_spans`` in all. Very long texts are scanned whole. A null text counts as empty and has no spans. Ids may be null or repeated. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    found = materialise(extract(docs, id_col, text_col), "pii")
    covers = lambda c: F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    kind_of = lambda c: F.element_at(F.concat(F.transform(F.filter("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])), lambda s: s["kind"]), F.array(F.lit(None).cast("string"))), 1)
    edges = found.select(F.explode(F.transform("candidates", lambda c: F.struct(c["patterns"].alias("patterns"), c["value"].alias("value"), c["forms"].alias("forms"), kind_of(c).alias("kind")))).alias("e"))
    edges = edges.select(F.explode("e.patterns").alias("pattern"), "e.value", "e.forms", "e.kind")
    good = score_patterns(edges, rounds, support).where(F.col("score") >= accept)
    open_ = found.select("row_key", F.explode(F.filter("candidates", lambda c: ~covers(c) & (F.size(c["forms"]) > 0))).alias("c")).select("row_key", "c.start", "c.end", "c.forms", F.explode("c.patterns").alias("pattern"))
    named = lookup(open_, "pattern", good).where(F.array_contains("forms", F.col("kind"))).groupBy("row_key", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    new = named.select("row_key", F.struct(rank[F.col("best.kind")].alias("rank"), "start", F.col("best.kind").alias("kind"), "end").alias("s"))
    new = new.groupBy("row_key").agg(F.array_sort(F.collect_list("s")).alias("new"))
    out = found.drop("candidates").join(new, "row_key", "left")
    n = [count_kind("base", k) for k in KINDS]
    both = F.array_sort(F.concat("base", F.coalesce(F.col("new").cast(SPAN), F.array().cast(SPAN))))
    n_found = F.coalesce(F.size("new"), F.lit(0)).cast("long")
    return out.select("doc_id", *n, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(both).alias("spans"), n_found.alias("n_found"), (F.size("base") + n_found).alias("n_spans"))


#: The base patterns for engines whose regular expressions look at no context.
PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": PATTERNS["phone"],
}


def oracle_sql(rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> str:
    """``personal_data`` in DuckDB's SQL, round by round; words are cut by position, contexts read from the text."""
    word_list = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '[\p{{L}}0]'))".format
    fits = ", ".join(f"CASE WHEN regexp_matches(v, '{FORMS[k]}') THEN '{k}' END" for k in KINDS)
    short = f"CASE WHEN length({{0}}) > {LONGEST} THEN sha256({{0}}) ELSE {{0}} END".format
    steps, known = [], "seeds"
    for k in range(rounds):
        sums = ", ".join(f"coalesce(sum(c) FILTER (kind = '{kind}'), 0) AS {kind}" for kind in KINDS)
        first = " ".join(f"WHEN {kind} = greatest({', '.join(KINDS)}) THEN '{kind}'" for kind in KINDS)
        best = f"SELECT pattern, count(*) AS n, {sums} FROM edges LEFT JOIN (SELECT value, kind, c FROM {known}) USING (value) GROUP BY pattern"
        steps.append(
            f"patterns{k} AS MATERIALIZED (SELECT pattern, CASE {first} END AS kind, greatest({', '.join(KINDS)}) / (n + 1.0::DOUBLE / {support}) AS score"
            f" FROM ({best}) WHERE n >= {support} AND greatest({', '.join(KINDS)}) > 0)"
        )
        known = f"values{k}"
        both = f"SELECT value, score AS c, patterns{k}.kind AS kind FROM edges JOIN patterns{k} USING (pattern) WHERE list_contains(forms, patterns{k}.kind) UNION ALL SELECT value, c, kind FROM seeds"
        steps.append(f"{known} AS MATERIALIZED (SELECT value, top.c AS c, top.kind AS kind FROM (SELECT value, max({{'c': c, 'kind': kind}}) AS top FROM ({both}) GROUP BY value))")
    graph = ",\n".join(steps[:-1])
    rank = " ".join(f"WHEN '{kind}' THEN {k}" for k, kind in enumerate(KINDS))
    counts = ", ".join(f"count_if(base AND kind = '{kind}')::BIGINT AS n_{kind}" for kind in KINDS)
    return rf"""
WITH texts AS MATERIALIZED ({MARKED_TEXTS_SQL}),
matched AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM ({cut_sql(PLAIN_PATTERNS)})),
spans AS MATERIALIZED (
  SELECT row, rank, kind, start, start + length(v) AS stop FROM matched
  WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) <= 255))
    ELSE length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN digits[-i]::INT WHEN digits[-i]::INT > 4 THEN 2 * digits[-i]::INT - 9 ELSE 2 * digits[-i]::INT END)) % 10 = 0 END),
words AS (SELECT row, start, start + length(v) AS stop, v FROM ({cut_sql({"word": r"[^\x20\x09-\x0D]+"})}) WHERE regexp_matches(v, '[0-9@]')),
contexts AS (
  SELECT row, start, stop, v, regexp_replace(regexp_replace(v, '\p{{L}}+', 'a', 'g'), '[0-9]', '0', 'g') AS drawn,
    ['^', '^'] || {word_list(f"substring(text, greatest(1, start - {CONTEXT_CHARS - 1}), least(start, {CONTEXT_CHARS}))")} AS l,
    {word_list(f"substring(text, stop + 1, {CONTEXT_CHARS})")} || ['$', '$'] AS r
  FROM words JOIN texts USING (row)),
shaped AS (SELECT row, start, stop, {short("v")} AS value, {short("drawn")} AS shape, list_filter([{fits}], lambda k: k IS NOT NULL) AS forms, l[-2] AS l2, l[-1] AS l1, r[1] AS r1, r[2] AS r2 FROM contexts),
candidates AS MATERIALIZED (
  SELECT shaped.row, shaped.start, shaped.stop, any_value(value) AS value, any_value(forms) AS forms, arg_min(kind, rank) AS kind,
    any_value([concat_ws(' ', l2, l1, '_'), concat_ws(' ', l1, shape, r1), concat_ws(' ', '_', shape, r1, r2)]) AS patterns
  FROM shaped LEFT JOIN spans ON spans.row = shaped.row AND spans.start < shaped.stop AND shaped.start < spans.stop GROUP BY ALL),
edges AS MATERIALIZED (SELECT pattern, value, min(kind) AS kind0, min(forms) AS forms FROM (SELECT unnest(patterns) AS pattern, value, kind, forms FROM candidates) GROUP BY pattern, value),
seeds AS MATERIALIZED (SELECT value, min(kind0) AS kind, 1.0::DOUBLE AS c FROM edges WHERE kind0 IS NOT NULL GROUP BY value),
{graph},
named AS (
  SELECT row, start, stop, max({{'score': score, 'kind': p.kind}}).kind AS kind
  FROM (SELECT row, start, stop, forms, unnest(patterns) AS pattern FROM candidates WHERE kind IS NULL) JOIN patterns{rounds - 1} p USING (pattern) WHERE score >= {accept} AND list_contains(forms, p.kind) GROUP BY row, start, stop),
every AS (SELECT row, rank, kind, start, stop, true AS base FROM spans UNION ALL SELECT row, CASE kind {rank} END, kind, start, stop, false FROM named),
listed AS (
  SELECT row, {counts}, count_if(NOT base)::BIGINT AS n_found, count(*) AS n_spans, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY rank, start) AS spans,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY rank, start) FILTER (base) AS own
  FROM every GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_found, 0) AS n_found, coalesce(n_spans, 0) AS n_spans
FROM texts LEFT JOIN listed USING (row)
"""
