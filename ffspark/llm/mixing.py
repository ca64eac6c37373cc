"""Mixing sources to target weights by iterative proportional fitting.

The corpus is summed up to cells (source, language, topic) of tokens. Raking scales a cell's inclusion ratio u so that
the kept tokens meet the target of each source, each language and each topic in turn. A cell can't give more than it
has, so its kept weight is tokens * min(1, u): what a full cell can't give is taken from others until the sums hold
again. A document is then kept with its cell's probability min(1, u), decided by a hash of its id, so the expected
shares are the targets and nothing is cut off afterwards.

Targets are what can be reached: a source (language, topic) with fewer tokens than its share of the kept ones gives all
it has, and the others of its dimension share the rest in proportion. ``shares`` lists wanted, reachable and expected
shares.

Cells go through windows over one dimension at a time: their number is that of the sources times languages times
topics, however many documents there are, and no document is in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ffspark.llm.shared import WORD_CLASS, discard, fresh, lookup, materialise

DIMENSIONS = ("source", "lang", "topic")
#: Marginal targets are the dimension's own token share to this power, renewed to a sum of 1: 1 keeps it, 0 is uniform.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS, KEEP = 8, 0.75
#: Rounds in one job; the state is written after each.
ROUNDS_A_JOB = 4
#: Most cells that are sent to every executor; more are joined by shuffling.
MAX_SENT = 100_000
#: Topics are registers that a text's marks show; the first that fits counts, see ``topic_of``.
TOPICS = (("licence", ("License", "Copyright")), ("table", (" | ",)), ("code", (" = ",)))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")


def topic_of(text: Column, topics: tuple[tuple[str, tuple[str, ...]], ...] = TOPICS) -> Column:
    """The first of ``topics`` (name, marks) of which the text holds a mark, else prose."""
    out = F.lit("prose")
    for name, marks in reversed(topics):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks]), name).otherwise(out)
    return out


def _key(values: list[Column]) -> Column:
    """A cell's name: its values with their lengths, so that nulls and any text stay apart."""
    return F.concat(*[F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def calibrate(cells: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS, flatten: dict[str, float] = FLATTEN) -> DataFrame:
    """``cells`` (dimensions, tokens), one row each, with ``weight``, the tokens to keep, ``probability``, and for each
    dimension d ``wanted_d`` and ``target_d``, the tokens to keep of the cell's value.

    ``targets`` maps a dimension to a table (dimension, share); other dimensions get flattened shares of their own
    tokens. A value without target share keeps nothing. Nulls are values like others. Cells of no tokens have weight 0
    and probability 1. The driver gets sums only.
    """
    state = cells.select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"))
    for d in DIMENSIONS:
        state = state.withColumn(f"has_{d}", F.sum("tokens").over(Window.partitionBy(d)))
        if targets and d in targets:
            share = targets[d].select(F.col(d).alias("value"), F.col("share").cast("double").alias(f"share_{d}"))
            state = state.join(share, state[d].eqNullSafe(share["value"]), "left").drop("value")
        else:
            state = state.withColumn(f"share_{d}", F.pow(f"has_{d}", F.lit(flatten.get(d, 1.0))))
        # The cells of a value share out what holds for the value, so that sums over cells are sums over values.
        state = state.withColumn(f"share_{d}", F.when(F.col(f"has_{d}") > 0, F.coalesce(f"share_{d}", F.lit(0.0))).otherwise(0.0))
    state = materialise(state, "cells")
    part = lambda c, d: F.when(F.col(f"has_{d}") > 0, c * F.col("tokens") / F.col(f"has_{d}")).otherwise(0.0)
    sums = state.agg(F.sum("tokens").alias("tokens"), *[F.sum(part(F.col(f"share_{d}"), d)).alias(d) for d in DIMENSIONS]).first()
    goal = keep * (sums.tokens or 0.0)
    for d in DIMENSIONS:
        state = state.withColumn(f"wanted_{d}", F.col(f"share_{d}") * F.lit(goal / sums[d] if sums[d] else 0.0))

    scale, full, before = dict.fromkeys(DIMENSIONS, 1.0), {}, None
    while True:
        full = {d: F.col(f"wanted_{d}") * F.lit(scale[d]) >= F.col(f"has_{d}") for d in DIMENSIONS}
        found = state.agg(
            *[F.count_if(full[d]).alias(f"n_{d}") for d in DIMENSIONS],
            *[F.sum(F.when(full[d], F.col("tokens")).otherwise(0.0)).alias(f"full_{d}") for d in DIMENSIONS],
            *[F.sum(F.when(full[d], 0.0).otherwise(part(F.col(f"wanted_{d}"), d))).alias(f"open_{d}") for d in DIMENSIONS],
        ).first()
        now = [found[f"n_{d}"] for d in DIMENSIONS]
        if now == before:
            break
        before = now
        scale = {d: (goal - found[f"full_{d}"]) / found[f"open_{d}"] if found[f"open_{d}"] else scale[d] for d in DIMENSIONS}
    for d in DIMENSIONS:
        state = state.withColumn(f"target_{d}", F.least(f"has_{d}", F.col(f"wanted_{d}") * F.lit(scale[d])))

    state = state.withColumn("all", reduce(lambda a, b: a | b, [full[d] for d in DIMENSIONS])).withColumn("u", F.lit(float(keep)))
    state = state.select(*DIMENSIONS, "tokens", "all", "u", *[f"{k}_{d}" for k in ("wanted", "target") for d in DIMENSIONS])
    weight = F.when(F.col("all"), F.col("tokens")).otherwise(F.col("tokens") * F.least(F.lit(1.0), F.col("u")))
    for k in range(rounds):
        for d in DIMENSIONS:
            total = F.sum(weight).over(Window.partitionBy(d))
            state = state.withColumn("now", total).withColumn("u", F.when(F.col("now") > 0, F.col("u") * F.col(f"target_{d}") / F.col("now")).otherwise(F.col("u"))).drop("now")
        if k == rounds - 1 or k % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            old, state = state, materialise(state, f"rake{k}")
            discard(old)
    chance = F.when((F.col("tokens") == 0) | F.col("all"), 1.0).otherwise(F.least(F.lit(1.0), F.col("u")))
    return state.withColumn("weight", weight).withColumn("probability", chance)


def shares(state: DataFrame) -> DataFrame:
    """dimension, value, wanted_share, target_share, expected_share of all tokens to keep, from the cells of ``calibrate``.
    ``target_share`` differs from ``wanted_share`` where a value hasn't enough tokens, and for the others that make up
    for it."""
    goal = state.agg(F.sum("weight")).first()[0] or 0.0
    parts = []
    for d in DIMENSIONS:
        of = state.groupBy(F.col(d).cast("string").alias("value")).agg(F.max(f"wanted_{d}").alias("wanted"), F.max(f"target_{d}").alias("target"), F.sum("weight").alias("expected"))
        parts.append(of.select(F.lit(d).alias("dimension"), "value", *[F.try_divide(F.col(c), F.lit(goal)).alias(f"{c}_share") for c in ("wanted", "target", "expected")]))
    return reduce(DataFrame.unionByName, parts)


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) fixed by the id: the first 32 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _with_chance(rows: DataFrame, state: DataFrame, cell: str, chance: str) -> DataFrame:
    """``rows`` with a column ``chance``, the probability of the cell that their column ``cell`` names."""
    known = state.select(_key([F.col(d) for d in DIMENSIONS]).alias(cell), F.col("probability").alias(chance))
    return rows.join(F.broadcast(known), cell) if state.count() <= MAX_SENT else lookup(rows, cell, known)


def _rows(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> tuple[list[Column], Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    topic = F.col(topic_col) if topic_col else topic_of(text)
    return [c.cast("string").alias(d) for c, d in zip((F.col(source_col), F.col(lang_col), topic), DIMENSIONS, strict=True)], token_count(text).alias("n_tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, probability, kept.

    Tokens are words, counted over whole texts of any length. Texts without words (null and empty ones too) weigh nothing, have probability 1 and are kept. Null
    sources, languages and topics are values of their own. Rows that repeat an id share one draw, so equal draws never
    depend on order. An empty table gives an empty result. Other columns are ignored, whatever their names. Without
    ``topic_col`` the topic is read from the text.
    """
    dims, tokens = _rows(docs, text_col, source_col, lang_col, topic_col)
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), *dims, tokens), "mix")
    state = calibrate(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), targets, keep, rounds)
    out = _with_chance(rows.withColumn("cell", _key([F.col(d) for d in DIMENSIONS])), state, "cell", "probability")
    chance = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("probability"))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", chance.alias("probability"), (draw(F.col("doc_id")) < chance).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, all columns unchanged. The texts aren't moved."""
    dims, tokens = _rows(docs, text_col, source_col, lang_col, topic_col)
    cells = docs.select(*dims, tokens).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    state = calibrate(cells, targets, keep, rounds)
    cell, chance = fresh(docs, "cell", "chance")
    out = _with_chance(docs.withColumn(cell, _key(dims)), state, cell, chance)
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(WORD_CLASS)
    return out.where(~has_words | (draw(F.col(id_col)) < F.col(chance))).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """The same in DuckDB: reachable targets by sorting the values of each dimension by how soon they are full, and one
    recursion step for each scaling of one dimension."""
    wanted, targets = [], []
    for d in DIMENSIONS:
        wanted.append(f"""w_{d} AS (SELECT v, has, share / sum(share) OVER () * (SELECT keep FROM g) AS wanted
          FROM (SELECT {d} AS v, sum(tokens)::DOUBLE AS has, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {FLATTEN[d]}) ELSE 0 END AS share FROM c GROUP BY 1))""")
        targets.append(f"""f_{d} AS (SELECT *, wanted > 0 AND has / wanted <= ((SELECT keep FROM g) - coalesce(sum(has) OVER o, 0)) / ((SELECT keep FROM g) - coalesce(sum(wanted) OVER o, 0)) AS is_full
          FROM w_{d} WINDOW o AS (ORDER BY CASE WHEN wanted > 0 THEN has / wanted ELSE 1e300 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t_{d} AS MATERIALIZED (SELECT v, is_full, CASE WHEN is_full THEN has ELSE wanted * (SELECT ((SELECT keep FROM g) - coalesce(sum(has) FILTER (is_full), 0)) / sum(wanted) FILTER (NOT is_full) FROM f_{d}) END AS target FROM f_{d})""")
    joins = " ".join(f"JOIN t_{d} {d[0]} ON c.{d} IS NOT DISTINCT FROM {d[0]}.v" for d in DIMENSIONS)
    of = lambda x: f"CASE k % 3 WHEN 0 THEN {x[0]} WHEN 1 THEN {x[1]} ELSE {x[2]} END"
    kept = "CASE WHEN is_all THEN tokens ELSE tokens * least(1.0::DOUBLE, u) END"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains(x, 'License') OR contains(x, 'Copyright') THEN 'licence' WHEN contains(x, ' | ') THEN 'table'
             WHEN contains(x, ' = ') THEN 'code' ELSE 'prose' END AS topic, len(regexp_extract_all(x, '[^ \t\n\v\f\r]+'))::BIGINT AS n_tokens
      FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
      c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
      g AS MATERIALIZED (SELECT {keep}::DOUBLE * sum(tokens) AS keep FROM c), {', '.join(wanted)}, {', '.join(targets)},
      step AS (
        SELECT 0 AS k, source, lang, topic, tokens, {keep}::DOUBLE AS u, s.is_full OR l.is_full OR t.is_full AS is_all, s.target AS ts, l.target AS tl, t.target AS tt FROM c {joins}
        UNION ALL
        SELECT k + 1, source, lang, topic, tokens, CASE WHEN now > 0 THEN u * {of(('ts', 'tl', 'tt'))} / now ELSE u END, is_all, ts, tl, tt
        FROM (SELECT *, sum({kept}) OVER (PARTITION BY {of(('source', 'lang', 'topic'))}) AS now FROM step WHERE k < {3 * rounds})),
      p AS (SELECT source, lang, topic, CASE WHEN tokens = 0 OR is_all THEN 1.0 ELSE least(1.0::DOUBLE, u) END AS probability FROM step WHERE k = {3 * rounds}),
      r AS (SELECT doc_id, d.source, d.lang, d.topic, n_tokens, CASE WHEN n_tokens = 0 THEN 1.0 ELSE probability END AS probability FROM d
            JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic)
      SELECT * REPLACE (round(probability, 6) + 0.0 AS probability), ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296 < probability AS kept FROM r"""
