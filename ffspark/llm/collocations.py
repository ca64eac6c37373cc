"""Phrase collocations by vertical partitioning: word prefixes are grouped by a memory budget, a suffix subtree cut off at
three words is built for each group by itself, and phrase counts are read from the totals of its leaves.

1. Prefix frequencies: every task counts its words, Spark adds the counts up. A word whose suffixes would fill too much of
   a group is a heavy prefix and is extended by its next word; if that is heavy too, by a third. A pair is no more
   frequent than the rarer of its words, so no prefix fills more of a group than a light word may, but for single leaves.
2. Groups: prefixes are dealt to as many groups a language as keep the largest load of words within the budget.
3. Suffixes (three words, fewer at the end of a piece) are combined in each task and travel as sorted, packed runs, one for
   each group and batch; a group's task merges its runs into leaves and adds those up to the nodes above.

Counts are exact, and no step gathers more than a budget's worth of suffixes in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ffspark.llm.shared import arrow_batches, discard, lookup, materialise

#: Suffixes (by their number of occurrences) that a group's subtree may hold.
BUDGET = 2_000_000
#: A prefix is heavy above this part of the budget; a budget is raised until at most so many prefixes can be heavy.
SHARE, MAX_HEAVY = 8, 1_000_000
#: Texts are cut up in chunks of about this size.
CHUNK = 4 << 20
#: Ranks are first made in so many parts of a language.
RANK_PARTS = 64
_STEP = 1_000_003
_MASK = (1 << 31) - 1

#: A-Z become a-z, a tab a space, and each mark that ends a piece a line feed.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of folded bytes and, where a chunk ends inside a piece, the two words that follow it."""
    at = 0
    while at < len(data):
        to = at + CHUNK
        if to >= len(data):
            yield data[at:], b""
            return
        cut = data.rfind(b"\n", at, to)
        if cut < 0:
            cut = data.find(b" ", to)
            line = data.find(b"\n", to, cut if cut >= 0 else len(data))
            cut = line if line >= 0 else (cut if cut >= 0 else len(data))
        end, words = cut, 0
        while words < 2 and end < len(data) and data[end] != 10:
            start = end
            while start < len(data) and data[start] == 32:
                start += 1
            stop = start
            while stop < len(data) and data[stop] != 32 and data[stop] != 10:
                stop += 1
            end, words = stop, words + (stop > start)
        yield data[at:cut], data[cut:end]
        at = cut


def _tokens(data: bytes) -> list[bytes]:
    return [w for w in data.replace(b"\n", b" \n ").split(b" ") if w]


class _Words:
    """The words of a chunk as places in a list of distinct ones; -1 stands between pieces. The last ``tail`` places only
    follow the chunk's own words."""

    def __init__(self, main: bytes, tail: bytes):
        own, after = _tokens(main), _tokens(tail)
        coded = pa.array([*own, *after], pa.binary()).dictionary_encode()
        self.distinct = coded.dictionary
        ids = coded.indices.to_numpy().astype(np.int64)
        line = pc.index(self.distinct, b"\n").as_py()
        self.ids = np.where(ids == line, -1, ids) if line >= 0 else ids
        self.own = len(own)

    def counts(self) -> tuple[pa.Array, np.ndarray]:
        n = np.bincount(self.ids[: self.own][self.ids[: self.own] >= 0], minlength=len(self.distinct))
        at = np.flatnonzero(n)
        return self.distinct.take(pa.array(at)), n[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of two or three words that begin inside the chunk: first, second, third (-1: the piece ends)
        and how often."""
        ids, n = np.concatenate((self.ids, [-1, -1])), self.own
        a, b, c = ids[:n], ids[1 : n + 1], ids[2 : n + 2]
        ok = (a >= 0) & (b >= 0)
        width = len(self.distinct) + 1
        pairs, at = np.unique(a[ok] * width + b[ok], return_inverse=True)
        triples, count = np.unique(at * width + (c[ok] + 1), return_counts=True)
        pair = pairs[triples // width]
        return pair // width, pair % width, triples % width - 1, count


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Words]]:
    """lang and words of every chunk of the texts (lang, text); texts of one language are taken together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).dictionary_encode()
        texts = batch.column(1).cast(pa.binary())
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            joined = b"\n".join(texts.filter(pc.equal(langs.indices, k)).to_pylist()).translate(_FOLD)
            for main, tail in _chunks(joined):
                if main:
                    yield lang, _Words(main, tail)


def _text(words: pa.Array) -> pa.Array:
    return words.cast(pa.string())


def _added(held: list[pa.Table], keys: list[str]) -> pa.Table:
    table = pa.concat_tables(held)
    return table.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


#: Counts that a task holds before it hands them on.
HELD = 1_000_000


def _combined(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of one task added up, in portions of at most about ``HELD`` rows."""
    held, rows = [], 0
    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows > HELD:
            held = [_added(held, keys)]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held, rows = [], 0
    if held:
        yield from _added(held, keys).to_batches(max_chunksize=50_000)


def texts_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, f: all word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for lang, words in _batches(batches):
                word, n = words.counts()
                yield pa.table({"lang": pa.array([lang] * len(word), pa.string()), "word": _text(word), "n": n})

        yield from _combined(tables(), ["lang", "word"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


class Plan:
    """How suffixes are dealt: the number of groups of a language, and its heavy words."""

    def __init__(self, groups: int, heavy: dict[str, set[bytes]]):
        self.groups, self.heavy = groups, heavy


def vertical_partitions(words: DataFrame, budget: int = BUDGET) -> Plan:
    """The plan for the word counts of ``word_counts``.

    Only words above an eighth of the budget come to the driver; there can't be more than 8 x suffixes / budget, and the
    budget is raised so that this is at most ``MAX_HEAVY``. Groups hold half a budget on average; they are made more until
    the light words of none exceed it."""
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, -(-SHARE * total // MAX_HEAVY))
    limit = max(1, budget // SHARE)
    heavy: dict[str, set[bytes]] = {}
    for r in words.where(F.col("f") > limit).collect():
        heavy.setdefault(r.lang, set()).add(r.word.encode())
    load = words.where(F.col("f") <= limit).select("lang", F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit(_MASK)).alias("h"), "f")
    groups = max(1, -(-2 * total // budget))
    while (load.groupBy("lang", F.pmod("h", F.lit(groups)).alias("g")).agg(F.sum("f").alias("s")).agg(F.max("s")).first()[0] or 0) > budget:
        groups *= 2
    return Plan(groups, heavy)


def _routes(plan: Plan, lang: str, words: _Words, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The group of each window: by its first word, by two words if that is heavy, by all three if both are. A word's own
    number is what ``vertical_partitions`` has."""
    distinct = words.distinct.to_pylist()
    crc = np.fromiter((crc32(w) for w in distinct), np.int64, len(distinct))
    one = crc[a] & _MASK
    if heavy := plan.heavy.get(lang):
        mark = np.fromiter((w in heavy for w in distinct), bool, len(distinct))
        two = (crc[a] * _STEP + crc[b]) & _MASK
        three = (two * _STEP + np.where(c < 0, 0, crc[c])) & _MASK
        one = np.where(mark[a], np.where(mark[b], three, two), one)
    return one % plan.groups


def packed_suffixes(texts: DataFrame, plan: Plan) -> DataFrame:
    """lang, grp, suffixes, counts: for each group and chunk one packed run of suffixes, words one and two parted from the
    third by a tab, and their counts as 32-bit numbers."""
    shipped = texts.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for lang, words in _batches(batches):
            a, b, c, n = words.windows()
            if not len(a):
                continue
            grp = _routes(own, lang, words, a, b, c)
            order = np.argsort(grp, kind="stable")
            a, b, c, n, grp = a[order], b[order], c[order], n[order], grp[order]
            distinct = words.distinct
            third = pc.fill_null(distinct.take(pa.array(c, mask=c < 0)), b"")
            pairs = pc.binary_join_element_wise(distinct.take(pa.array(a)), distinct.take(pa.array(b)), b" ")
            lines = pc.binary_join_element_wise(pairs, third, b"\t")
            edges = np.flatnonzero(np.diff(grp, prepend=-1, append=-1))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                blob = pa.compress(b"\n".join(lines.slice(x, y - x).to_pylist()), codec="zstd", asbytes=True)
                size = pc.sum(pc.binary_length(lines.slice(x, y - x))).as_py() + y - x - 1
                yield pa.RecordBatch.from_pydict({"lang": [lang], "grp": pa.array([int(grp[x])], pa.int64()), "size": pa.array([size], pa.int64()), "suffixes": [blob], "counts": [n[x:y].astype("<u4").tobytes()]})

    return texts.mapInArrow(run, "lang string, grp long, size long, suffixes binary, counts binary")


def subtrees(runs: DataFrame, plan: Plan, min_count: int) -> DataFrame:
    """lang, phrase, words, f, whole of all inner nodes and leaves with ``min_count`` occurrences or more. Each group's runs
    are merged by themselves. The leaves of two heavy words are dealt to many groups: such a pair has a row for each of
    them, however small, with ``whole`` false."""
    shipped = runs.sparkSession.sparkContext.broadcast(plan)

    def build(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        lines: list[bytes] = []
        for size, blob in zip(table.column("size").to_pylist(), table.column("suffixes").to_pylist(), strict=True):
            lines += pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        leaves = pa.table({"s": pa.array(lines, pa.binary()), "n": n}).group_by("s").aggregate([("n", "sum")])
        del lines
        parts = pc.split_pattern(leaves.column("s").combine_chunks(), b"\t").flatten()
        above = pa.table({"s": parts.take(pa.array(np.arange(0, len(parts), 2))), "n": leaves.column("n_sum")}).group_by("s").aggregate([("n", "sum")])
        split = np.zeros(above.num_rows, bool)
        if heavy := shipped.value.heavy.get(lang):
            pairs = pc.split_pattern(above.column("s").combine_chunks(), b" ").flatten()
            known = pc.is_in(pairs, pa.array(sorted(heavy), pa.binary())).to_numpy(zero_copy_only=False)
            split = known[0::2] & known[1::2]
        keep = split | (above.column("n_sum").to_numpy() >= min_count)
        above, split = above.filter(pa.array(keep)), split[keep]
        third = parts.take(pa.array(np.arange(1, len(parts), 2)))
        leaves = leaves.filter(pc.and_(pc.greater_equal(leaves.column("n_sum"), min_count), pc.greater(pc.binary_length(third), 0)))
        phrase = pa.chunked_array([*above.column("s").chunks, *pc.replace_substring(leaves.column("s").cast(pa.string()), "\t", " ").cast(pa.binary()).chunks], pa.binary())
        size = np.repeat(np.array([2, 3], np.int32), [above.num_rows, leaves.num_rows])
        count = pa.chunked_array([*above.column("n_sum").chunks, *leaves.column("n_sum").chunks], pa.int64())
        return pa.table({"lang": pa.array([lang] * len(size), pa.string()), "phrase": phrase.cast(pa.string()), "words": size, "f": count, "whole": np.concatenate((~split, np.ones(leaves.num_rows, bool)))})

    return runs.groupBy("lang", "grp").applyInArrow(build, "lang string, phrase string, words int, f long, whole boolean")


def phrase_counts(docs: DataFrame, min_count: int = 10, budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all languages, and (lang, phrase, words, f) of all phrases of one to three words with ``min_count`` or
    more occurrences."""
    texts = texts_of(docs, text_col, lang_col)
    with arrow_batches(docs.sparkSession, "8m"):
        words = materialise(word_counts(texts), "words")
        plan = vertical_partitions(words, budget)
        nodes = materialise(subtrees(packed_suffixes(texts, plan), plan, min_count), "subtrees")
    langs = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "langs")
    out = nodes.where("whole").drop("whole").unionByName(words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f"))
    if plan.heavy:
        out = out.unionByName(nodes.where("NOT whole").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))
    counts = materialise(out, "phrases")
    discard(words, nodes)
    return langs, counts


def collocations(docs: DataFrame, min_count: int = 10, percent: int = 50, top: int = 2000, budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each language.

    A phrase's score is the least, over the places k where it may be cut, of floor(10^6 * a * a / (l * r)), ties to the
    smallest k; phrases that lie inside a longer candidate with at least ``percent`` of their count are dropped. Products
    are decimals of 38 digits. A null text is empty, a null language ``und``; texts without words and an empty table give
    no row; very long texts are counted whole, in chunks; repeated rows count as often as they stand. Equal scores go by
    count, then by the phrase's bytes, so ranks have no ties. Other columns are ignored, whatever their names.
    """
    langs, counts = phrase_counts(docs, min_count, budget, text_col, lang_col)
    key = lambda phrase: F.concat(F.col("lang"), F.lit("\t"), phrase)  # noqa: E731  words hold no tab
    table = counts.select(key(F.col("phrase")).alias("key"), "f")
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - words)")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("*", key(first).alias("lkey"), key(rest).alias("rkey"))
    scored = lookup(cuts, "lkey", table.select(F.col("key").alias("lkey"), F.col("f").alias("l"))).drop("lkey")
    scored = lookup(scored, "rkey", table.select(F.col("key").alias("rkey"), F.col("f").alias("r"))).drop("rkey")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("up", (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("down", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = found.where("words = 3").select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {percent} * a")
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = flat.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = 10, percent: int = 50, top: int = 2000) -> str:
    """DuckDB: all windows of one to three words, counted whole."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
windows AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (VALUES (1), (2), (3)) sizes(size) WHERE len(w) >= size),
counts AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM windows GROUP BY ALL),
langs AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {min_count}),
cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM found) c
         JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM found WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM found WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {percent} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN langs USING (lang) QUALIFY rank <= {top}
"""
