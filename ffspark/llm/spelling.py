"""Spelling variants: words one edit apart, found by an index of variable-length grams.

1. A frequency-pruned dictionary of grams: all grams of ``QMIN`` code points, and a longer one (up to ``QMAX``) where the
   gram that it extends is too frequent and it is frequent enough itself.
2. Every word is decomposed: at each place stands the longest gram of the dictionary that fits. An edit can affect the gram
   at a place only if it touches the span that the longest gram of the dictionary with the same beginning would cover.
3. These bounds say which lists must be merged. A word's three grams with spans apart, chosen for short lists, lose one at
   most to an edit, so a partner stands on at least two of the three lists, at the same places or moved by the edit: the
   index holds pairs of grams, and merging is a join on them. Words that have no three such grams (of seven code points),
   or are very long, use all grams before a cut and all grams behind it instead: a partner stands on all lists of a side.
4. Each pair found is verified once by its edit distance.

Grams and digests only propose pairs; a collision costs a comparison, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import discard, fold_ascii, lookup, materialise
from ffspark.llm.shingles import mix

#: With these, every word of ``MIN_LENGTH`` code points or more has a cut with grams on both sides, and every longer one three
#: grams with spans apart.
QMIN, QMAX, MIN_LENGTH = 2, 3, 7
#: Longer words have their sides in the index instead of pairs, whose number is quadratic in the length.
LONG = 24
#: A gram is extended above the (total of places / PARTS) occurrences, by grams with at least a tenth of that: so no more
#: than (QMAX - QMIN + 1) x 10 x PARTS grams come to the driver and go to the tasks, however many words there are.
PARTS, FRACTION = 20_000, 10
#: Code points of words that are decomposed at once.
CELLS = 500_000
_BITS = 12


class Grams(NamedTuple):
    """The dictionary: packed grams in order, how many places each stands at, the longest gram it begins, whether it may
    replace a shorter one."""

    code: np.ndarray
    places: np.ndarray
    reach: np.ndarray
    longer: np.ndarray


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and code points (a row a word) of words (id, word) of equal length, in portions of about ``CELLS``."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(size[order[x]])
            for at in range(x, y, max(1, CELLS // n)):
                chosen = order[at : min(y, at + max(1, CELLS // n))]
                points = np.frombuffer("".join([words[k] for k in chosen]).encode("utf-32-le", "surrogatepass"), np.uint32)
                yield ids[chosen], points.reshape(len(chosen), n).astype(np.int64) % ((1 << _BITS) - 1) + 1


def _packed(points: np.ndarray, q: int) -> np.ndarray:
    """The grams of ``q`` code points at every place, in one number each."""
    n = points.shape[1] - q + 1
    out = points[:, :n].copy()
    for k in range(1, q):
        out |= points[:, k : k + n] << (_BITS * k)
    return out


def gram_counts(words: DataFrame) -> DataFrame:
    """code, q, f: at how many places of the words (id, word) every gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, points in _matrices(batches):
            for q in range(QMIN, min(QMAX, points.shape[1]) + 1):
                code, f = np.unique(_packed(points, q), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": code, "q": np.full(len(code), q, np.int32), "f": f})

    return words.select("id", "word").mapInArrow(run, "code long, q int, f long").groupBy("code", "q").agg(F.sum("f").alias("f"))


def gram_dictionary(words: DataFrame, parts: int = PARTS) -> Grams:
    """The pruned dictionary of the words (id, word)."""
    counts = materialise(gram_counts(words), "grams")
    total = counts.where(F.col("q") == QMIN).agg(F.sum("f")).first()[0] or 0
    most = max(1, total // parts)
    found = counts.where(F.col("f") >= max(1, most // FRACTION)).toArrow()
    discard(counts)
    code, q, f = (found.column(c).to_numpy() for c in ("code", "q", "f"))
    order = np.argsort(code)
    code, q, f = code[order], q[order].astype(np.int64), f[order]
    above = code & ((np.int64(1) << (_BITS * (q - 1))) - 1)
    at = np.minimum(np.searchsorted(code, above), max(0, len(code) - 1))
    extends = (q > QMIN) & (code[at] == above) & (f[at] > most) if len(code) else np.zeros(0, bool)
    keep = extends | (q == QMIN)
    code, q, f, extends = code[keep], q[keep], f[keep], extends[keep]
    places, reach = f.copy(), q.copy()
    for k in range(QMIN + 1, QMAX + 1):
        of = extends & (q == k)
        np.subtract.at(places, np.searchsorted(code, code[of] & ((np.int64(1) << (_BITS * (k - 1))) - 1)), f[of])
        for m in range(QMIN, k):
            np.maximum.at(reach, np.searchsorted(code, code[of] & ((np.int64(1) << (_BITS * m)) - 1)), k)
    return Grams(code, places, reach, extends)


class Parts(NamedTuple):
    """The grams of words of one length at each place: their packed form, their span, and how many places they have."""

    code: np.ndarray
    reach: np.ndarray
    places: np.ndarray


def decompose(points: np.ndarray, grams: Grams) -> Parts:
    rows, size = points.shape
    n = size - QMIN + 1
    code = _packed(points, QMIN)
    reach, places = np.full((rows, n), QMIN, np.int64), np.zeros((rows, n), np.int64)
    for q in range(QMIN, min(QMAX, size) + 1) if len(grams.code) else ():
        here = _packed(points, q)
        at = np.minimum(np.searchsorted(grams.code, here), len(grams.code) - 1)
        hit = (grams.code[at] == here) & (grams.longer[at] | (q == QMIN))
        m = here.shape[1]
        for out, new in ((code, here), (reach, grams.reach[at]), (places, grams.places[at])):
            out[:, :m] = np.where(hit, new, out[:, :m])
    return Parts(code, reach, places)


def triples(parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Three places of each word whose grams have spans apart, those with the shortest lists by their frequencies, and which
    words have any."""
    rows, n = parts.code.shape
    f, at = parts.places.astype(float) + 1, np.arange(rows)
    low, low_at = np.full((rows, n), np.inf), np.zeros((rows, n), np.int64)  # of the grams whose span ends before a place
    for p in range(1, n):
        low[:, p], low_at[:, p] = low[:, p - 1], low_at[:, p - 1]
        for r in range(QMIN, min(QMAX, p) + 1):
            better = (parts.reach[:, p - r] == r) & (f[:, p - r] < low[:, p])
            low[:, p] = np.where(better, f[:, p - r], low[:, p])
            low_at[:, p] = np.where(better, p - r, low_at[:, p])
    high, high_at = np.full((rows, n + QMAX + 1), np.inf), np.zeros((rows, n + QMAX + 1), np.int64)  # of the grams from a place on
    for p in range(n - 1, -1, -1):
        better = f[:, p] <= high[:, p + 1]
        high[:, p] = np.where(better, f[:, p], high[:, p + 1])
        high_at[:, p] = np.where(better, p, high_at[:, p + 1])
    after = np.arange(n) + parts.reach
    third, third_at = np.take_along_axis(high, after, 1), np.take_along_axis(high_at, after, 1)
    with np.errstate(invalid="ignore"):
        cost = np.where(np.isinf(low) | np.isinf(third), np.inf, low * f + low * third + f * third)
    mid = np.argmin(cost, axis=1)
    return np.stack((low_at[at, mid], mid, third_at[at, mid]), axis=1), np.isfinite(cost[at, mid])


class Sides(NamedTuple):
    """At each place: digests of the grams up to it and from it on, the place behind all spans of the former, and for each
    word the best cut: its last gram on the left and its first on the right."""

    left: np.ndarray
    right: np.ndarray
    behind: np.ndarray
    last: np.ndarray
    first: np.ndarray


def sides(parts: Parts) -> Sides:
    rows, n = parts.code.shape
    behind = np.maximum.accumulate(np.arange(n) + parts.reach, axis=1)
    unsigned = parts.code.astype(np.uint64)
    left, right = np.empty((rows, n), np.uint64), np.empty((rows, n), np.uint64)
    state = np.zeros(rows, np.uint64)
    for p in range(n):
        state = mix((state ^ unsigned[:, p]) + np.uint64(1))
        left[:, p] = state
    state = np.ones(rows, np.uint64)
    for p in range(n - 1, -1, -1):
        state = mix((state ^ unsigned[:, p]) + np.uint64(2))
        right[:, p] = state
    fewest, later = np.minimum.accumulate(parts.places, axis=1), np.minimum.accumulate(parts.places[:, ::-1], axis=1)[:, ::-1]
    cut = np.minimum(behind, n - 1)
    halved = 0.5 ** np.minimum(np.arange(n), 1000)
    cost = (fewest + 1) * halved[None, :] + (np.take_along_axis(later, cut, 1) + 1) * halved[n - 1 - cut]
    last = np.argmin(np.where(behind <= n - 1, cost, np.inf), axis=1)
    return Sides(left, right, behind, last, behind[np.arange(rows), last])


def _side_key(digest: np.ndarray, size: int) -> np.ndarray:
    """A digest of a side's grams with the length of the words that it is looked for among."""
    return mix(digest + np.uint64(size)).view(np.int64)


def _pair_key(parts: Parts, rows: np.ndarray, p: np.ndarray, q: np.ndarray, size: int, moved_p: int = 0, moved_q: int = 0) -> np.ndarray:
    """A digest of two grams with their places in a word of ``size``, which an edit may have moved."""
    one, two = parts.code[rows, p].astype(np.uint64), parts.code[rows, q].astype(np.uint64)
    place = ((p + moved_p) * 4096 + (q + moved_q)).astype(np.uint64) * np.uint64(4096) + np.uint64(size)
    return mix(mix(mix(one + np.uint64(3)) ^ two) ^ place).view(np.int64)


def _index(ids: np.ndarray, parts: Parts, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = parts.code.shape[1]
    if size <= LONG + 1:
        for p in range(n):
            for q in range(p + QMIN, n):
                rows = np.flatnonzero(p + parts.reach[:, p] <= q)
                yield _pair_key(parts, rows, np.full(len(rows), p), np.full(len(rows), q), size), ids[rows]
    if size <= MIN_LENGTH + 1 or size > LONG:
        s = sides(parts)
        fits, all_ids = s.behind <= n - 1, np.broadcast_to(ids[:, None], s.left.shape)
        yield _side_key(s.left[fits], size), all_ids[fits]
        yield _side_key(s.right[:, QMIN:].ravel(), size), all_ids[:, QMIN:].ravel()


def _probes(ids: np.ndarray, parts: Parts, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What partners of the same length, or longer by one, must have: the third gram moves if the edit comes before it."""
    chosen, found = triples(parts)
    if size > LONG:
        found[:] = False
    rows = np.flatnonzero(found)
    a, b, c = chosen[rows].T
    for p, q, moves in ((a, b, (0, 0)), (b, c, (1, 1)), (a, c, (0, 1))):
        yield _pair_key(parts, rows, p, q, size), ids[rows]
        yield _pair_key(parts, rows, p, q, size + 1, *moves), ids[rows]
    if not found.all():
        rest = np.flatnonzero(~found)
        s = sides(Parts(*(x[rest] for x in parts)))
        at = np.arange(len(rest))
        for own in (s.left[at, s.last], s.right[at, s.first]):
            for target in (size, size + 1):
                yield _side_key(own, target), ids[rest]


def _bag(points: np.ndarray) -> np.ndarray:
    """A bit for each code point (modulo 64) that a word has an odd number of times: an edit changes two at most."""
    return np.bitwise_xor.reduce(np.left_shift(np.uint64(1), points.astype(np.uint64) % np.uint64(64)), axis=1).view(np.int64)


def lists(words: DataFrame, grams: Grams, probe: bool) -> DataFrame:
    """key, id, bag: the index of the words (id, word), or what is looked up in it for each of them."""
    shipped = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["at", "word"])
            for at, points in _matrices(iter([places])):
                parts, bag = decompose(points, shipped.value), np.zeros(batch.num_rows, np.int64)
                bag[at] = _bag(points)
                for key, own in (_probes if probe else _index)(at, parts, points.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(own)), pa.array(bag[own])], names=["key", "id", "bag"])

    kind = words.schema["id"].dataType.simpleString()
    return words.select("id", "word").mapInArrow(run, f"key long, id {kind}, bag long")


def _met(prober: DataFrame, indexed: DataFrame, grams: Grams) -> DataFrame:
    """a, b: ids that share a key, but for pairs whose bags of code points are more than an edit apart."""
    of = lambda df, x: df.select("key", F.col("id").alias(x), F.col("bag").alias(f"bag_{x}"))
    pairs = of(lists(prober, grams, True), "a").join(of(lists(indexed, grams, False), "b"), "key")
    return pairs.where((F.bit_count(F.col("bag_a").bitwiseXOR(F.col("bag_b"))) <= 2) & (F.col("a") != F.col("b"))).select("a", "b")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, b, n_a, n_b of all pairs of the words (id, word, n) that differ by exactly one inserted, deleted or replaced code
    point, each once. ``words`` must be a written table of distinct words of ``MIN_LENGTH`` or more.

    Words up to ``LONG`` code points travel with their keys and are verified where they meet; longer ones, which have a key
    for every place, travel as ids."""
    grams = gram_dictionary(words, parts)
    length = F.char_length("word")
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    verified = ordered & (F.levenshtein("a", "b", 1) == 1)
    text = words.select(F.col("word").alias("id"), "word")
    short = _met(text.where(length <= LONG), text.where(length <= LONG + 1), grams).where(verified)
    far = words.where(length > LONG).select("id", "word")
    of = lambda x: far.select(F.col("id").alias(f"{x}_id"), F.col("word").alias(x))
    ids = _met(far, far, grams).select(F.col("a").alias("a_id"), F.col("b").alias("b_id")).distinct()
    long = ids.join(of("a"), "a_id").join(of("b"), "b_id").where(verified).select("a", "b")
    pairs = materialise(short.unionByName(long).distinct(), "pairs")
    n = lambda x: words.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    near = materialise(lookup(lookup(pairs, "a", n("a")), "b", n("b")), "near")
    discard(pairs)
    return near


def spelling_forms(words: DataFrame, ratio: int = 10, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a written table (id, word, n) of distinct words; see ``spelling_variants``."""
    near = near_words(words, parts)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = materialise(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms"
    )
    up = materialise(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # a form has at least ``ratio`` times the count, so chains are short, and each round halves what is left
        above = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialise(lookup(up, "root", above, "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        discard(up)
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    discard(near)
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def garbled_words(docs: DataFrame, one_in: int = 31, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One word a row: the folded letter runs of every text, of which one in ``one_in`` (by a checksum of document and run)
    has lost a code point; those of ``min_length`` or more."""
    runs = F.regexp_extract_all(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), 0)
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = F.expr("CAST(h % char_length(run) AS INT)")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return each.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_length)


def count_words(words: DataFrame, min_count: int = 2) -> DataFrame:
    """A written table (id, word, n) of the distinct words with ``min_count`` or more occurrences."""
    counted = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count), "counted")
    return materialise(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def spelling_variants(docs: DataFrame, one_in: int = 31, ratio: int = 10, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of seven or more code points that occurs twice or more.

    ``form`` is the most frequent of the words one edit away (ties: the smallest in code-point order) if it is at least
    ``ratio`` times as frequent, else null; ``root`` follows forms to the last. A null text has no words, a null id counts
    as an empty one in the checksum. Words of any length and texts of any length are taken whole; repeated rows count as
    often as they stand; texts without words and an empty table give no row. Other columns are ignored.
    """
    return spelling_forms(count_words(garbled_words(docs, one_in, MIN_LENGTH, id_col, text_col)), ratio, parts)


def oracle_sql(one_in: int = 31, ratio: int = 10, min_length: int = MIN_LENGTH) -> str:
    """DuckDB: the checksum bit by bit, near words by deleting each code point in turn."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digits = "0123456789ABCDEF"
    return rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
runs AS (SELECT d, run, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
         WHERE length(run) >= {min_length} GROUP BY ALL),
bytes AS (SELECT run, c, list_transform(range(1, len(x) // 2 + 1), lambda k: (instr('{digits}', x[2 * k - 1]) - 1) * 16 + instr('{digits}', x[2 * k]) - 1) AS b FROM (SELECT run, c, hex(encode(d || ':' || run)) AS x FROM runs)),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, v: xor(s // 256, tab[(xor(s, v) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, bits),
garbled AS (SELECT CASE WHEN h % {one_in} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM garbled WHERE length(word) >= {min_length} GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {ratio} * n THEN other END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN forms ON root = forms.word WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM forms LEFT JOIN ends USING (word)
"""
