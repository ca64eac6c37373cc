"""Finding all matches of a pattern with their places, in built-in functions only.

``regexp_replace`` puts a mark before and after every match and ``split`` cuts the text there: the pieces then
alternate between gap and match, and their lengths add up to code-point offsets. A mark that a text already holds is
first swapped for another character of the same length, which no pattern mentions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, INNER, OTHER = "\ue000", "\ue001", "\ue002"

#: A match: code points [start, end), its text, the text of the second group where the pattern marks one, and the
#: characters before and after it where they are asked for.
MATCH = "array<struct<start:long,end:long,value:string,tail:string,before:string,after:string>>"
#: Running sums are made in blocks of this size, because an aggregate copies its state at every step.
BLOCK = 256


def clean_marks(text: Column) -> Column:
    return F.translate(text, MARK + INNER, OTHER + OTHER)


def has_marks(text: Column) -> Column:
    return F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(INNER))


def unmarked(text: Column) -> Column:
    """Texts that hold no mark stay as they are, without a pass of ``translate``."""
    return F.when(has_marks(text), clean_marks(text)).otherwise(text)


def marked(text: Column, pattern: str, inner: bool = False) -> Column:
    """The text with marks around every match; ``inner`` also marks the border between groups 1 and 2."""
    return F.regexp_replace(text, pattern, f"{MARK}$1{INNER}$2{MARK}" if inner else f"{MARK}$0{MARK}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running_starts(lengths: Column) -> Column:
    """Where each of the items of these lengths begins: sums within blocks, after the sums of the blocks before."""

    def sums(of: Column, first: Column) -> Column:
        return F.aggregate(of, F.array(first), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))

    def body(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
        zero = F.lit(0).cast("long")
        total = lambda x: F.aggregate(x, zero, lambda s, v: s + v)
        within = lambda bs: F.zip_with(bs, F.slice(sums(F.transform(bs, total), zero), 1, F.size(bs)), lambda x, first: F.slice(sums(x, first), 1, F.size(x)))
        return F.flatten(let(blocks, within))

    return let(lengths, body)


def matches(marked_text: Column, context: int = 0) -> Column:
    """All matches of a marked text, in order. With ``context``, ``before`` and ``after`` hold up to so many characters of
    the two gaps and two matches on either side of a match."""

    def body(p: Column) -> Column:
        starts = running_starts(F.transform(p, lambda v: F.char_length(F.replace(v, F.lit(INNER), F.lit(""))).cast("long")))
        items = F.zip_with(p, starts, lambda v, at: F.struct(v.alias("v"), at.alias("at"), F.lit("").alias("before"), F.lit("").alias("after")))
        if context:
            shift = lambda k: F.slice(F.concat(F.array_repeat(F.lit(""), k), p), 1, F.size(p))
            join = lambda x, y: F.right(F.concat(F.right(x, F.lit(context)), F.right(y, F.lit(context))), F.lit(context))
            before = F.zip_with(F.zip_with(shift(4), shift(3), join), F.zip_with(shift(2), shift(1), join), join)
            ahead = lambda k: F.concat(F.slice(p, k + 1, F.size(p)), F.array_repeat(F.lit(""), k))
            first = lambda x, y: F.left(F.concat(F.left(x, F.lit(context)), F.left(y, F.lit(context))), F.lit(context))
            after = F.zip_with(F.zip_with(ahead(1), ahead(2), first), F.zip_with(ahead(3), ahead(4), first), first)
            sides = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
            items = F.zip_with(items, sides, lambda x, s: F.struct(x["v"].alias("v"), x["at"].alias("at"), s["b"].alias("before"), s["a"].alias("after")))
        return F.transform(
            F.filter(items, lambda x, k: k % 2 == 1),
            lambda x: let(
                F.replace(x["v"], F.lit(INNER), F.lit("")),
                lambda value: F.struct(
                    x["at"].alias("start"),
                    (x["at"] + F.char_length(value)).alias("end"),
                    value.alias("value"),
                    F.when(F.contains(x["v"], F.lit(INNER)), F.substring_index(x["v"], INNER, -1)).alias("tail"),
                    x["before"].alias("before"),
                    x["after"].alias("after"),
                ),
            ),
        )

    return F.when(F.contains(marked_text, F.lit(MARK)), let(F.split(marked_text, MARK, -1), body)).otherwise(F.array().cast(MATCH))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of an ordered array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


#: DuckDB's texts (row, doc_id, text) of ``documents``, without marks of their own.
MARKED_TEXTS_SQL = f"SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{MARK}{INNER}', '{OTHER}{OTHER}') AS text FROM documents"


def cut_sql(patterns: dict[str, str]) -> str:
    """A DuckDB query for (row, rank, kind, start, v), every match of the patterns (by kind, quoted) in ``texts``."""
    one = lambda rank, kind, pattern: f"SELECT row, {rank} AS rank, '{kind}' AS kind, string_split(regexp_replace(text, '{pattern}', '{MARK}\\0{MARK}', 'g'), '{MARK}') AS p FROM texts"
    cut = "\n  UNION ALL ".join(one(rank, kind, pattern) for rank, (kind, pattern) in enumerate(patterns.items()))
    pieces = f"SELECT row, rank, kind, unnest(p) AS v, generate_subscripts(p, 1) AS k FROM ({cut}) WHERE len(p) > 1"
    sums = f"SELECT *, sum(length(v)) OVER (PARTITION BY row, rank ORDER BY k) - length(v) AS start FROM ({pieces})"
    return f"SELECT row, rank, kind, start::BIGINT AS start, v FROM ({sums}) WHERE k % 2 = 0"
