"""Secret scanning with an incremental blob ledger.

Every version of every path is content-addressed. The ledger names the (blob, rule, rule version) triples that were
scanned before, with what was found. A run finds the blobs with unseen triples by digests alone, reads one text of each,
applies just the rules that the blob lacks, adds the results to the ledger and joins the findings back to all paths.
Built-in functions only.
"""

from __future__ import annotations

import uuid

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.llm.shared import discard, lookup, materialise, scratch_path
from ffspark.llm.spans import MARKED_TEXTS_SQL, count_kind, cut_sql, listing, marked, matches, unmarked


class SecretRule(NamedTuple):
    """``pattern`` finds candidates, leftmost and non-overlapping; those shorter than ``at_least`` are dropped.
    With ``tail`` the pattern has two groups that make up the match, and the second one is measured."""

    kind: str
    version: int
    pattern: str
    at_least: int
    tail: bool = False


#: Fixed patterns. For the last two a match of too few characters holds no longer one inside, so the bound is in them.
RULES = (
    SecretRule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, True),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{16,}", 20),
    SecretRule("hex", 1, r"[0-9a-f]{24,}", 24),
)

#: Hex digits of a digest by which a kept ledger's files are dealt to folders.
PREFIX = 2
LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:long,end:long>>"


def scan_rule(text: Column, rule: SecretRule) -> Column:
    measured = (lambda m: F.char_length(m["tail"])) if rule.tail else (lambda m: m["end"] - m["start"])
    found = F.filter(matches(marked(text, rule.pattern, rule.tail)), lambda m: measured(m) >= rule.at_least)
    return F.transform(found, lambda m: F.struct(m["start"], m["end"]))


def name_of(rule: SecretRule) -> str:
    return f"{rule.kind}:{rule.version}"


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, missing): one per blob and rule named in ``missing``, with an empty array where
    nothing was found. Other rules aren't applied. A blob that is there twice counts once."""
    scanned = blobs.select("blob", "missing", unmarked(F.col("text")).alias("text"))
    one = lambda r: F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), scan_rule(F.col("text"), r).alias("spans"))
    found = F.array(*[F.when(F.array_contains("missing", name_of(r)), one(r)) for r in rules])
    scanned = scanned.select("blob", F.filter(found, lambda x: x.isNotNull()).alias("found")).dropDuplicates(["blob"])
    return scanned.select("blob", F.inline("found"))


def scan_versions(versions: DataFrame, ledger: DataFrame | BlobLedger | None = None, rules: tuple[SecretRule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, added): ``findings`` has one row per row of ``versions`` with path, blob and ``found``, an array of
    (start, rank, kind, end) in order of start and rule; ``added`` are the new ledger rows, already written to shared
    storage, to be appended to ``ledger``.

    A null text is the empty blob. Paths may be null or repeat (one row per version). Empty tables give empty results.
    Other columns are ignored, whatever their names; very long texts are scanned whole. Where few blobs are new, Spark sends their digests to the texts; else
    each text moves once, whatever the number of its copies.
    """
    addressed = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    addressed = addressed.withColumn("owner", F.xxhash64(F.coalesce(F.col("path").cast("string"), F.col("blob"))))
    paths = materialise(addressed.drop("text"), "versions")
    todo = paths.groupBy("blob").agg(F.min("owner").alias("owner"))
    missing = F.array(*[F.lit(name_of(r)) for r in rules])
    if isinstance(ledger, BlobLedger):
        ledger = ledger.of(todo)
    if ledger is not None:
        # Of the ledger only the push's blobs are looked at again: Spark sends the digests of a small push to the files.
        ledger = materialise(ledger.join(todo.select("blob"), "blob", "left_semi").select("blob", "rule", "rule_version", "spans"), "known")
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "rule_version")).alias("seen"))
        todo = todo.join(seen, "blob", "left")
        missing = F.array_except(missing, F.coalesce("seen", F.array().cast("array<string>")))
    todo = materialise(todo.select("blob", "owner", missing.alias("missing")).where(F.size("missing") > 0), "unseen")
    added = materialise(scan_blobs(addressed.select("blob", "owner", "text").join(todo, ["blob", "owner"]), rules), "found")
    discard(todo)
    known = added if ledger is None else added.unionByName(ledger)
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(name_of(r)), F.lit(k))])
    hits = known.where(F.size("spans") > 0).withColumn("rank", rank[F.concat_ws(":", "rule", "rule_version")]).where("rank IS NOT NULL")
    spans = hits.select("blob", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))).alias("s"))
    per_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("found"))
    findings = lookup(paths, "blob", per_blob, "left").select("path", "blob", F.coalesce("found", F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>")).alias("found"))
    return findings, added


class BlobLedger:
    """A ledger kept as Parquet at ``path``, in a folder for each scan and, inside, for the first ``PREFIX`` hex digits of the
    digest. A scan reads only the folders of its own digests and adds one of its own, so scans may run at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, prefixes: list[str] | None = None) -> DataFrame | None:
        """All rows, or those whose digest begins with one of ``prefixes``."""
        try:
            rows = self.spark.read.schema(f"{LEDGER}, scan string, prefix string").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return (rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))).drop("scan", "prefix")

    def of(self, blobs: DataFrame) -> DataFrame | None:
        """The rows in the folders of these blobs' digests; at most 16 ** ``PREFIX`` prefixes come to the driver."""
        return self.read([r.p for r in blobs.select(F.left("blob", F.lit(PREFIX)).alias("p")).distinct().collect()])

    def add(self, rows: DataFrame) -> None:
        own = f"{self.path}/scan={uuid.uuid4().hex}"
        prefix = F.left("blob", F.lit(PREFIX))
        rows.withColumn("prefix", prefix).hint("rebalance", "prefix").write.partitionBy("prefix").parquet(own)

    def scan(self, versions: DataFrame, rules: tuple[SecretRule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """The findings of ``scan_versions``. What it adds is in the ledger when this returns."""
        findings, added = scan_versions(versions, self, rules, path_col, text_col)
        self.add(added)
        return findings


def secret_findings(docs: DataFrame, ledger: BlobLedger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The digest columns of a scan with ``ledger``: doc_id, n_<kind>..., base_sha256, spans. The rules beyond the base ones
    would add to ``spans`` only; by default there are none. Nulls, repeated rows, ids, empty tables and other columns are
    treated as in ``scan_versions``."""
    findings = ledger.scan(docs, rules, id_col, text_col)
    base = {r.kind for r in RULES}
    counts = [count_kind("found", r.kind) for r in RULES]
    own = F.filter("found", lambda s: s["kind"].isin(*base))
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(listing(own), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"))


def two_pushes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``secret_findings`` of all ``docs``, when about half of the rows (by a hash of the id) were pushed and scanned before:
    the scan of the whole table then reads only contents that the first push had not."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs.where(F.pmod(F.xxhash64(id_col), F.lit(2)) == 0), path_col=id_col, text_col=text_col)
    return secret_findings(docs, ledger, id_col, text_col)


def oracle_sql(rules: tuple[SecretRule, ...] = RULES) -> str:
    """``two_pushes`` in DuckDB's SQL: all matches of each rule with their places, measured and listed in order."""
    quoted = lambda r: r.pattern.replace("'", "''")
    measure = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN length({f"regexp_extract(v, '{quoted(r)}', 2)" if r.tail else "v"}) >= {r.at_least}" for r in rules) + " END"
    counts = ", ".join(f"count_if(kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in rules)
    return f"""
WITH texts AS ({MARKED_TEXTS_SQL}),
placed AS ({cut_sql({r.kind: quoted(r) for r in rules})}),
listed AS (
  SELECT row, {counts}, string_agg(concat_ws(':', kind, start, start + length(v)), ',' ORDER BY start, rank) AS spans
  FROM placed WHERE {measure} GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)
"""
