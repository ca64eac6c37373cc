"""Near-duplicate join on word n-grams: Jaccard similarity with rare-first prefix filtering.

1. One pass over the texts gives each document's shingle set: its size, a fingerprint (documents with equal sets are
   one *node* from here on) and a hash sample of the set, shipped as packed blobs by hash range.
2. A linked document shares at least t of its shingles, so it has at most (1 - t) n shingles that no other document
   has. Documents with more of those inside the sample alone can have no partner and leave (an exact filter).
3. For the others, all shingles are counted; rare shingles come first in the global order (count, hash). Two linked
   nodes share a shingle within their first n - ceil(t n) + 1; the smaller one has it even within its first
   n - ceil(2t / (1 + t) n) + 1.
4. Candidates meet on prefix shingles and pass length, positional and suffix filters. For the components, each prefix
   shingle first links its nodes to one pivot; after that, pairs are made only between nodes that are still in
   different components, of about equal length, with the list of a frequent shingle cut into blocks. Every pair is
   verified once, on the full sets.
5. A link never leaves its component, so the number of links of a node is counted over all pairs inside it: large
   components are cut into blocks and every pair of blocks is one small group, small ones are put together.

A shingle or a group that fills the corpus is pre-aggregated in step 2, linked through pivots in step 4 and spread
over block pairs in step 5; no list of its documents is ever gathered, and what many rows look up is spread over parts.
Texts that are put together from a few phrases, all frequent, without being near duplicates have no rare prefix: an
exact join has to compare those of equal length and prefix, so their work, though not a task's share, grows faster than
their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ffspark.llm.components import connected_components
from ffspark.llm.shared import PARTS, arrow_batches, discard, fresh, lookup, materialise
from ffspark.llm.shingles import fingerprint, shingle_sets

#: Share of the hash space that the first filter looks at, and sampled shingles for each of its reduce groups.
SAMPLE, RANGE_KEYS = 0.4, 250_000
#: Sampled shingles that a task holds before it ships blobs, and size of the batches in which it gets the texts.
HELD_KEYS, BATCH = 250_000, "8m"
HISTOGRAM = 16

#: Largest bitmap (16 MB) that picks out the texts of documents still in play.
FILTER_BITS = 1 << 27
#: Nodes whose sample counts are added up in one group.
BUCKET_NODES = 10_000
#: Nodes and shingles of a block whose links are counted together, on average.
BLOCK_NODES, BLOCK_KEYS = 1_000, 200_000
#: Prefix entries of one shingle that are compared in one place; a list beyond that is cut into such blocks.
BLOCK_POSTINGS = 256

PASS = "ref long, doc_id long, node binary, node_id long, n long, sampled long, local long, slice int, keys binary, owners binary"


def _first_pass(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """Two kinds of row: one per document (slice null), and blobs of sampled shingles (slice, keys, owners).

    ``local`` counts the sampled shingles that another set of the same task has; these are shipped once and without
    owner. A key is 32 bits of its place inside the slice: a clash only keeps a document longer than needed.
    """
    width = int(SAMPLE * 2**64) // ranges
    shift = max(0, (width - 1).bit_length() - 32)
    longs, blob = pa.int64(), pa.binary()
    schema = pa.schema(
        [("ref", longs), ("doc_id", longs), ("node", blob), ("node_id", longs), ("n", longs), ("sampled", longs), ("local", longs), ("slice", pa.int32()), ("keys", blob), ("owners", blob)]
    )

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: (ref, doc_id, node, node id, n, sampled hashes)."""
        first: dict[bytes, int] = {}
        for k, x in enumerate(held):
            if x[2] is not None:
                first.setdefault(x[2], k)
        sets = [held[k][5] for k in first.values()]
        keys = np.concatenate(sets or [np.zeros(0, np.uint64)])
        slots = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(keys, kind="stable")
        keys, slots = keys[order], slots[order]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        shared = same[1:] | same[:-1]
        local = dict(zip(first, np.bincount(slots[shared], minlength=len(sets)).tolist(), strict=True))
        once = ~same[:-1]  # of a run of equal keys, the first
        keys, slots = keys[once], np.where(shared, -1, slots)[once]
        ids = np.array([held[k][3] for k in first.values()], np.int64)
        blobs = []
        if len(keys):
            part = np.minimum(keys // np.uint64(width), np.uint64(ranges - 1)).astype(np.int64)
            bounds = np.searchsorted(part, np.arange(ranges + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                cut = slice(bounds[s], bounds[s + 1])
                place = ((keys[cut] - np.uint64(s * width)) >> np.uint64(shift)).astype(np.int64)
                used, index = np.unique(slots[cut], return_inverse=True)
                used = used[used >= 0]
                index = index + (len(used) + 1 - len(np.unique(slots[cut])))  # 0: no owner
                blobs.append((*[None] * 7, s, np.diff(place, prepend=0).astype("<u4").tobytes() + index.astype("<u4").tobytes(), ids[used].astype("<i8").tobytes()))
        rows = [(ref, doc, node, node_id, n, len(h), local.get(node, 0), None, None, None) for ref, doc, node, node_id, n, h in held]
        for some in (rows, blobs):
            for at in range(0, len(some), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some[at : at + 4096], strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t or b"" for t in part.column(2).to_pylist()], words)
                for ref, doc, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets, strict=True):
                    h = s[: np.searchsorted(s, np.uint64(int(SAMPLE * 2**64)))].copy()
                    node = fingerprint(s)
                    held.append((ref, doc, node, int.from_bytes(node[:8], "little", signed=True) if node else None, len(s), h))
                    count += len(h)
                    if count >= HELD_KEYS:
                        yield from flush(held)
                        held, count = [], 0
        if held:
            yield from flush(held)

    return docs.select("ref", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, PASS)


def _shared_in_slice(table: pa.Table, buckets: int) -> pa.Table:
    """For each bucket of nodes: node ids and how many of their shipped keys in this slice another node has too."""
    keys, owners = [], []
    for blob, ids in zip(table.column("keys").to_pylist(), table.column("owners").to_pylist(), strict=True):
        half = len(blob) // 2
        keys.append(np.cumsum(np.frombuffer(blob[:half], "<u4").astype(np.int64)))
        index = np.frombuffer(blob[half:], "<u4").astype(np.int64)
        known = np.frombuffer(ids, "<i8")
        owners.append((np.concatenate(([0], known))[index], index == 0))
    key, owner, none = np.concatenate(keys), np.concatenate([o for o, _ in owners]), np.concatenate([m for _, m in owners])
    order = np.lexsort((owner, none, key))
    key, owner, none = key[order], owner[order], none[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new_pair = new_key | np.concatenate(([True], (owner[1:] != owner[:-1]) | (none[1:] != none[:-1])))
    group = np.cumsum(new_key) - 1
    shared = (np.bincount(group, weights=new_pair & ~none) > 1) | (np.bincount(group, weights=none) > 0)
    node, hits = np.unique(owner[new_pair & ~none & shared[group]], return_counts=True)
    bucket = (node % buckets).astype(np.int32)
    rows = [(b, node[bucket == b].astype("<i8").tobytes(), hits[bucket == b].astype("<u4").tobytes()) for b in np.unique(bucket).tolist()]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "nodes": pa.array([r[1] for r in rows], pa.binary()), "hits": pa.array([r[2] for r in rows], pa.binary())})


def _sum_hits(table: pa.Table) -> pa.Table:
    nodes = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("nodes").to_pylist()])
    hits = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("hits").to_pylist()])
    node, inverse = np.unique(nodes, return_inverse=True)
    return pa.table({"node_id": pa.array(node, pa.int64()), "hits": pa.array(np.bincount(inverse, weights=hits).astype(np.int64), pa.int64())})


def _membership(refs: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of hashed refs: 16 bits for each up to ``FILTER_BITS``, so its size has a fixed bound. Spark builds
    it in parts of 4 KB. A ref outside may hit a bit of another one; the join that follows sorts that out."""
    bits = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (16 * refs.count()).bit_length()))
    place = F.pmod(F.xxhash64("ref"), F.lit(bits)) + 1
    parts = refs.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return bits, bitmap


def _survivor_sets(source: DataFrame, words: int, alive: DataFrame) -> DataFrame:
    """id, node, n and hashes of the nodes in ``alive``; texts whose ref can't be in it aren't moved."""
    bits, bitmap = _membership(alive.select("ref"))
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            chosen = batch.column(1).take(pa.array(np.flatnonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)))
            for at in range(0, len(chosen), 256):
                kept = [s for s in shingle_sets(chosen[at : at + 256].to_pylist(), words) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fingerprint(s) for s in kept], pa.binary()), pa.array([s.view(np.int64) for s in kept], pa.list_(pa.int64()))], names=["node", "hashes"]
                )

    placed = source.select(F.pmod(F.xxhash64("ref"), F.lit(bits)).alias("place"), F.col("text").cast("binary").alias("text"))
    found = placed.mapInArrow(run, "node binary, hashes array<long>").join(alive.select("node", "n"), "node").dropDuplicates(["node"])
    with arrow_batches(source.sparkSession, BATCH):
        sets = materialise(found.select(F.monotonically_increasing_id().alias("id"), "node", "n", "hashes"), "sets")
    shared.destroy()
    return sets


def _ceil(a: Column, num: int, den: int) -> Column:
    """ceil(a * num / den) of whole numbers."""
    return F.floor((a * num + (den - 1)) / F.lit(den)).cast("long")


def _filters(num: int, den: int) -> Column:
    """Length, positional and suffix filter on columns with and without ``y_``. The suffix filter bounds the overlap by
    the smaller counts of shared shingles in each of ``HISTOGRAM`` classes."""
    n, y_n = F.col("n"), F.col("y_n")
    need = _ceil(n + y_n, num, num + den)
    length = (den * n >= num * y_n) & (den * y_n >= num * n)
    position = F.least(n - F.col("pos"), y_n - F.col("y_pos")) >= need
    suffix = F.aggregate(F.zip_with("hist", "y_hist", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v) >= need
    return length & position & suffix


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): each pair is compared once, on its full sets. A node with very many pairs has
    them dealt to parts, and its set goes to those parts."""
    dealt = pairs.select("a", "b", *[F.pmod(F.xxhash64(o), F.lit(PARTS)).cast("int").alias(f"part_{c}") for c, o in ("ab", "ba")])
    side = lambda c: dealt.select(c, f"part_{c}").distinct().join(sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}")), c)
    both = dealt.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"])
    both = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("i"), F.size("ha").alias("na"), F.size("hb").alias("nb"))
    return both.where((den + num) * F.col("i") >= num * (F.col("na") + F.col("nb"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "y_id").alias("a"), F.greatest("id", "y_id").alias("b")).where("a <> b").distinct()


def _apart(held: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a prefix shingle and pass the filters; ``held`` has the
    postings with ``comp``.

    The smaller set is looked up by its shorter prefix. Sets meet in classes of length, where linked ones are at most one
    apart, and a shingle's list is cut into blocks of ``BLOCK_POSTINGS``, which all its other entries visit."""
    short = F.col("pos") <= F.col("n") - _ceil(F.col("n"), 2 * num, num + den)
    blocks = F.ceil(F.count_if(short) / F.lit(BLOCK_POSTINGS)).cast("int")
    mixed = held.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).where("lo <> hi AND blocks > 0")
    size_class = F.floor(F.log("n") / F.lit(float(np.log(den / num) * 1.001))).cast("int")
    open_ = lookup(held, "h", mixed.select("h", "blocks")).withColumn("class", size_class)
    x = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    y = open_.where(short).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    y = y.select("h", "block", F.explode(F.array("class", F.col("class") + 1)).alias("class"), *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "pos", "hist", "comp")])
    bigger = (F.col("n") > F.col("y_n")) | ((F.col("n") == F.col("y_n")) & (F.col("id") > F.col("y_id")))
    return _ordered(x.join(y, ["h", "block", "class"]).where(bigger & (F.col("comp") != F.col("y_comp")) & _filters(num, den)))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets in ``a`` with all in ``b``. Frequent shingles are columns of a matrix
    product, rare ones are counted pair by pair."""
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    _, column = np.unique(np.concatenate(a + b), return_inverse=True)
    cut, width = int(sizes[0].sum()), int(column.max()) + 1
    rows, columns = [np.repeat(np.arange(len(n)), n) for n in sizes], [column[:cut], column[cut:]]
    da, db = (np.bincount(c, minlength=width) for c in columns)
    counts = np.zeros((len(a), len(b)), np.int64)

    hot = np.flatnonzero(da * db * 100 > len(a) * len(b))
    place = np.full(width, -1)
    place[hot] = np.arange(len(hot))
    for at in range(0, len(hot), 2048):
        n, dense = min(2048, len(hot) - at), []
        for r, c in zip(rows, columns, strict=True):
            p = place[c] - at
            inside = (p >= 0) & (p < n)
            m = np.zeros((sizes[len(dense)].size, n), np.float32)
            m[r[inside], p[inside]] = 1
            dense.append(m)
        counts += (dense[0] @ dense[1].T).astype(np.int64)

    rare = (place < 0) & (da > 0) & (db > 0)
    order = np.argsort(columns[1], kind="stable")
    first = np.cumsum(db) - db
    ra, ca = rows[0][rare[columns[0]]], columns[0][rare[columns[0]]]
    ends = np.cumsum(db[ca])
    at = 0
    while at < len(ra):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000)))
        n = db[ca[at:to]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = rows[1][order[np.repeat(first[ca[at:to]], n) + inner]]
        counts += np.bincount(np.repeat(ra[at:to], n) * len(b) + other, minlength=counts.size).reshape(counts.shape)
        at = to
    return counts


def _links_in_group(table: pa.Table, num: int, den: int) -> pa.Table:
    """id and number of links of the nodes of a group: inside one block, or between two."""
    ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
    if block.min() == block.max() and table.column("i")[0].as_py() != table.column("j")[0].as_py():  # the other block is empty
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(np.zeros(len(ids)), pa.int64())})
    hashes = table.column("hashes").combine_chunks()
    if isinstance(hashes, pa.ChunkedArray):
        hashes = pa.concat_arrays(hashes.chunks)
    flat, ends = hashes.flatten().to_numpy(), np.cumsum(hashes.value_lengths().to_numpy())
    sets = np.split(flat, ends[:-1])
    x = np.flatnonzero(block == block.min())
    y = np.flatnonzero(block == block.max())
    n = np.diff(ends, prepend=0)
    linked = (den + num) * _overlaps([sets[k] for k in x], [sets[k] for k in y]) >= num * (n[x][:, None] + n[y][None, :])
    found = np.zeros(len(ids), np.int64)
    if block.min() == block.max():
        np.fill_diagonal(linked, False)
        found[x] = linked.sum(axis=1)
    else:
        found[x], found[y] = linked.sum(axis=1), linked.sum(axis=0)
    return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(found, pa.int64())})


def _link_counts(comps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """id and n_links, the number of nodes linked with it, for all nodes in ``comps`` (id, comp), from all pairs inside
    each component. The nodes of a large component get blocks by a hash, and each pair of blocks is a group; small
    components share groups, where pairs of different components fail the comparison like others."""
    blocks = lambda: F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_KEYS)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_NODES)), F.lit(1)).cast("int")
    sizes = comps.join(sets.select("id", "n"), "id")
    sized = sizes.groupBy("comp").agg(blocks().alias("blocks"))
    bins = sizes.agg(blocks()).first()[0]
    placed = materialise(lookup(comps, "comp", sized), "placed")
    rows = placed.join(sets.select("id", "hashes"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    small = rows.where("blocks = 1").select(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "block", "id", "hashes")
    large = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.col("comp").alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "hashes")
    found = small.unionByName(large).groupBy("g", "i", "j").applyInArrow(lambda t: _links_in_group(t, num, den), "id long, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n_links"))


def near_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id, and n_links with ``count_links``.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. Two documents link if
    den * intersection >= num * union of their sets of shingles of ``words`` words; component_id is the smallest id
    reachable by links, itself included, class_id the smallest id with an equal set, and n_links the number of other
    sets that the document's set links with, all of them: their number, and the work to count them, may grow with the
    square of a component's size, while components alone take about linear work. A text without words (null
    and empty ones too) has no shingles and links with nothing. Null ids take part, but give no component its number;
    a component of null ids only has a null id. Repeated ids are separate rows. Very long texts are shingled whole. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("ref"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    ranges = max(1, round(SAMPLE * total["size"] / 7 / RANGE_KEYS))
    buckets = max(1, -(-total["n"] // BUCKET_NODES))

    with arrow_batches(docs.sparkSession, BATCH):
        passed = materialise(_first_pass(source, words, ranges), "shingles")
    rows = materialise(passed.where("slice IS NULL").select("ref", "doc_id", "node", "node_id", "n", "sampled", "local"), "documents")
    blobs = passed.where("slice IS NOT NULL").select("slice", "keys", "owners")
    hits = blobs.groupBy("slice").applyInArrow(lambda t: _shared_in_slice(t, buckets), "bucket int, nodes binary, hits binary")
    hits = materialise(hits, "hits")
    discard(passed)
    summed = hits.groupBy("bucket").applyInArrow(_sum_hits, "node_id long, hits long")
    # A shingle shared within every task that has the node is counted by the smallest of their local counts at least.
    nodes = rows.where("node IS NOT NULL").groupBy("node", "node_id").agg(
        F.min("ref").alias("ref"), F.max("n").alias("n"), F.max("sampled").alias("sampled"), F.min("local").alias("local"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")
    )
    nodes = nodes.join(summed, "node_id", "left").withColumn("found", F.col("local") + F.coalesce("hits", F.lit(0)))
    nodes = materialise(nodes, "nodes")
    discard(hits)
    alive = nodes.where(F.col("sampled") - F.col("found") <= F.col("n") - _ceil(F.col("n"), num, den)).select("node", "ref", "n")
    sets = _survivor_sets(source, words, alive)

    tokens = sets.select("id", "n", F.explode("hashes").alias("h"))
    counts = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = lookup(tokens, "h", counts)
    order = Window.partitionBy("id").orderBy("df", "h")
    everything = Window.partitionBy("id")
    histogram = F.array(*[F.sum((F.pmod("h", F.lit(HISTOGRAM)) == k).cast("int")).over(everything).cast("int") for k in range(HISTOGRAM)])
    placed = shared.select("id", "n", "h", (F.col("n") - F.count(F.lit(1)).over(everything) + F.row_number().over(order) - 1).alias("pos"), histogram.alias("hist"))
    postings = materialise(placed.where(F.col("pos") <= F.col("n") - _ceil(F.col("n"), num, den)), "postings")

    # First round: every prefix shingle links its nodes to a pivot, the one that has it earliest in its order.
    pivot = postings.groupBy("h").agg(F.min(F.struct("pos", "id", "n", "hist")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    star = lookup(postings, "h", pivot.select("h", *[F.col(f"p.{c}").alias(f"y_{c}") for c in ("pos", "id", "n", "hist")]))
    star = materialise(_ordered(star.where((F.col("id") != F.col("y_id")) & _filters(num, den))), "star")
    first = materialise(_verify(star, sets, num, den), "links")
    comps = connected_components(first)

    # Second round: pairs between nodes that are still apart.
    held = postings.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    held = materialise(held, "held")
    discard(postings, comps)
    more = materialise(_verify(_apart(held, num, den).join(star, ["a", "b"], "left_anti"), sets, num, den), "links")
    discard(held, star)
    comps = connected_components(first.unionByName(more)).withColumnRenamed("node", "id")
    discard(first, more)

    named = comps.join(sets.select("id", "node"), "id").join(nodes.select("node", "class_id"), "node")
    degree = [materialise(_link_counts(comps, sets, num, den), "degrees")] if count_links else []
    for d in degree:
        named = named.join(d, "id")
    extra = ["n_links"] * count_links
    lowest = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    linked = materialise(lookup(named, "comp", lowest).select("node", "component_id", "class_id", *extra), "linked")
    discard(sets, comps, *degree)
    none = F.lit(0).cast("long")
    copies = nodes.where("copies > 1").select("node", F.col("class_id").alias("component_id"), "class_id", *[none.alias(c) for c in extra])
    known = linked.unionByName(copies.join(linked.select("node"), "node", "left_anti")).withColumn("found", F.lit(True))
    out = lookup(rows.select("ref", "doc_id", "node", "n"), "node", known, "left")
    own = lambda c: F.when(F.col("found").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id"), own("class_id"), *[F.coalesce(c, none).alias(c) for c in extra], "ref"), "near")
    discard(rows, nodes, linked)
    return out


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component the one with the smallest id, and all
    texts without words. Of rows that repeat an id and a text, one stays; rows that repeat an id with other texts stay
    or go together."""
    groups = near_groups(docs, words, num, den, id_col, text_col)
    key, ref = fresh(docs, "key", "ref")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("ref").alias(ref)).distinct()
    tagged = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    tagged = tagged.withColumn(ref, F.coalesce(F.col(id_col).cast("long"), F.col(key)))
    return tagged.join(stay, ref, "left_semi").dropDuplicates([ref, key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(words: int = 5, num: int = 80, den: int = 100) -> str:
    """``near_groups`` without ``ref`` in DuckDB's SQL: shingle sets as sorted lists, pairs that share one of the rarest
    shingles of both, compared on the whole lists, and components by recursion."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' ')))) END AS s FROM words),
nodes AS MATERIALIZED (SELECT s, min(doc_id) AS class_id, min(row) AS node, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
items AS MATERIALIZED (SELECT node, n, unnest(s) AS h FROM nodes),
counted AS (SELECT node, n, h, row_number() OVER (PARTITION BY node ORDER BY df, h) AS k FROM items JOIN (SELECT h, count(*) AS df FROM items GROUP BY h) USING (h)),
rare AS (SELECT node, n, h FROM counted WHERE k <= n - ({num} * n + {den} - 1) // {den} + 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM rare a JOIN rare b ON a.h = b.h AND a.node < b.node AND {den} * a.n >= {num} * b.n AND {den} * b.n >= {num} * a.n),
compared AS (SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS i FROM pairs JOIN nodes x ON a = x.node JOIN nodes y ON b = y.node),
links AS MATERIALIZED (SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM compared WHERE {den} * i >= {num} * (total - i)),
reached AS (SELECT node, node AS far FROM nodes UNION SELECT reached.node, b FROM reached JOIN links ON far = a),
components AS (SELECT reached.node, min(class_id) AS component_id FROM reached JOIN nodes ON far = nodes.node GROUP BY reached.node)
SELECT doc_id, len(shingled.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id
FROM shingled LEFT JOIN nodes ON shingled.s = nodes.s LEFT JOIN components USING (node)
"""
