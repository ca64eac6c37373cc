"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

A text becomes counts of hashed byte trigrams and of a few character and repetition measures. A truncated singular
value decomposition of a bounded sample of labelled texts gives the latent space. The labelled vectors (at most
``max_labelled`` x ``dims`` floats, so a few hundred kilobytes) are broadcast; every document's cosines with all of
them are exact, computed in blocks of documents, and its nearest labelled texts vote with their similarity, raised to
``SHARPNESS``, as weight. Of equally near texts those earlier in the sample's order (by a hash of the id) vote.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, DIMS, NEIGHBOURS, MAX_LABELLED, BLOCK = 1024, 32, 15, 3000, 512
#: Cosines of texts in one language lie close together; this power of a cosine is a vote's weight.
SHARPNESS = 8
#: Most bytes of labelled texts that come to the driver.
MAX_LABELLED_BYTES = 64 << 20
#: Weight of the measured features against the unit vector of the trigram counts.
MEASURE_WEIGHT = 1.0

_KIND = np.zeros(256, np.int8)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:-'\"()", b"!?", b"#*$%&|<>=_+@/\\~^{}[]"), 1):
    _KIND[list(_chars)] = _kind
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")
KINDS = 9


class Model(NamedTuple):
    idf: np.ndarray  # BUCKETS
    axes: np.ndarray  # features x DIMS
    vectors: np.ndarray  # labelled x DIMS, unit length
    labels: np.ndarray
    prior: float


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of trigram counts (BUCKETS), then measures of the whole text."""
    out = np.zeros((len(texts), BUCKETS + KINDS + 3), np.float32)
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text, np.uint8)
        b = _FOLD[raw].astype(np.uint32)
        if len(b) > 2:
            key = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            out[k, :BUCKETS] = np.bincount((key * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=BUCKETS)
        kinds = np.bincount(_KIND[raw], minlength=KINDS) / len(raw)
        words, lines = text.split(), text.split(b"\n")
        out[k, BUCKETS : BUCKETS + KINDS] = np.minimum(1, kinds * (1, 1, 3, 5, 3, 5, 5, 10, 10))
        same = sum(map(bytes.__eq__, words[1:], words)) / max(1, len(words))
        out[k, BUCKETS + KINDS :] = (same, 1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / len(lines))
    return out


def weigh(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    grams = np.log1p(raw[:, :BUCKETS]) * idf
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    return np.hstack([grams, MEASURE_WEIGHT * raw[:, BUCKETS:]])


def project(raw: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = weigh(raw, idf) @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def fit(texts: list[bytes], labels: np.ndarray, dims: int = DIMS) -> Model:
    """Latent axes from the labelled texts: the leading right singular vectors of their weighted counts."""
    raw = features(texts)
    seen = (raw[:, :BUCKETS] > 0).sum(axis=0)
    idf = np.log((1 + len(texts)) / (1 + seen)).astype(np.float32) + 1
    x = weigh(raw, idf)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, :dims].astype(np.float32)
    return Model(idf, axes, project(raw, idf, axes), labels.astype(np.float32), float(labels.mean()))


def vote(model: Model, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled texts, one block of documents at a time. A text
    without any positive similarity, such as an empty one, gets the share of label 1 in the sample."""
    near = min(neighbours, len(model.labels))
    scores = np.full(len(texts), model.prior)
    full = [k for k, t in enumerate(texts) if t]
    for at in range(0, len(full), BLOCK):
        block = full[at : at + BLOCK]
        cosines = project(features([texts[k] for k in block]), model.idf, model.axes) @ model.vectors.T
        best = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
        last = np.take_along_axis(cosines, best, axis=1).min(axis=1, keepdims=True)
        for k in np.flatnonzero((cosines >= last).sum(axis=1) > near):  # a tie for the last vote
            best[k] = np.argsort(-cosines[k], kind="stable")[:near]
        weight = np.maximum(np.take_along_axis(cosines, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        scores[block] = np.where(total > 0, (weight * model.labels[best]).sum(axis=1) / np.maximum(total, 1e-300), model.prior)
    return np.clip(scores, 0, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES, held_out: bool = True) -> Model:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of the id over all labelled ones, and at most
    ``max_bytes`` of their texts: in that order a text that doesn't fit into what is left is passed over, and only it.

    With ``held_out``, ids whose crc32 (of the decimal id) leaves 1 modulo 3 are never learned from. Null labels and
    ids without a document are left out; of an id labelled twice the smallest label counts, of an id with several texts
    the shortest text (ties by a hash of it). Sizes are looked at first, so texts that aren't taken never move. Without
    any labelled document the model has no neighbours and every score is 0.5.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    if held_out:
        rows = rows.where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    rows = rows.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash"))
    sizes = texts.join(F.broadcast(rows), "id").groupBy("id", "label").agg(F.min(F.struct("size", "hash")).alias("t"))  # max_labelled rows at most
    taken, room = [], max_bytes
    for r in sizes.orderBy(F.xxhash64("id"), "id").collect():
        if r.t.size <= room:
            taken.append((r.id, r.label, r.t.size, r.t.hash, len(taken)))
            room -= r.t.size
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(taken, f"id {kind}, label int, size int, hash long, place int")
    sample = texts.join(F.broadcast(chosen), ["id", "size", "hash"]).groupBy("place", "label").agg(F.min("text").alias("text")).orderBy("place").toPandas()
    if not len(sample):
        return Model(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS + KINDS + 3, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    return fit([t.encode() for t in sample["text"]], sample["label"].to_numpy())


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and score, predicted, computed from the text alone. A column of ``docs`` that has one of
    these names is an error."""
    names = docs.columns
    if clash := {"score", "predicted"} & {c.lower() for c in names}:
        raise ValueError(f"rename {sorted(clash)} first: the scores take that name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part.column(names.index(text_col)).cast(pa.binary()).to_pylist()
                score = vote(m, [t or b"" for t in texts]) if len(m.labels) else np.full(len(texts), m.prior)
                more = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns unchanged."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    scored = score_documents(plain, model, text_col=f"c{docs.columns.index(text_col)}", threshold=threshold).where("predicted = 1")
    return scored.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text counts as empty; very long texts are scored whole, and ties among neighbours go to the earlier row of the
    sample. Null and empty texts get the sample's share of label 1. Ids may be null (then
    held_out is null) or repeated; equal texts get equal scores. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    model = train(docs, labels, id_col, text_col, max_labelled=max_labelled)
    scored = score_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
