"""Sequence packing: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents.

Tokenising is a map over the documents; only (document, piece, length) rows are shuffled. Documents are dealt to groups
by a seeded hash of the id, so every group holds about ``group_docs`` documents whatever the size of the table; the pieces
of a document longer than a sequence, rows without id and repeated rows are dealt one by one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import materialise

CAPACITY = 2048
GROUP_DOCS = 4096
END_ID = 1
#: Words remembered by a Python worker; at the bound the memory starts anew.
CACHE_WORDS = 1_000_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("deal", pa.int64())])


class WordCache:
    """Token ids of white-space separated chunks as little-endian bytes.

    The tokenizer lower-cases, drops white space and never looks across it, so a text's ids are its chunks' ids in a
    row, and a chunk is encoded once as long as it is remembered. After letters, a run of full stops and commas at the
    chunk's end is a pre-token of its own. Rare words are most of the new ones; those of letters only are encoded many in
    one call, and cut apart where a token ends a word. A special token's string is found anywhere in a text, also across
    chunks' ends; texts that hold one are encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _encode_each(self, words: list[bytes]) -> None:
        done = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, done, strict=True))

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of letters give one pre-token each; if the word ends don't come out even, each word goes by itself."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        if len(ends) != len(words) or ends[-1:] != [4 * len(ids)]:
            self._encode_each(words)
            return
        data = ids.tobytes()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends))

    def _learn(self, chunks: list[bytes]) -> None:
        known, tails, letters, others = self.known, [], set(), set()
        for c in chunks:
            core = c.rstrip(b".,")
            if not (core.isalpha() or core.decode().lower().isalpha()):
                others.add(c)
                continue
            letters.add(core)
            if core != c:
                tails.append((c, core, c[len(core) :]))
                others.add(c[len(core) :])
        letters, others = ([w for w in some if w not in known] for some in (letters, others))
        for some, encode in ((letters, self._encode_letters), (others, self._encode_each)):
            for at in range(0, len(some), 5000):
                encode(some[at : at + 5000])
        known.update((c, known[core] + known[tail]) for c, core, tail in tails)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        lower = [t.lower() for t in texts]  # of bytes: A-Z only, and split at ASCII white space only
        whole = [any(s in t for s in self.special) for t in lower]
        if any(whole):
            done = self.tokenizer.encode_batch_fast([t.decode() for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False)
            some = iter(np.array(e.ids, "<u4").tobytes() for e in done)
            rest = iter(self.encode([t for t, w in zip(texts, whole, strict=True) if not w]))
            return [next(some) if w else next(rest) for w in whole]
        known, split = self.known, [t.split() for t in lower]
        new = [w for w in set().union(*split) if w not in known]
        if new:
            self._learn(new)
        return [b"".join([known[w] for w in words]) for words in split]


#: One per vocabulary file in each Python worker; a worker's later tasks find it filled.
_CACHES: dict[str, WordCache] = {}


def word_cache(tokenizer_file: str) -> WordCache:
    if tokenizer_file not in _CACHES:
        _CACHES[tokenizer_file] = WordCache(tokenizer_file)
    return _CACHES[tokenizer_file]


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces: full ones of ``capacity`` ids, then the rest."""
    view, step = memoryview(ids), capacity * 4
    return [(at // 4, len(view[at : at + step]) // 4, zlib.crc32(view[at : at + step])) for at in range(0, len(ids), step)]


def document_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and cut: doc_id, start, length, ids_crc32, doc_tokens, deal. A null text counts as empty: one end id.

    ``deal`` tells apart what must not share a group by its id alone: the pieces of a long document, rows without id, and
    rows of one batch that repeat an id."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_file)
        for batch in batches:
            seen, nth = Counter(), []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = cache.encode([t or b"" for t in part.column(1).to_pylist()])
                docs_here = part.column(0).to_pylist()
                for doc in docs_here:
                    nth.append(seen[doc])
                    seen[doc] += 1
                rows = [
                    (doc, start, length, crc, len(ids) // 4, start + (k << 32) + (crc << 1 if doc is None else 0))
                    for doc, ids, k in ((d, x + end, k) for d, x, k in zip(docs_here, found, nth[-len(docs_here) :], strict=True))
                    for start, length, crc in pieces_of(ids, capacity)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=PIECES)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. ``lengths`` must be in decreasing order.

    The tree's leaves are the bins in order of opening, each holding its free room; an inner node holds the larger
    room of its two children. The first bin that fits is found from the root: left where the left child has room.
    """
    size = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [capacity] * (2 * size)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, need in enumerate(lengths.tolist()):
        node = 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, without ``deal``. ``n_pieces`` sets the number of groups,
    of about ``group_docs`` pieces each, however long the documents.

    Sequence ids are unique over all groups (group * 2^32 + bin). Within a group equal lengths are taken in order of
    (doc_id, start, crc), so the result doesn't depend on partitioning.
    """
    groups = max(1, -(-n_pieces // group_docs))

    def fill(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(order)
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("grp").to_numpy().astype(np.int64)
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "deal"), F.lit(groups))).drop("deal")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("grp").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack all of ``docs`` into sequences of at most ``capacity`` tokens; one row per piece.

    Every document ends with the id 1; a null or empty text is that id alone. A text longer than a sequence is cut at
    multiples of ``capacity``. Repeated rows are packed as often as they occur; a null id is kept as null. Pieces of equal
    length are taken in order of id, start and crc. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    pieces = materialise(document_pieces(docs, tokenizer_file, id_col, text_col, capacity), "pieces")
    return pack(pieces, pieces.count(), capacity, group_docs)
