"""Removal of word windows that repeat across documents, by level-wise doubling (operator 5).

A window is `length` consecutive words of one document; a word is removed where a window over it also starts in a
document with a smaller id. Windows of `first` words are looked at first, and only those that repeat in other documents
are extended to twice as many words, level by level (4, 8, then 13, as no more than `length` are asked for):

* at a level of fewer words, of the short windows inside a window of `length` words only the one with the smallest hash
  stands for it, so equal long windows name the same short one and a part of all short windows is sent. A long window
  goes on to the next level if its short one was found in two documents or more;
* the last level has the long windows that are left. What survives here is removed; longer windows consist of these, so
  the answer is complete and the doubling ends. It also ends when no candidates survive a level.

A level is a round trip. Documents lie in chunks (compressed), bucketed by chunk, so they are dealt out once and no level
sends them again. A chunk sends each distinct hash once, in blobs by hash range; one task a range compares all chunks and
answers each blob with one bit a hash. So a passage found in a third of all rows costs one entry a chunk, and no task sees
the rows of a document twice. A range has about `bucket_entries` entries, and never fewer than there are chunks, so the
entries of a few very common windows do not make it larger than others; at 100 TB raise chunk_bytes (64 MB, which makes
1.6 million chunks) and bucket_entries (32 M).

Short windows are compared by 64-bit hashes, where a false match only lets a candidate pass. Windows of the last level are
compared by 128 bits, made of 128-bit hashes of their words: among the 10^13 windows of 100 TB a false match has a
probability of about 10^-13.

Defined results: a null text has no words; a document shorter than a window loses nothing; a null id counts as larger
than all others; rows with the same id never remove each other's words, so repeated rows and ties lose the same; a very
long text is one chunk of its own, read whole; only the digest columns are returned, so columns of any name may be there;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import bucketed, materialize, read_table, text_batches

LENGTH = 13
FIRST = 4
CHUNK_BYTES = 2 << 20
BUCKET_ENTRIES = 750_000
_NO_ID = np.iinfo(np.int64).max
_REPLY = "chunk long, level int, bucket int, bits binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(length: int, first: int) -> list[int]:
    """The sizes of windows, doubled until the length is reached."""
    sizes = []
    while first < length:
        sizes.append(first)
        first *= 2
    return [*sizes, length]


def _chunked(limit: int):
    def blob(rows: list[tuple], k: int) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_binary())], names=["id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        chunk = TaskContext.get().partitionId() << 32 | k
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, k = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append((doc_id.as_py(), text))
                size += len(text) + 16
                if size >= limit:
                    yield blob(rows, k)
                    rows, size, k = [], 0, k + 1
        if rows:
            yield blob(rows, k)

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _window_hash(words: np.ndarray, length: int) -> np.ndarray:
    n = len(words) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(length if n > 0 else 0):
        out += words[j : j + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) + (j << 33)) % (1 << 64) | 1)
    return _mixed(out)


class Chunk:
    """The documents of a chunk as one row of words, and its windows."""

    def __init__(self, docs: bytes, sizes: list[int]):
        batch = pa.ipc.open_stream(docs).read_next_batch()
        ids = batch.column(0)
        self.ids, self.sizes = ids.to_pylist(), sizes
        self.order = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)
        self.docs = [t.as_buffer().to_pybytes().split() for t in batch.column(1)]  # bytes: ASCII white space alone
        # hashing each word anew is faster than looking it up
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(self.docs))), np.uint64).reshape(-1, 2)
        self.words = halves[:, 0].copy(), halves[:, 1].copy()
        self.counts = np.array([len(d) for d in self.docs], np.int64)
        self.doc = np.repeat(np.arange(len(self.docs)), self.counts)
        n = max(len(halves) - sizes[-1] + 1, 0)
        #: Where a window begins, of those that are still candidates.
        self.at = np.flatnonzero(self.doc[:n] == self.doc[sizes[-1] - 1 :]) if n else np.zeros(0, np.int64)

    def hashes(self, level: int) -> tuple[np.ndarray, ...]:
        """What stands for each candidate at a level: one number, or two at the last."""
        length, size = self.sizes[-1], self.sizes[level]
        if not len(self.at):
            return tuple(np.zeros(0, np.uint64) for _ in range(1 + (size == length)))
        if size == length:
            return tuple(_window_hash(w, length)[self.at] for w in self.words)
        short, n = _window_hash(self.words[0], size), len(self.doc) - length + 1
        low = short[:n].copy()
        for j in range(1, length - size + 1):
            np.minimum(low, short[j : j + n], out=low)
        return (low[self.at],)

    def level(self, level: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, each candidate's place in them, smallest id with each, whether a second id has it)."""
        keys, place = _distinct(self.hashes(level))
        ids = self.order[self.doc[self.at]]
        low, high = np.full(len(keys[0]), _NO_ID), np.full(len(keys[0]), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return keys, place, low, high > low

    def narrow(self, replies: pa.Table, up_to: int, buckets: int) -> None:
        """Keep the candidates that the levels before up_to have left."""
        for level in range(up_to):
            if not len(self.at):
                return
            keys, place = _distinct(self.hashes(level))
            self.at = self.at[_bits(replies, level, keys[0], buckets)[place]]


def _distinct(columns: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The distinct rows, sorted, and each row's place in them."""
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return tuple(c[new] for c in rows), place


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each range of the sorted keys begins, and the end."""
    which = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(buckets + 1, dtype=np.uint64))


def _bits(replies: pa.Table, level: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers for the sorted keys, in their order."""
    cut, out = _ranges(keys, buckets), np.zeros(len(keys), bool)
    for lev, b, bits in zip(replies["level"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True):
        if lev == level:
            n = cut[b + 1] - cut[b]
            out[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("with", pa.binary())])
_SENT_DDL = "bucket int, chunk long, keys binary, with binary"


def _sent(c: Chunk, chunk: int, level: int, buckets: int) -> pa.RecordBatch:
    """One row a range that has hashes; with them their smallest ids at the last level, else whether two ids have them."""
    keys, _, low, twice = c.level(level)
    last = level + 1 == len(c.sizes)
    cut = _ranges(keys[0], buckets)
    full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    part = [slice(cut[b], cut[b + 1]) for b in full]
    more = [low[p].tobytes() if last else np.packbits(twice[p]).tobytes() for p in part]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([b"".join(k[p].tobytes() for k in keys) for p in part], pa.binary()), pa.array(more, pa.binary())], schema=_SENT)


def _send_first(sizes: list[int], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _sent(Chunk(docs.as_py(), sizes), chunk, 0, buckets)

    return run


def _send(sizes: list[int], level: int, buckets: int):
    def run(key, docs, replies):
        c = Chunk(docs["docs"][0].as_py(), sizes)
        c.narrow(replies, level, buckets)
        return pa.Table.from_batches([_sent(c, docs["chunk"][0].as_py(), level, buckets)])

    return run


def _answer(level: int, last: bool):
    """Is the hash in two documents or more? At the last level: does a smaller id than the chunk's own have it?"""

    def run(key, sent):
        both = [np.frombuffer(x.as_py(), np.uint64).reshape(1 + last, -1) for x in sent["keys"]]
        sizes = [k.shape[1] for k in both]
        keys, place = _distinct(tuple(np.concatenate([k[i] for k in both]) for i in range(1 + last)))
        if last:
            ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in sent["with"]])
            low = np.full(len(keys[0]), _NO_ID)
            np.minimum.at(low, place, ids)
            yes = low[place] < ids
        else:
            twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(sent["with"], sizes, strict=True)])
            yes = (np.bincount(place, weights=1 + twice) > 1)[place]
        parts = np.split(yes, np.cumsum(sizes)[:-1])
        n = len(sizes)
        return pa.table({"chunk": sent["chunk"], "level": pa.array([level] * n, pa.int32()), "bucket": sent["bucket"], "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})

    return run


def _remove(sizes: list[int], buckets: int):
    last, length = len(sizes) - 1, sizes[-1]

    def run(key, docs, replies):
        c = Chunk(docs["docs"][0].as_py(), sizes)
        c.narrow(replies, last, buckets)
        keys, place, low, _ = c.level(last)
        smaller = _bits(replies, last, keys[0], buckets)[place] | (low[place] < c.order[c.doc[c.at]]) if len(place) else np.zeros(0, bool)
        edge = np.zeros(len(c.doc) + 1, np.int64)
        np.add.at(edge, c.at[smaller], 1)
        np.add.at(edge, c.at[smaller] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(c.counts)
        removed, shas = [], []
        for words, end, n in zip(c.docs, ends.tolist(), c.counts.tolist(), strict=True):
            g = gone[end - n : end]
            k = int(g.sum())
            kept = words if not k else [w for w, x in zip(words, g.tolist(), strict=True) if not x]
            removed.append(k)
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_words": pa.array(c.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_entries: int = BUCKET_ENTRIES, first: int = FIRST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    text_batches(docs.sparkSession)
    sizes = levels(length, first)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chunks = bucketed(texts.mapInArrow(_chunked(chunk_bytes), "chunk long, docs binary"), "chunk", "chunks")
    total, n = chunks.agg(F.coalesce(F.sum(F.length("docs")), F.lit(0)), F.count("*")).first()
    buckets = max(1, math.ceil(total / 12 / max(bucket_entries, n)))  # about an entry for twelve compressed bytes
    replies = None
    for level in range(len(sizes)):
        if replies is None:
            sent = chunks.mapInArrow(_send_first(sizes, buckets), _SENT_DDL)
        else:
            sent = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_send(sizes, level, buckets), _SENT_DDL)
        got = materialize(sent.groupBy("bucket").applyInArrow(_answer(level, level + 1 == len(sizes)), _REPLY), "replies")
        replies = got if replies is None else replies.unionByName(got)
        if got.isEmpty():
            break
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_remove(sizes, buckets), _OUT)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, k, array_to_string(w[k:k+12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
f AS (SELECT x, min(doc_id) AS first FROM p GROUP BY x),
g AS (SELECT DISTINCT doc_id, k + j AS pos FROM p JOIN f USING (x), range(0, 13) AS r(j) WHERE first < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT doc_id, w[pos] AS word, pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM e ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
