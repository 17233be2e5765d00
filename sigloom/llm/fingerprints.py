"""Document fingerprints by content-defined chunking (operator 11).

A gear hash runs over the text's UTF-8 bytes; a chunk ends where masked bits of it are zero, so boundaries depend on the
few bytes before them and move with the text when something is put in or taken out elsewhere. Sizes are normalised: no
boundary before LEAST bytes, a rare one (STRICT) up to NORMAL bytes, an easy one (LOOSE) after it, a forced one at MOST.
The hash is the sum of the last 16 bytes' gears, each shifted by its distance, in 16 bits; it does not start anew at a
boundary, so chunks fall in step again soon after an edit (about 65 bytes of a text are lost to one that puts words in), and all places are hashed at once.

A fingerprint is the set of the distinct chunks' digests (48 bits), each with a weight: the bytes that it covers in the
text. As a string it is one row of 20 hexadecimal digits a chunk (12 of the digest, 8 of the weight), in order of
digests; the empty text's is empty.
`containment(a, b)` is the weight that b holds of a (the smaller of both weights, digest by digest), over a's weight.

Defined results: a null text counts as empty; two empty texts contain each other (1), an empty one and another do not (0);
equal texts have equal fingerprints; a text of fewer than LEAST bytes is one chunk; very long texts are chunked whole, one
at a time; an empty table gives an empty result; only the named columns are read, so columns of any name may be there.
Two chunks share a digest by chance with a probability of 2^-48 a pair.

The query compares each document with the next one in descending order of doc_id. Ids are cut into ranges by approximate
quantiles of the ids alone, and whole texts are shuffled once, to their range; the first document of each range goes to
the range before as well, so a task walks through its range in order. Nulls come last in the order; rows with the same id
follow each other by a hash of their place in the table, and a range may begin among them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import identified, read_table

LEAST, NORMAL, MOST = 12, 32, 128
STRICT, LOOSE = 0xF800, 0xF000
WINDOW = 16
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 16) & 0xFFFF for b in range(256)], np.uint16)
_BLOCK = 1 << 22
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the WINDOW bytes that end with it (fewer at the start)."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        later = h[span:] + (h[:-span] << np.uint16(span))
        h = np.concatenate([h[:span], later])
        span *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """The ends of all chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    loose: list[np.ndarray] = []
    strict: list[np.ndarray] = []
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, n, _BLOCK):  # a block of a very long text at a time, with the bytes before it that count
        back = min(lo, WINDOW - 1)
        h = gear_hashes(raw[lo - back : lo + _BLOCK])[back:]
        at = np.flatnonzero((h & LOOSE) == 0)
        loose.append(at + (lo + 1))
        strict.append(at[(h[at] & STRICT) == 0] + (lo + 1))
    easy, rare = [*np.concatenate(loose).tolist(), n], [*np.concatenate(strict).tolist(), n]
    ends, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        j = bisect_left(rare, at + LEAST, j)
        if rare[j] < at + NORMAL:
            at = rare[j]
        else:
            i = bisect_left(easy, min(at + NORMAL, n), i)
            at = min(easy[i], at + MOST)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def weights(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct digests in order, and the bytes that each covers."""
    ends, digest = boundaries(data), xxhash.xxh64_intdigest
    starts = [0, *ends[:-1]]
    digests = np.fromiter((digest(data[a:b]) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends)) >> np.uint64(16)
    keys, place = np.unique(digests, return_inverse=True)
    return keys, np.bincount(place, np.diff([0, *ends]), len(keys)).astype(np.uint32)


def encode(keys: np.ndarray, covered: np.ndarray) -> str:
    rows = np.concatenate([keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:], covered.astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    return rows.tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 10)
    keys = np.zeros((len(rows), 8), np.uint8)
    keys[:, 2:] = rows[:, :6]
    return keys.view(">u8").ravel().astype(np.uint64), rows[:, 6:].copy().view(">u4").ravel().astype(np.uint32)


def contained(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0)
    return float(shared.sum() / a[1].sum(dtype=np.int64))


def fingerprint(text: str | Column) -> Column:
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(*weights((t or "").encode("utf-8", "surrogatepass"))))

    return run(text)


def containment(a: str | Column, b: str | Column) -> Column:
    """How much of fingerprint a is in fingerprint b, 0 to 1. Null counts as the empty text's."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([contained(decode(x or ""), decode(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


# ---------------------------------------------------------------- the query


def edited(text: str, after: str) -> str:
    """The second half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class _Document:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.weights = weights(text.encode("utf-8", "surrogatepass"))
        self.fingerprint = encode(*self.weights)

    def compared(self, after: _Document) -> tuple:
        other = edited(self.text, after.text).encode("utf-8", "surrogatepass")
        w = weights(other)
        return self.doc_id, len(self.text), hashlib.sha256(other).hexdigest(), self.fingerprint, encode(*w), contained(self.weights, w), contained(self.weights, after.weights)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, extra, doc_id, text) in order; an extra row is the one that follows the last of its part."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.large_string(), pa.large_string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _OUT.split(", ")]
    now, part = None, None
    for batch in batches:
        out = []
        for k, extra, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            here, doc = k.as_py(), _Document(doc_id.as_py(), text.as_py() or "")
            if now is not None and here == part:
                out.append(now.compared(doc))
            now, part = (None if extra.as_py() else doc), here
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs -> (part, extra, doc_id, text), to be read part by part in descending order of (extra last) doc_id, u, h.

    ranges: how many parts, the session's shuffle partitions if none is given; the table of their first rows (one row a
    part) is all that the driver holds.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed, place = identified(docs.select("doc_id", "text"), "placed")
    h = F.xxhash64(*place)
    u = F.shiftrightunsigned(h, 12).cast("double") / F.lit(float(1 << 52))
    # a number that orders rows like (doc_id, u); rows of one id are spread by u while ids are exact as doubles
    key = F.when(F.col("doc_id").isNull(), F.lit(-1e300) * (F.lit(2.0) - u)).when(F.abs("doc_id") < F.lit(1 << 50), F.col("doc_id").cast("double") + u).otherwise(F.col("doc_id").cast("double"))
    rows = placed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"), u.alias("u"), key.alias("key"))
    cuts = rows.select("key").agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    if cuts is None:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("extra"), "doc_id", "text", "u", "h").limit(0)
    cuts = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.float64)).astype(np.int32))

    rows = rows.withColumn("part", part_of("key"))
    firsts = rows.select("part", "doc_id", "u", "h").groupBy("part").agg(F.max(F.struct("doc_id", "u", "h")).alias("first")).collect()  # a row a part
    order = sorted(firsts, key=lambda r: -r["part"])
    before = [(r["first"]["doc_id"], r["first"]["h"], order[k - 1]["part"]) for k, r in enumerate(order)]
    first = spark.createDataFrame(before, "first_id long, first_h long, before int")
    joined = rows.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    own, more = F.struct("part", F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, more))
    return joined.select(F.explode(places).alias("p"), "doc_id", "text", "u", "h").select("p.part", "p.extra", "doc_id", "text", "u", "h")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_table(spark, sf_dir, "documents"))
    order = ["part", "extra", F.col("doc_id").desc_nulls_last(), F.col("u").desc(), F.col("h").desc()]
    return rows.repartition("part").sortWithinPartitions(*order).select("part", "extra", "doc_id", "text").mapInArrow(_walk, _OUT)
