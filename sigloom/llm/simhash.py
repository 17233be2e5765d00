"""SimHash near-dedup with a Gray-order hierarchical index (operator 1).

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64 hashes of the text's word shingles.
Fingerprints within `distance` bits of one another are linked, and linked documents form a component.

The index works on distinct fingerprints (a group of equal ones is one entry with its smallest id):

1. Upper nodes: a node is a mask and the pattern that its members share under it. The first masks split the bits into
   distance + 1 bands; two linked fingerprints agree on one band at least, so they meet in one node at least. A node
   with more than `leaf` members is factored further: its free bits are split into bands again, each child adding one
   band to the mask. Members meet in some child by the same argument, so nothing is lost, at any depth.
2. Leaves: members in Gray order (neighbours differ in few bits) under a tree whose inner nodes hold the bits that all
   below share. A search carries the differences counted so far down the tree and drops a whole group as soon as they
   exceed the distance. What it finds is joined there, and each member gives one link to the first of its part: links
   grow with the members, not with their pairs.
3. The links of all leaves are joined to components over the cluster (see components()).

Defined results: a null text counts as empty; a text without words has fingerprint 0 and is linked like any other; a
text with fewer words than a shingle is one shingle; equal rows share a component; a null id names a component only where all ids are null;
a very long text is read whole, its shingles hashed a block at a time; only the named columns are read, so columns of any
name may be there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import components, materialize, read_table, text_batches

SEED = 42
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, width: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    n, ones = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        h = np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(lo, min(n, lo + _CHUNK))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return run(text)


def _bands(free: int, parts: int) -> list[int]:
    bits = [i for i in range(64) if free >> i & 1]
    cut = [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]
    return [sum(1 << i for i in band) for band in cut if band]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    g = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    return g


class GrayTree:
    """Fingerprints in Gray order under inner nodes of `fan` children that hold the bits shared by all below."""

    def __init__(self, fps: np.ndarray, fan: int = 8):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps, self.fan = fps[self.order], fan
        full = np.full(len(fps), ~np.uint64(0))
        levels = [(full, self.fps)]
        while len(levels[-1][0]) > fan:
            mask, pattern = levels[-1]
            at = np.arange(0, len(mask), fan)
            every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            levels.append((shared, every & shared))
        self.levels = levels[::-1]  # a child counts only the bits that its parent does not share
        for k in range(len(self.levels) - 1, 0, -1):
            mask, pattern = self.levels[k]
            above = np.repeat(self.levels[k - 1][0], fan)[: len(mask)]
            self.levels[k] = (mask & ~above, pattern & ~above)

    def pairs(self, distance: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j in the tree's order, of all pairs within the distance, a block of queries at a time."""
        n, depth = len(self.fps), len(self.levels)
        for lo in range(0, n, block):
            q = np.arange(lo, min(n, lo + block))
            top = len(self.levels[0][0])
            who, node = np.repeat(q, top), np.tile(np.arange(top), len(q))
            diff = np.zeros(len(who), np.uint8)
            for k, (mask, pattern) in enumerate(self.levels):
                span = self.fan ** (depth - 1 - k)
                ok = (node + 1) * span - 1 > who  # only later members
                who, node, diff = who[ok], node[ok], diff[ok]
                diff = diff + np.bitwise_count((self.fps[who] & mask[node]) ^ pattern[node])
                ok = diff <= distance
                who, node, diff = who[ok], node[ok], diff[ok]
                if k + 1 < depth:
                    child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    ok = child < len(self.levels[k + 1][0])
                    who, node, diff = np.repeat(who, self.fan)[ok], child[ok], np.repeat(diff, self.fan)[ok]
            yield who, node


def least_labels(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place of n that each place reaches over the pairs (i, j), given in blocks."""
    label = np.arange(n)
    for i, j in found:
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    return label


def leaf_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, the first of its part) for the parts of one leaf that have two members or more."""
    tree = GrayTree(fps)
    label = least_labels(len(fps), tree.pairs(distance))
    values = tree.fps.view(np.int64)
    rest = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(values[rest].tolist(), values[label[rest]].tolist(), strict=True))


def _leaf_task(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
                rest = now if rest is None else np.concatenate([rest, now], axis=1)
            if rest is None or not rest.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, (rest[:2, 1:] != rest[:2, :-1]).any(0)])
            ends = np.r_[starts[1:], rest.shape[1]]
            whole = len(starts) - (batch is not None)  # the last leaf may go on in the next batch
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[:whole].tolist(), ends[:whole].tolist(), strict=True):
                if e - s > 1:
                    out += leaf_links(rest[2, s:e].view(np.uint64), distance)
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            rest = rest[:, starts[whole] :] if whole < len(starts) else None

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(fps: DataFrame, distance: int = 2, leaf: int = 4096) -> DataFrame:
    """fps (fp: distinct longs) -> links (a, b) that join all fingerprints within the distance, directly or by others."""
    text_batches(fps.sparkSession)
    leaf, leaves = max(leaf, 1 << distance), []  # a node with too few free bits for another level is no larger
    masks = _bands((1 << 64) - 1, distance + 1)
    nodes = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        nodes = nodes.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        heavy = materialize(nodes.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > leaf).drop("n"), "heavy")
        if heavy.isEmpty():
            leaves.append(nodes)
            break
        leaves.append(nodes.join(heavy, ["mask", "pattern"], "left_anti"))
        masks = [r[0] for r in heavy.select("mask").distinct().collect()]  # at most (distance + 1) ** depth of them
        child = F.coalesce(*[F.when(F.col("mask") == m, F.array(*[F.lit(_signed(b | m & (1 << 64) - 1)) for b in _bands(~m & (1 << 64) - 1, distance + 1)])) for m in masks])
        large = nodes.join(heavy, ["mask", "pattern"], "left_semi")
        nodes = materialize(large.select("fp", F.explode(child).alias("mask")), "nodes")
    out = None
    for part in leaves:
        part = part.select("mask", "pattern", "fp").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
        got = part.mapInArrow(_leaf_task(distance), "a long, b long")
        out = got if out is None else out.unionByName(got)
    return out


def near_components(keys: DataFrame, distance: int = 2, leaf: int = 4096) -> DataFrame:
    """keys (fp, k: any value that can be ordered) -> (fp, rep): rep is the smallest k of fp's component."""
    own = materialize(keys.groupBy("fp").agg(F.min("k").alias("own")), "fps")
    roots = components(links(own.select("fp"), distance, leaf))
    roots = materialize(roots.withColumnRenamed("node", "fp"), "roots")
    low = roots.join(own, "fp").groupBy("root").agg(F.min("own").alias("rep"))
    rep = materialize(roots.join(materialize(low, "low"), "root").select("fp", "rep"), "reps")
    return materialize(own.join(rep, "fp", "left").select("fp", F.coalesce("rep", "own").alias("rep")), "classes")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", fingerprint(F.col("text"), 3).alias("fp")), "prints")
    reps = near_components(rows.select("fp", F.col("doc_id").alias("k")))
    out = rows.join(reps, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep").alias("component_id"))
