"""Near-dedup by SimHash at a similarity (operator 1 as the pipeline's stage).

Texts count as near copies when the sets of their word shingles have a Jaccard similarity of 0.8 or more. SimHash turns
similarity into distance: of BITS bits, two sets with cosine c differ in about BITS * arccos(c) / pi. At 0.8 that is one
bit in seven, too many for bands of equal bits, so the upper nodes of the index are made of other shared bits: the least
hashes of a set under ANCHORS hash functions. Two sets of similarity s share each anchor with probability s, and meet in
one node at least with 1 - (1 - s) ** ANCHORS (0.99994 at 0.8).

* A node is searched whole. One with more than `leaf` members (or WEIGHT shingles) is cut into classes of set sizes, as
  similar sets are in one class or in two next to one another, and classes into parts by hash; every part meets every part
  of its own class and of the next. Its cost grows with the square of a class's members, its results miss nothing.
* A block of two parts is searched by the Gray-order tree over the first 64 bits (a wide bound, to prune), and what it
  finds is compared by all bits: the candidates have at most three standard errors more bits than the similarity allows.
* First the shortest forest of candidates of each block is settled by the exact similarity of the two sets of shingles,
  which joins most of what belongs together. Then blocks that hold candidates between parts that are still separate get
  the sets of those members, and all these candidates are settled. No link rests on fingerprints alone.

Defined results: a null text counts as empty; texts without words are copies of one another; a text with fewer words
than a shingle is one shingle; of a group the row with the smallest doc_id stays (null first, then as read); a very long
text is one row, whose set of shingles a task holds; columns of any name stay with their rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import components, discard, identified, keep_rows, materialize, text_batches, with_row_id
from sigloom.llm.simhash import SEED, GrayTree, least_labels

WIDTH = 5
SIMILARITY = 0.8
BITS = 1024
ANCHORS = 6
LEAF = 2048
#: Shingles of a part of a block, and what a block's task holds at once of pairs or shingles.
WEIGHT = 1 << 22
HELD = 1 << 20
_WORDS = BITS // 64
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(_WORDS + ANCHORS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the set of shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    each = (digest(b" ".join(words[i : i + width]), SEED) for i in range(max(min(1, len(words)), len(words) - width + 1)))
    return np.unique(np.fromiter(each, np.uint64))


def sketch_of(text: str | None, width: int = WIDTH) -> tuple[bytes, list[int], int]:
    """(fingerprint, anchors, number of shingles) of the set of shingles."""
    h = shingles_of(text, width)
    if not len(h):
        return bytes(BITS // 8), [0] * ANCHORS, 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 255 * 64):
        part = _mixed(h[lo : lo + 255 * 64, None] * _MULTIPLIERS[:_WORDS])
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # a sum of 255 bits fits a byte
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    low = [int(_mixed(h * m).view(np.int64).min()) for m in _MULTIPLIERS[_WORDS:]]
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), low, len(h)


def sketch(text: Column, width: int = WIDTH) -> Column:
    @F.pandas_udf("fp binary, anchors array<long>, n long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch_of(t, width) for t in texts], columns=["fp", "anchors", "n"])

    return run(text)


def bound(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """In how many bits sets of these sizes and similarity differ; -1 where sizes alone forbid it."""
    c = similarity / (1 + similarity) * (na + nb) / np.sqrt(np.maximum(na * nb, 1))
    d = BITS * np.arccos(np.minimum(c, 1.0)) / np.pi
    return np.where((c > 1.0) & (na != nb), -1.0, d)


def joining(n: int, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs make the shortest forest that joins all that the pairs join (Boruvka's rounds)."""
    key = d.astype(np.int64) * (len(d) + 1) + np.arange(len(d))  # no two are equal
    label, out, left = np.arange(n), [], np.arange(len(d))
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            return np.unique(np.concatenate(out)) if out else left
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[i[left]], key[left])
        np.minimum.at(best, label[j[left]], key[left])
        picked = left[(key[left] == best[label[i[left]]]) | (key[left] == best[label[j[left]]])]
        out.append(picked)
        label = least_labels(n, iter([(np.r_[np.arange(n), i[picked]], np.r_[label, j[picked]])]))


class Block:
    """Members of a node that are compared: all with one another or, where there are two sides, those of one with those
    of the other. A pair counts at the first anchor that it shares, so each is looked at in one block alone."""

    def __init__(self, k: list[int], side: list[int], fps: list[bytes], anchors: list[list[int]], n: list[int], root: list[int] | None, similarity: float):
        self.fps = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), _WORDS)
        self.n, self.side, self.similarity = np.array(n, np.int64), np.array(side), similarity
        self.before = np.array(anchors, np.int64)[:, : k[0]]
        self.two = bool((self.side != self.side[0]).any())
        # the part of each member, as far as it is known
        self.label = np.arange(len(fps)) if root is None else np.unique(np.array(root, np.int64), return_inverse=True)[1]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(d, i, j) of the pairs between parts that may be similar, by their fingerprints."""
        if (self.label == self.label[0]).all():
            return
        tree, s = GrayTree(np.ascontiguousarray(self.fps[:, 0])), self.similarity
        for i, j in tree.pairs(24, 128):
            i, j = tree.order[i], tree.order[j]
            ok = (self.label[i] != self.label[j]) & (np.minimum(self.n[i], self.n[j]) >= s * np.maximum(self.n[i], self.n[j]) - 1e-6)
            if self.two:
                ok &= self.side[i] != self.side[j]
            for c in range(self.before.shape[1]):
                ok &= self.before[i, c] != self.before[j, c]
            i, j = i[ok], j[ok]
            d, na, nb = np.bitwise_count(self.fps[i] ^ self.fps[j]).sum(1), self.n[i].astype(float), self.n[j].astype(float)
            most = bound(na, nb, s)
            p = np.clip(most / BITS, 0, 0.5)
            # three standard errors; few shingles make a coarse fingerprint
            ok = (most >= 0) & (d <= most + 3 * np.sqrt(BITS * p * (1 - p)) + 2000.0 / np.maximum(np.minimum(na, nb), 1)) | (d == 0)
            yield d[ok].astype(np.int64), i[ok], j[ok]

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The closest candidates that join all that candidates join."""
        kept, more, size = np.zeros((3, 0), np.int64), [], 0
        for found in self.candidates():
            more.append(np.stack(found))
            size += len(found[0])
            if size > HELD:
                kept, more, size = self._shortest([kept, *more]), [], 0
        kept = self._shortest([kept, *more])
        return kept[1], kept[2]

    def _shortest(self, parts: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate(parts, axis=1)
        return pairs[:, joining(len(self.n), *pairs)]

    def asked(self) -> np.ndarray:
        """The members of all candidates."""
        hit = np.zeros(len(self.n), bool)
        for _, i, j in self.candidates():
            hit[i] = hit[j] = True
        return np.flatnonzero(hit)

    def similar(self, sets: list[bytes]) -> list[tuple[int, int]]:
        """Pairs that are similar by their sets and join all that similar candidates join: no candidate is left out."""
        flat, ends = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1], np.cumsum([len(s) // 8 for s in sets])
        size = np.diff(ends, prepend=0)
        mark, out = np.zeros(int(flat.max(initial=0)) + 1, bool), []
        for _, i, j in self.candidates():
            for a in np.unique(i):
                mine = flat[ends[a] - size[a] : ends[a]]
                mark[mine] = True
                others = j[i == a]
                step = max(1, HELD // int(size[others].max()))
                for lo in range(0, len(others), step):
                    bs = others[lo : lo + step]
                    bs = bs[self.label[bs] != self.label[a]]
                    if not len(bs):
                        continue
                    first = np.r_[0, np.cumsum(size[bs])[:-1]]
                    at = np.arange(size[bs].sum()) + np.repeat(ends[bs] - size[bs] - first, size[bs])
                    both = np.add.reduceat(mark[flat[at]].astype(np.int64), first)
                    for b in bs[both / np.maximum(1, size[a] + size[bs] - both) >= self.similarity]:
                        if self.label[a] != self.label[b]:
                            out.append((int(a), int(b)))
                            self.label[self.label == self.label[b]] = self.label[a]
                mark[mine] = False
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each run of rows with equal values in the first column, across batches."""
    rest: list[list] | None = None
    for batch in batches:
        now = [c.to_pylist() for c in batch.columns]
        rest = now if rest is None else [a + b for a, b in zip(rest, now, strict=True)]
        keys = np.array(rest[0], np.int64)
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cut):
            edges = [0, *cut.tolist()]
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield [c[lo:hi] for c in rest]
            rest = [c[edges[-1] :] for c in rest]
    if rest is not None and rest[0]:
        yield rest


def _longs(names: list[str], *columns: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _nearest_task(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, k, side, ids, fps, anchors, n in _groups(batches):
            if len(ids) > 1:
                i, j = Block(k, side, fps, anchors, n, None, similarity).nearest()
                if len(i):
                    yield _longs(["a", "b"], [ids[x] for x in i], [ids[x] for x in j])

    return run


def _asked_task(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, k, side, ids, fps, anchors, n, root in _groups(batches):
            if len(ids) > 1:
                hit = Block(k, side, fps, anchors, n, root, similarity).asked()
                if len(hit):
                    at = lambda c: [c[x] for x in hit]
                    kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
                    names = ["block", "k", "side", "id", "fp", "anchors", "n", "root"]
                    yield pa.RecordBatch.from_arrays([pa.array(at(c), t) for c, t in zip((block, k, side, ids, fps, anchors, n, root), kinds, strict=True)], names=names)

    return run


def _similar_task(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, k, side, ids, fps, anchors, n, root, sets in _groups(batches):
            pairs = Block(k, side, fps, anchors, n, root, similarity).similar(sets)
            if pairs:
                yield _longs(["a", "b"], [ids[x] for x, _ in pairs], [ids[x] for _, x in pairs])

    return run


def blocks(classes: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF) -> DataFrame:
    """classes (id, fp, anchors, n) -> (block, k, side, id, fp, anchors, n): any two classes that share an anchor and
    whose sizes allow the similarity meet in a block of each anchor that they share, however large its node is."""
    rows = classes.select("id", "fp", "anchors", "n", F.posexplode("anchors").alias("k", "a"))
    rows = rows.withColumns({"k": F.col("k").cast("long"), "node": F.xxhash64("k", "a")})
    full = lambda: F.ceil(F.greatest(F.count("*") / leaf, F.sum("n") / WEIGHT)).cast("long")
    sizes = materialize(rows.groupBy("node").agg(full().alias("parts")).where("parts > 1").select("node"), "sizes")
    out = ["block", "k", "side", "id", "fp", "anchors", "n"]
    small = rows.join(sizes, "node", "left_anti").withColumns({"block": F.col("node"), "side": F.lit(0).cast("long")})
    # sets of similarity s have sizes in one class or in two that are next to one another
    large = rows.join(sizes, "node", "left_semi").withColumn("size", F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(-math.log(similarity * 0.999))))
    cells = materialize(large.groupBy("node", "size").agg(full().alias("parts")), "cells")
    beside = [cells.select("node", (F.col("size") - by).alias("size"), F.col("parts").alias(name)) for by, name in ((1, "above"), (-1, "below"))]
    cells = cells.join(beside[0], ["node", "size"], "left").join(beside[1], ["node", "size"], "left")
    large = large.join(materialize(cells, "cells"), ["node", "size"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    size, part, parts = F.col("size"), F.col("part"), lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0).cast("long"), F.col(name) - 1)).otherwise(F.array().cast("array<bigint>"))
    meet = lambda side, *key: F.struct(F.xxhash64("node", *key).alias("block"), side.cast("long").alias("side"))
    own = F.transform(parts("parts"), lambda q: meet(part > q, size, F.least(part, q), size, F.greatest(part, q)))
    above = F.transform(parts("above"), lambda q: meet(F.lit(0), size, part, size + 1, q))
    below = F.transform(parts("below"), lambda q: meet(F.lit(1), size - 1, q, size, part))
    large = large.withColumn("m", F.explode(F.concat(own, above, below))).withColumns({"block": F.col("m.block"), "side": F.col("m.side")})
    return small.select(*out).unionByName(large.select(*out))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def shingle_set(text: Column, width: int = WIDTH) -> Column:
    """The sorted hashes of the shingles, as bytes."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t, width).tobytes() for t in texts], dtype="object")

    return run(text)


def jaccard(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    return run(a, b)


def settled(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that hold by the exact similarity of the sets (id, s)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("j")).where(F.col("j") >= similarity).select("a", "b")


def near_roots(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, leaf: int = LEAF) -> DataFrame:
    """classes (id, fp, anchors, n) -> (id, root) of those that have a near copy; sets_of gives ids (id) their (id, s)."""
    text_batches(classes.sparkSession)
    met = blocks(classes, similarity, leaf)
    near = _by_block(met).mapInArrow(_nearest_task(similarity), "a long, b long")
    near = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nearest")
    sets = materialize(sets_of(near.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    links = materialize(settled(near, sets, similarity), "links")
    discard(sets)
    roots = materialize(components(links).withColumnRenamed("node", "id"), "roots")
    # what is still in different parts
    met = met.join(roots, "id", "left").select(*met.columns, F.coalesce("root", "id").alias("root"))
    asked = materialize(_by_block(met).mapInArrow(_asked_task(similarity), "block long, k long, side long, id long, fp binary, anchors array<long>, n long, root long"), "asked")
    if asked.isEmpty():
        return roots
    sets = materialize(sets_of(asked.select("id").distinct()), "sets")
    more = _by_block(asked.join(sets, "id").select(*asked.columns, "s")).mapInArrow(_similar_task(similarity), "a long, b long")
    more = materialize(more, "links")
    discard(sets)
    discard(asked)
    return materialize(components(links.unionByName(more)).withColumnRenamed("node", "id"), "roots")


def near_dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, leaf: int = LEAF) -> DataFrame:
    """The rows of docs that stay: one of each group of near copies."""
    rows, ids = identified(docs, "near")
    keys = rows.select(sketch(F.col("text"), width).alias("s"), F.struct("doc_id", *ids).alias("k")).select("s.*", "k")
    # equal texts are one entry of the index
    own = materialize(keys, "sketches").groupBy("fp", "anchors", "n").agg(F.min("k").alias("own"))
    classes = with_row_id(own, "classes").withColumnRenamed("_rid", "id")
    place = classes.select("id", *[F.col(f"own.{c}").alias(f"_own{k}") for k, c in enumerate(ids)])

    def sets_of(asked: DataFrame) -> DataFrame:
        at = materialize(place.join(asked, "id", "left_semi"), "places")
        texts = rows.select(*ids, F.col("text")).join(at, [F.col(c) == F.col(f"_own{k}") for k, c in enumerate(ids)])
        return texts.select("id", shingle_set(F.col("text"), width).alias("s"))

    roots = near_roots(classes, sets_of, similarity, leaf)
    rep = classes.select("id", "own").join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("own").alias("rep"))
    return keep_rows(rows, ids, rep.select("rep.*"))
