"""Hard-negative mining by a vector-approximation file (operator 12).

For each anchor the best `positives` other rows of its label are found, then for each of these the best `negatives` rows
of other labels whose score lies in a window below the positive's. Scores are inner products of integer components.

Rows travel in blocks. Every block has its approximation: each dimension is quantised into CELLS cells with about as many
rows each, and a cell knows the least and the greatest component of its rows. For an anchor, a table gives what each cell
adds to the score at least and at most; looking up the cells of a row bounds its score from below and above. Exactly
scored are only rows whose bounds let them enter: above the fifth best so far (or the fifth best lower bound) for a
positive, within the window and not below the fifth best so far for a negative. Nothing is lost, so the result is exact.

Every anchor meets every row, as the search asks for; it is laid out as a grid. Anchors are in groups of at most `group`,
rows in SLICES slices; a task holds a group and streams the blocks of a slice by it, so its memory is bounded by a group
and a block. It gives the best few of its slice, and these are merged: SLICES times the result, whatever the number of
rows. Blocks are sorted by label, so looking for positives skips most of them unread. A label with a third of all rows is
many blocks in all slices.

Defined results: rows with a null label, vector or id, or with a null or non-finite component take no part; rows with
vectors of different lengths never meet; rows with equal ids and equal scores are interchangeable in the result, and
repeated rows are all looked at (another row with an anchor's own id may be its positive); a repeated anchor is one
anchor each time; components beyond a long are held at its ends, scores beyond a long are compared exactly and written as
its ends; an anchor without positives, and a positive without negatives, has no rows; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm._common import materialize, read_table, text_batches

CELLS = 64
SLICES = 16
GROUP = 4096
_STEP = 512
_LONG = (1 << 63) - 1
_FOUND = "rid long, nth int, id long, score long, exact string"
_ZERO = 1 << 200
_LOWEST = np.iinfo(np.int64).min


class Block:
    """Rows of one vector length: ids, labels, components, and their cells."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rid, self.ids, self.labels, self.vectors = rid, ids, labels, vectors
        n, dims = vectors.shape
        self.most = max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0
        self.cells = min(CELLS, n)
        order = np.argsort(vectors, axis=0, kind="stable")
        rank = np.arange(n) * self.cells // n
        self.code = np.empty((dims, n), np.intp)
        np.put_along_axis(self.code, order.T, rank[None, :], axis=1)
        ordered = np.take_along_axis(vectors, order, axis=0)
        first = np.searchsorted(rank, np.arange(self.cells))
        last = np.searchsorted(rank, np.arange(self.cells), side="right") - 1
        self.low, self.high = ordered[first], ordered[last]  # (cells, dims)

    def bounds(self, anchors: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchors): the least and the greatest score that the rows' cells allow."""
        n, m = len(self.rid), len(anchors)
        least, greatest, got = np.zeros((n, m), kind), np.zeros((n, m), kind), np.empty((n, m), kind)
        for d in range(self.vectors.shape[1]):
            q = anchors[:, d].astype(kind)
            a, b = np.multiply.outer(self.low[:, d].astype(kind), q), np.multiply.outer(self.high[:, d].astype(kind), q)
            for out, table in ((least, np.minimum(a, b)), (greatest, np.maximum(a, b))):
                np.take(table, self.code[d], axis=0, out=got, mode="clip")
                out += got
        return least, greatest


def _kind(block: Block, anchors: np.ndarray) -> type | None:
    """The numbers that hold all scores: int32, int64, or None where Python's integers are needed."""
    most = max(int(anchors.max()), -int(anchors.min())) * block.most * max(1, anchors.shape[1]) if anchors.size else 0
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else None


def exact(anchors: np.ndarray, vectors: np.ndarray, kind: type | None) -> np.ndarray:
    """Inner products, row by row."""
    if kind is None:
        return (anchors.astype(object) * vectors.astype(object)).sum(axis=1) if anchors.shape[1] else np.zeros(len(anchors), object)
    return np.einsum("ij,ij->i", anchors.astype(np.int64), vectors.astype(np.int64))


# `exact` is a score that may pass a long, as text of one length that sorts like it


class Best:
    """The best `keep` (score, then smaller id) for each of n places."""

    def __init__(self, n: int, keep: int):
        self.keep, self.n = keep, n
        self.at, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The score of the last of them, where there are `keep`; or what is known to be no better.
        self.bar = np.full(n, _LOWEST, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if score.dtype == object:
            order = np.array(sorted(range(len(at)), key=lambda k: (at[k], -score[k], ids[k])), np.intp)
        else:
            order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        nth = np.arange(len(at)) - first
        full = nth == self.keep - 1
        bars = score[full] if score.dtype != object else np.array([min(max(s, _LOWEST), _LONG) for s in score[full]], np.int64)
        self.bar[at[full]] = np.maximum(self.bar[at[full]], bars)
        held = nth < self.keep
        self.at, self.score, self.id = at[held], score[held], ids[held]


class Anchors:
    """A group of anchors of one vector length, ordered by label. windows: (nth, least, most) of each, or None."""

    def __init__(self, rows: list[tuple], keep: int, floor: int):
        rows = sorted(rows, key=lambda r: r[1])
        self.rid, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.vectors = np.array([r[2] for r in rows], np.int64).reshape(len(rows), -1)
        self.windows = rows[0][3] is not None
        if self.windows:
            self.wide = max(len(r[3]) for r in rows)
            # a window's least and greatest score; a place without one holds nothing
            self.most = np.full((len(rows), self.wide), _LOWEST, object)
            for k, r in enumerate(rows):
                for p, score in r[3]:
                    self.most[k, p - 1] = int(score, 16) - _ZERO
            self.least = np.where(self.most == _LOWEST, 0, -(-floor * self.most // 100)).astype(object)
            self.some = self.most != _LOWEST
        else:
            self.wide = 1
        self.best = Best(len(rows) * self.wide, keep)

    def positives(self, block: Block, lo: int, hi: int) -> None:
        """Rows of the block that have the label of anchors lo to hi, the anchors with labels of the block."""
        q, kind = self.vectors[lo:hi], _kind(block, self.vectors[lo:hi])
        may = (block.labels[:, None] == self.labels[None, lo:hi]) & (block.rid[:, None] != self.rid[None, lo:hi])
        if kind is not None:
            least, greatest = block.bounds(q, kind)
            bar = self.best.bar[lo:hi]
            new = np.flatnonzero(bar == _LOWEST)
            keep = self.best.keep
            if len(new) and len(block.rid) > keep:  # the fifth best lower bound is no better than the fifth best score
                low = np.where(may[:, new], least[:, new].astype(np.int64), _LOWEST)
                bar = bar.copy()
                bar[new] = np.partition(low, len(low) - keep, axis=0)[len(low) - keep]
            may &= greatest >= bar
        row, at = np.nonzero(may)
        self.best.add(at + lo, exact(q[at], block.vectors[row], kind), block.ids[row])

    def negatives(self, block: Block, lo: int, hi: int) -> None:
        """Rows of the block with other labels than anchors lo to hi, in each of their windows."""
        q, kind = self.vectors[lo:hi], _kind(block, self.vectors[lo:hi])
        other = block.labels[:, None] != self.labels[None, lo:hi]
        if kind is None:
            row, at = np.nonzero(other)
        else:
            least, greatest = block.bounds(q, kind)
            may = np.zeros_like(other)
            for p in range(self.wide):
                k = np.arange(lo, hi) * self.wide + p
                low = np.maximum(np.array([min(max(x, _LOWEST), _LONG) for x in self.least[lo:hi, p]], np.int64), self.best.bar[k])
                high = np.array([min(max(x, _LOWEST), _LONG) for x in self.most[lo:hi, p]], np.int64)
                may |= (greatest >= low) & (least <= high) & self.some[lo:hi, p]
            row, at = np.nonzero(may & other)
        score = exact(q[at], block.vectors[row], kind)
        for p in range(self.wide):
            inside = self.some[at + lo, p] & (score <= self.most[at + lo, p]) & (score >= self.least[at + lo, p])
            inside = inside.astype(bool)
            self.best.add((at[inside] + lo) * self.wide + p, score[inside], block.ids[row[inside]])

    def see(self, block: Block) -> None:
        if self.windows:
            for lo in range(0, len(self.rid), _STEP):
                self.negatives(block, lo, min(lo + _STEP, len(self.rid)))
            return
        a, b = np.searchsorted(self.labels, block.labels.min()), np.searchsorted(self.labels, block.labels.max(), side="right")
        for lo in range(a, b, _STEP):
            self.positives(block, lo, min(lo + _STEP, b))

    def found(self) -> Iterator[tuple]:
        for at, score, k in zip(self.best.at.tolist(), self.best.score.tolist(), self.best.id.tolist(), strict=True):
            yield int(self.rid[at // self.wide]), at % self.wide + 1, k, min(max(score, -_LONG - 1), _LONG), f"{score + _ZERO:051x}"


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of rows as one row that holds it: the block that travels."""
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([int(batch.column(0)[0].as_py())], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["first", "rows"])


def _blocks(rows: bytes) -> Iterator[Block]:
    """The blocks of a blob, one a vector length."""
    batch = pa.ipc.open_stream(rows).read_next_batch()
    rid, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    vectors = batch.column(3)
    dims, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(dims)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield Block(rid[at], ids[at], labels[at], flat[(ends[at] - d)[:, None] + np.arange(d)])


def _search(keep: int, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, groups = None, [], None

        def ready() -> dict[int, Anchors]:
            per: dict[int, list[tuple]] = {}
            for r in waiting:
                per.setdefault(len(r[2]), []).append(r)
            return {d: Anchors(rows, keep, floor) for d, rows in per.items()}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [x for g in (groups or {}).values() for x in g.found()]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            for here, rid, label, c, windows, rows in zip(*(batch.column(k) for k in range(6)), strict=True):
                if here.as_py() != cell:
                    yield from out()
                    cell, waiting, groups = here.as_py(), [], None
                if not rows.is_valid:
                    waiting.append((rid.as_py(), label.as_py(), c.as_py(), windows.as_py() and [(w["nth"], w["score"]) for w in windows.as_py()]))
                    continue
                groups = ready() if groups is None else groups
                for block in _blocks(rows.as_py()):
                    if block.vectors.shape[1] in groups:
                        groups[block.vectors.shape[1]].see(block)
        yield from out()

    return run


def components_of(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _searched(anchors: DataFrame, blocks: DataFrame, groups: int, keep: int, floor: int) -> DataFrame:
    """anchors (rid, label, c, windows) against all blocks; the best of each slice."""
    group = F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int") * SLICES
    one = anchors.select(F.explode(F.sequence(group, group + F.lit(SLICES - 1))).alias("cell"), "rid", "label", "c", "windows", F.lit(None).cast("binary").alias("rows"))
    slice_ = F.pmod(F.xxhash64("first"), F.lit(SLICES)).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g.cast("int") * SLICES + slice_)
    other = blocks.select(F.explode(every).alias("cell"), F.col("first").alias("rid"), F.lit(0).cast("long").alias("label"), F.lit(None).cast("array<bigint>").alias("c"), F.lit(None).cast(dict(anchors.dtypes)["windows"]).alias("windows"), "rows")
    dealt = one.unionByName(other).repartition(groups * SLICES, "cell").sortWithinPartitions("cell", F.col("rows").isNotNull(), "rid")
    return dealt.mapInArrow(_search(keep, floor), _FOUND)


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """(rid, nth, rank, id, score) of the best over all slices."""
    order = [F.col("exact").desc(), F.col("id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("rid", "nth").orderBy(*order))).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, floor: int = 80, group: int = GROUP) -> DataFrame:
    """rows (id, label, c: array of longs, anchor: boolean) -> a row per anchor, positive and rank of a negative.

    A negative's score s meets floor * p <= 100 * s <= 100 * p, p being the positive's.
    """
    text_batches(rows.sparkSession)
    fit = rows.where("id is not null and label is not null and c is not null").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "c", "anchor")
    spread = fit.repartitionByRange(F.size("c"), "label", F.xxhash64("id", "c")).sortWithinPartitions(F.size("c"), "label")
    held = materialize(spread.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "c", "anchor"), "vectors")
    blocks = held.select("rid", "id", "label", "c").mapInArrow(_blobs, "first long, rows binary")
    anchors = held.where("anchor").select("rid", "label", "c")
    groups = max(1, -(-anchors.count() // group))
    kind = "array<struct<nth:int,score:string>>"
    first = _searched(anchors.withColumn("windows", F.lit(None).cast(kind)), blocks, groups, positives, floor)
    best = materialize(_merged(first, positives).select("rid", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "exact"), "positives")
    windows = best.groupBy("rid").agg(F.collect_list(F.struct(F.col("rank").alias("nth"), F.col("exact").alias("score"))).alias("windows"))
    second = _searched(anchors.join(windows, "rid").select("rid", "label", "c", "windows"), blocks, groups, negatives, floor)
    found = _merged(second, negatives).select("rid", F.col("nth").alias("_nth"), F.col("rank").alias("_rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(best.select("rid", F.col("rank").alias("_nth"), "positive_id", "positive_score"), ["rid", "_nth"]).join(held.where("anchor").select("rid", F.col("id").alias("anchor_id")), "rid")
    return named.select("anchor_id", "positive_id", F.col("_rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), components_of(F.col("embedding")).alias("c"), (F.col("vec_id") % 100 == 0).alias("anchor")))


OP12_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, e.rid AS other, e.vec_id, a.label = e.label AS same,
    CAST(list_sum([CAST(z[1] AS HUGEINT) * z[2] FOR z IN list_zip(a.c, e.c)]) AS BIGINT) AS score
  FROM a JOIN e ON a.rid <> e.rid AND len(a.c) = len(e.c)
),
p AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS nth FROM s WHERE same
  QUALIFY nth <= 5
),
n AS (
  SELECT p.rid, p.nth, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
