"""Conflict-constrained best-fit packing (operator 9).

Documents are cut into pieces of `capacity` words at most and laid into bins of that capacity. Bins are kept in the
order of their room; a bin carries a bitmap of the duplicate clusters it holds and one of the places its sources have
taken (a source has `per_source` places in a bin). A piece goes to the tightest bin with enough room that holds neither
its cluster nor, for its source, all places; where that bin conflicts, the search goes on to its successor, and a new
bin is opened only when none is left. Largest pieces come first.

Rows are dealt by hash to packs of about PACK rows, so each task's memory is bounded and no group meets in one task: rows
that are alike are numbered, and the number is part of the hash. A document's cluster (equal texts) matters only within a
bin, so packs need nothing from one another.

Defined results: a document without words takes no room and gets one row with no bin; a null source counts as a source;
repeated rows are cluster mates and never share a bin; a text longer than a bin is cut into pieces, which lie in bins of
their own; ties in size go by doc_id (null last) and cluster; only the digest columns are returned, so columns of any
name may be there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import SPACE_RUN, read_table, text_batches, text_or_empty, told_apart, with_row_id, word_count

PACK = 8192
CAPACITY = 2048
PER_SOURCE = 8
_OUT = "doc_id long, piece int, first_word long, n_words long, bin_id long, bin_offset long"


class Bins:
    """Bins by room; `rooms` has bit r set where some bin has room r."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.used: list[int] = []

    def place(self, n: int, cluster: int, source: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of n words."""
        mine, first = 1 << cluster, source * self.per_source
        places = ((1 << self.per_source) - 1) << first
        rooms = self.rooms >> n << n
        while rooms:
            room = (rooms & -rooms).bit_length() - 1  # the tightest that is left
            for at, b in enumerate(self.by_room[room]):
                if not self.clusters[b] & mine and self.sources[b] & places != places:
                    return self._add(b, at, room, n, mine, places)
            rooms &= rooms - 1
        b = len(self.used)
        self.clusters.append(0)
        self.sources.append(0)
        self.used.append(0)
        self.by_room[self.capacity].append(b)
        return self._add(b, len(self.by_room[self.capacity]) - 1, self.capacity, n, mine, places)

    def _add(self, b: int, at: int, room: int, n: int, mine: int, places: int) -> tuple[int, int]:
        row = self.by_room[room]
        row[at] = row[-1]
        row.pop()
        if not row:
            self.rooms &= ~(1 << room)
        self.by_room[room - n].append(b)
        self.rooms |= 1 << room - n
        self.clusters[b] |= mine
        free = places & ~self.sources[b]
        self.sources[b] |= free & -free
        offset = self.used[b]
        self.used[b] += n
        return b, offset


def pack_rows(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """rows (doc_id, source, cluster, n) -> (doc_id, piece, first_word, n_words, bin or None, offset or None)."""
    clusters: dict = {}
    sources: dict = {}
    pieces, out = [], []
    for doc_id, source, cluster, n in sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2])):
        c, s = clusters.setdefault(cluster, len(clusters)), sources.setdefault(source, len(sources))
        if not n:
            out.append((doc_id, 0, 0, 0, None, None))
        pieces += [(min(capacity, n - lo), doc_id, k, lo, c, s) for k, lo in enumerate(range(0, n, capacity))]
    pieces.sort(key=lambda p: -p[0])
    bins = Bins(capacity, per_source)
    for n, doc_id, k, lo, c, s in pieces:
        out.append((doc_id, k, lo, n, *bins.place(n, c, s)))
    return out


def _task(capacity: int, per_source: int):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _OUT.split(", ")]

    def packed(pack: int, rows: list[tuple]) -> pa.RecordBatch:
        out = pack_rows(rows, capacity, per_source)
        columns = [list(c) for c in zip(*out, strict=True)]
        columns[4] = [None if b is None else pack << 24 | b for b in columns[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for pack, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack != now and rows:
                    yield packed(now, rows)
                    rows = []
                now = pack
                rows.append(tuple(row))
        if rows:
            yield packed(now, rows)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, pack_size: int = PACK) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin_id, bin_offset."""
    text_batches(docs.sparkSession)
    cluster = F.xxhash64(F.regexp_replace(text_or_empty(), SPACE_RUN, ""))
    items = with_row_id(docs.select("doc_id", "source", cluster.alias("cluster"), word_count().alias("n")), "items")
    packs = max(1, items.count() // pack_size)
    items = told_apart(items.withColumn("key", F.xxhash64("doc_id", "source", "cluster", "n")), ["key"], "_rid")
    # dealt by row, not by source or cluster: a hot one is spread over all packs
    items = items.withColumn("pack", F.pmod(F.xxhash64("key", "_nth"), F.lit(packs)))
    items = items.select("pack", "doc_id", "source", "cluster", "n").repartition("pack").sortWithinPartitions("pack")
    return items.mapInArrow(_task(capacity, per_source), _OUT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
