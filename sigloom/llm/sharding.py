"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 10).

The ring has 65,536 positions. A row's position is the hash of its id; every shard has `vnodes` points on the ring and
owns the positions before them, clockwise. Under the bounded law no shard takes more than its capacity: rows fill their
own shard in ring order, and what does not fit goes on clockwise to the next point whose shard has room.

Only the number of rows at each position reaches the driver (65,536 numbers at most and one more a partition), where the
walk is done once per position; the rows then learn their shard by their rank at their position. Ranks come from one
exchange by range over position, id and place in the table, so an id in a third of all rows is spread over many tasks.

Defined results: a null text has no bytes; a null id is hashed like any value; repeated rows are told apart by their
rank, so each gets a slot of its own, whichever of them it is; other ties go by the columns in `order`; a very long text
is one row; columns named shard, slot and grown_shard are replaced, all others pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm._common import as_row, identified, materialize, read_table, text_or_empty

POSITIONS = 1 << 16
_PLAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("_cell", "_from", "_to", "_slot0")] + [T.StructField("shard", T.IntegerType(), False)])


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order. A point depends on its own shard alone, so another shard moves none of them."""
    points = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:2], "big"), s) for s in range(shards) for v in range(vnodes)]
    first: dict[int, int] = {}
    for p, s in points:
        first[p] = min(s, first.get(p, s))
    return sorted(first.items())


def owners(points: list[tuple[int, int]]) -> list[int]:
    """For each position the index of the first point at or after it, clockwise."""
    at = [p for p, _ in points]
    return [bisect_left(at, x) % len(points) for x in range(POSITIONS)]


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """epsilon 0: counts at most one apart. Else each shard holds up to (1 + epsilon) times its part."""
    if epsilon <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + epsilon) * rows / shards)] * shards


def walk(counts: dict[int, int], shards: int, vnodes: int, epsilon: float) -> list[tuple[int, int, int, int, int]]:
    """(position, first rank, end rank, slot of the first, shard) for all rows; counts: rows at each position."""
    points = ring(shards, vnodes)
    own = owners(points)
    room = capacities(sum(counts.values()), shards, epsilon)
    filled = [0] * shards
    plan, over = [], []

    def put(cell: int, lo: int, hi: int, point: int) -> int:
        s = points[point][1]
        n = min(hi - lo, room[s] - filled[s])
        if n > 0:
            plan.append((cell, lo, lo + n, filled[s], s))
            filled[s] += n
        return lo + max(n, 0)

    for cell in sorted(counts):
        left = put(cell, 0, counts[cell], own[cell])
        if left < counts[cell]:
            over.append((cell, left, counts[cell], own[cell]))
    while over:
        later = []
        for cell, lo, hi, point in over:
            point = (point + 1) % len(points)
            while filled[points[point][1]] >= room[points[point][1]]:
                point = (point + 1) % len(points)
            lo = put(cell, lo, hi, point)
            if lo < hi:
                later.append((cell, lo, hi, point))
        over = later
    return plan


def ring_position(id_col: str = "doc_id") -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("ring"))


def _ranked(rows: DataFrame, id_col: str, order: tuple[str, ...], ids: list[str], parts: int) -> DataFrame:
    """rows with _cell, _part and _at (place in the part), in the order of ring position, id, order and ids."""
    key = [F.col("_cell"), ring_position(id_col), *[F.col(f"`{c}`") for c in (id_col, *order, *ids)]]
    run = rows.withColumn("_cell", cell_of(id_col)).repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("_seq", F.monotonically_increasing_id())
    return materialize(run.withColumns({"_part": F.shiftright("_seq", 33).cast("long"), "_at": F.col("_seq").bitwiseAND((1 << 33) - 1)}).drop("_seq"), "ring")


def place_on_ring(rows: DataFrame, id_col: str, shards: int, vnodes: int, epsilon: float, order: tuple[str, ...], ids: list[str]) -> DataFrame:
    """Narrow rows with shard and slot. ids: columns that tell all rows apart."""
    spark = rows.sparkSession
    run = _ranked(rows, id_col, order, ids, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a part is a range of positions: POSITIONS rows at most, and one more for each part
    runs = run.groupBy("_part", "_cell").agg(F.min("_at").alias("at"), F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    first = []
    for part, cell, at, n in sorted(runs):
        first.append((part, cell, counts.get(cell, 0) - at))
        counts[cell] = counts.get(cell, 0) + n
    plan = spark.createDataFrame(walk(counts, shards, vnodes, epsilon), _PLAN)
    first = spark.createDataFrame(first, "_part long, _cell long, _shift long")
    ranked = run.join(F.broadcast(first), ["_part", "_cell"]).withColumn("_rank", F.col("_at") + F.col("_shift"))
    out = ranked.join(F.broadcast(plan), "_cell").where("_rank >= _from AND _rank < _to")  # a few thousand rows more than POSITIONS at most
    return out.select(*rows.columns, "shard", (F.col("_slot0") + F.col("_rank") - F.col("_from")).alias("slot"))


def shard_bounded(rows: DataFrame, id_col: str, shards: int, vnodes: int = 128, epsilon: float = 0.0, order: tuple[str, ...] = ()) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard). order: columns that tell rows with one id apart."""
    whole, ids = identified(rows, "shard")
    few = whole.select(*ids, F.col(f"`{id_col}`").alias("_key"), *[F.col(f"`{c}`").alias(f"_order{k}") for k, c in enumerate(order)])
    told = place_on_ring(few, "_key", shards, vnodes, epsilon, tuple(f"_order{k}" for k in range(len(order))), ids).select(*ids, F.struct("shard", "slot").alias("_told"))
    keep = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    out = whole.select(*ids, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_whole")).join(told, ids)
    return out.select(*[F.col(f"_whole.`{c}`").alias(c) for c in keep], "_told.shard", "_told.slot")


def cell_of(id_col: str) -> Column:
    return F.shiftrightunsigned(ring_position(id_col), 48)


def shard_by_key(rows: DataFrame, id_col: str, shards: int, vnodes: int = 128) -> DataFrame:
    """rows with shard and grown_shard (with one shard more): the ring without bounds, where the id alone decides."""
    spark = rows.sparkSession
    few, more = ring(shards, vnodes), ring(shards + 1, vnodes)
    table = [(c, few[a][1], more[b][1]) for c, (a, b) in enumerate(zip(owners(few), owners(more), strict=True))]
    table = spark.createDataFrame(table, "_cell long, shard int, grown_shard int")
    keep = [c for c in rows.columns if c.lower() not in ("shard", "grown_shard")]
    own = rows.select(as_row(rows), cell_of(id_col).alias("_cell")).join(F.broadcast(table), "_cell")  # POSITIONS rows
    return own.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "shard", "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ids = identified(read_table(spark, sf_dir, "documents"), "shard")
    rows = docs.select(*ids, "doc_id", (F.octet_length(text_or_empty()) + F.lit(1)).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"))
    out = place_on_ring(rows, "doc_id", 8, 128, 0.0, ("text_crc32", "size"), ids)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
