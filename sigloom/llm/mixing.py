"""Mixing sources to target weights by pivotal dependent rounding (operator 4). DataFrame functions only.

Every document of a source is to be taken target / source_size times: a whole number plus a fraction p. The fractions
are rounded together: two documents meet, word mass moves at random from one to the other until one of them is taken or
not for certain, and the other goes on to meet the next. A move keeps the expected words of the pair and each
document's own expectation. Chunks of about CHUNK documents do this side by side; each leaves one undecided document at
most, and these residuals meet again in chunks of chunks, up a reduction tree, until one per source is left, which is
rounded to the nearer side. So a source misses its target by half of one document at most, however large it is. Rows that
are alike are numbered, and a row's chunk is a hash of its key and number: about CHUNK rows come together in one task,
also where a third of all rows are the same row.

The random numbers are hashes of the row keys and the seed: reruns agree.

Defined results: a null text has no words and is never taken; a null source is a source of its own, last in the order;
repeated rows are mixed each on its own, and may stand for one another; a very long text is one document, taken whole;
ties in size are met in the order of the keys; columns of any name pass through; without any words all targets are 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm._common import identified, materialize, read_table, told_apart, uniform, with_row_id, word_count

CHUNK = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def ranked_sources(sizes: DataFrame, parts: int) -> DataFrame:
    """sizes (source, source_size, n_pos) with rank: 0, 1, ... by code point, null last. No single task sees all sources."""
    key = [F.col("source").isNull(), F.col("source")]
    run = sizes.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("_id", F.monotonically_increasing_id())
    run = materialize(run.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "sources")
    per = run.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition of the range exchange
    first = per.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_first"))
    return run.join(first, "_part").withColumn("rank", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes with weight and target: share * all words by weight, none above cap times its source, the excess reshared.

    A target is min(cap * source_size, level * weight) for one level, found by a few passes of sums over the sources.
    """
    spark = sizes.sparkSession
    ranked = ranked_sources(sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", weight), "weights")
    total = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    most = F.col("source_size") * F.lit(float(cap))
    level, capped = 0.0, -1
    while total > 0:
        full = most <= F.lit(level) * F.col("weight")
        held, n, free = table.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or free == 0:
            break
        capped, level = n, (total - held) / free
    return table.withColumn("target", F.least(most, F.lit(level) * F.col("weight")) if total > 0 else F.lit(0.0))


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _meet(a: Column, b: Column, seed: int) -> Column:
    """The fractions of a and b (w, key, rid, p) after mass moved between them."""
    rise = F.least((1 - a.p) * a.w, b.p * b.w)  # the words that a can gain from b
    fall = F.least(a.p * a.w, (1 - b.p) * b.w)
    up = uniform(F.lit(seed), a.key, b.key) * (rise + fall) < fall
    # the side that reaches its bound is set to it, so rounding errors leave nothing behind
    return F.when(up, F.struct(
        F.when((1 - a.p) * a.w <= b.p * b.w, 1.0).otherwise(a.p + b.p * b.w / a.w).alias("pa"),
        F.when((1 - a.p) * a.w >= b.p * b.w, 0.0).otherwise(b.p - (1 - a.p) * a.w / b.w).alias("pb"))).otherwise(F.struct(
        F.when(a.p * a.w <= (1 - b.p) * b.w, 0.0).otherwise(a.p - (1 - b.p) * b.w / a.w).alias("pa"),
        F.when(a.p * a.w >= (1 - b.p) * b.w, 1.0).otherwise(b.p + a.p * a.w / b.w).alias("pb")))


def _settled(p: Column) -> Column:
    return (p <= 0.0) | (p >= 1.0)


def _fold(items: Column, seed: int) -> Column:
    """Pivot through the items in order: (left: array of the undecided one or none, done: array of the decided ones)."""
    kind = "array<struct<w:double,key:bigint,rid:bigint,p:double>>"
    empty = F.array().cast(kind)

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x.w.alias("w"), x.key.alias("key"), x.rid.alias("rid"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        def met(two: Column) -> Column:
            return F.struct(F.filter(two, lambda t: ~_settled(t.p)).alias("left"), F.concat(acc.done, F.filter(two, lambda t: _settled(t.p))).alias("done"))

        pair = _let(acc.left[0], lambda a: _let(_meet(a, x, seed), lambda m: F.array(with_p(a, m.pa), with_p(x, m.pb))))
        return F.when(F.size(acc.left) == 0, F.struct(F.array(x).cast(kind).alias("left"), acc.done.alias("done"))).otherwise(_let(pair, met))

    return F.aggregate(items, F.struct(empty.alias("left"), empty.alias("done")), step)


def pivotal_round(rows: DataFrame, seed: int, n_max: int) -> DataFrame:
    """rows (rid, key, source, w > 0, 0 < p < 1, n: rows of the source) -> (rid, taken 0 or 1). n_max: the largest n."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK))
    level = rows.select("source", F.pmod(F.xxhash64(F.lit(seed), "key"), chunks).alias("chunk"), F.struct(F.col("w").cast("double").alias("w"), "key", "rid", "p").alias("x"))
    most, out = max(1, math.ceil(n_max / CHUNK)), None
    while True:
        # largest first: large documents settle among themselves and small ones are left for the end
        got = level.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
        got = materialize(got.select("source", "chunk", _fold(F.col("xs"), seed).alias("f")), "pivot")
        done = got.select(F.explode("f.done").alias("x")).select("x.rid", F.col("x.p").cast("int").alias("taken"))
        out = done if out is None else out.unionByName(done)
        left = got.select("source", "chunk", F.explode("f.left").alias("x"))
        if most == 1:
            return out.unionByName(left.select("x.rid", (F.col("x.p") >= 0.5).cast("int").alias("taken")))
        most = math.ceil(most / CHUNK)
        level = left.withColumn("chunk", F.floor(F.col("chunk") / CHUNK))


def mix(rows: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows (rid: of with_row_id(), key: the same in each run, source, size) with source_size, target and copies."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    table = materialize(targets(sizes, weights, share, cap).drop("rank", "weight"), "targets")
    n_max = table.agg(F.max("n")).first()[0] or 0
    told = rows.withColumnRenamed("source", "_s").join(table, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times + 1e-9)
    told = told.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(times - whole, F.lit(0.0)))
    told = materialize(told.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))), "told")
    apart = told_apart(told.where("p > 0").select("rid", "key", "source", "size", "p", "n"), ["key"], "rid")
    apart = apart.withColumn("key", F.when(F.col("_nth") > 0, F.xxhash64("key", "_nth")).otherwise(F.col("key")))
    taken = materialize(pivotal_round(apart.select("rid", "key", "source", F.col("size").alias("w"), "p", "n"), seed, n_max), "taken")
    return told.join(taken, "rid", "left").select(*rows.columns, "source_size", "target", (F.col("whole") + F.coalesce("taken", F.lit(0))).alias("copies"))


def row_key() -> Column:
    """A number that a row has in every run; rows alike share it and may stand for one another."""
    return F.xxhash64("doc_id", "source", F.crc32(F.col("text").cast("binary")))


def mix_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it."""
    rows, ids = identified(docs, "mix")
    keys = with_row_id(rows.select(*ids, "source", word_count().alias("size"), row_key().alias("key")), "sizes")
    picked = mix(keys.withColumnRenamed("_rid", "rid"), seed, **options).where("copies > 0").select(*ids, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return rows.join(picked.select(*ids), ids).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = with_row_id(docs.select("doc_id", "source", word_count().alias("size"), row_key().alias("key")), "sizes").withColumnRenamed("_rid", "rid")
    out = mix(rows)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
