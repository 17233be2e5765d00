"""What the operators of this subpackage share: word rules, shared storage, row ids, connected components."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.ship import ship
from sigloom.storage import discard, materialize, shared_dir

#: A run of the six ASCII white space characters, and a word: a run of anything else.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch of whole texts: what a Python worker holds at once.
TEXT_BATCH = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Have texts sent to Python in small batches, unless the session says how many rows a batch has; and the code."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default, made for numbers
        spark.conf.set(key, str(TEXT_BATCH))


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """df written as a table bucketed by key, in as many buckets as the session has shuffle partitions.

    Grouping by key, and cogrouping with other tables, then deals out the others alone.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{tag}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def with_row_id(rows: DataFrame, tag: str) -> DataFrame:
    """Narrow rows with a row id `_rid`, materialized: the id stays the same in all later reads."""
    return materialize(rows.withColumn("_rid", F.monotonically_increasing_id()), tag)


def identified(docs: DataFrame, tag: str) -> tuple[DataFrame, list[str]]:
    """docs with two columns that tell its rows apart, whatever they hold and however often they are read; their names.

    Rows of files are known by their file and place in it, so no text is written. Other tables are materialized first.
    """
    text_batches(docs.sparkSession)
    names = ["_file", "_row"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [f"_{n}" for n in names]
    place = [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select("*", *place), names
    except AnalysisException:
        return materialize(docs, tag).select("*", *place), names


def keep_rows(docs: DataFrame, ids: list[str], kept: DataFrame) -> DataFrame:
    """The rows of docs whose ids are in kept, without the ids. The order of columns stays."""
    return docs.join(kept.select(*ids), ids, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns if c not in ids])


def as_row(df: DataFrame) -> Column:
    """All columns as one struct `_row`, so that columns of our own never meet theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def told_apart(rows: DataFrame, keys: list[str], rid: str) -> DataFrame:
    """rows with `_nth`: 0, 1, ... among the rows with equal keys, the same numbers in each run; which row of them gets
    which is open. rid: the row id of with_row_id().

    Only keys that repeat are numbered. Their rows are numbered side by side in each part of the table (a part is what a
    task wrote), and the parts' counts are summed up, so a key in a third of all rows never comes together in one task.
    """
    again = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "again")
    alike = rows.join(again, keys, "left_semi").select(*keys, rid, F.shiftright(rid, 33).alias("_part"))
    parts = alike.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = materialize(parts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "parts")
    there = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(rid)) - F.lit(1)
    numbers = alike.withColumn("_at", there).join(parts, [*keys, "_part"]).select(rid, (F.col("_first") + F.col("_at")).alias("_nth"))
    return rows.join(materialize(numbers, "numbers"), rid, "left").select(*rows.columns, F.coalesce("_nth", F.lit(0)).alias("_nth"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is one pre-aggregated minimum per node and
    one join, and a hub's rows may be split over tasks. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        down = materialize(down, "down")
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(small.where("a <> b").distinct(), "edges")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for x in (now, low, large, down):
            discard(x)
        now = after
        if mark == seen:
            break
        seen = mark
    leaves = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return spark.createDataFrame([], leaves.schema).unionByName(leaves).unionByName(roots)
