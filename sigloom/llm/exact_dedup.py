"""Exact dedup over a persistent digest index (operator 8).

The index is a table with one row per text seen so far: (digest, keep_id, keep_len, batch), bucketed and sorted by digest.
A batch is first reduced to one winner per digest (pre-aggregated before the shuffle, so a text with a third of all rows
costs one row per task), then anti-joined to the index by sort-merge, bucket by bucket, and what is new is appended.

A batch has a name. What it appended itself is not known to it, and is not appended again, so a batch that is run again
after a lost job gives the same rows; what to keep is written to the shared folder before the index changes. Unless one
is given, the name is a checksum of the batch's rows: the same rows given again are the same batch.

Defined results: a null text counts as empty; texts are equal when they are so without ASCII white space, however long;
of equal texts in a batch the row with the most code points stays, then the smallest id (null first), then the first row
as read; a text that the index has from another batch drops all rows of the batch that hold it. Columns of any name pass
through. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import SPACE_RUN, identified, keep_rows, materialize, read_table, text_or_empty, with_row_id


def digest(text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACE_RUN, ""), 256))


class DigestIndex:
    """A persistent index: a bucketed table at <root>/<table>/b<buckets>, found again by later sessions.

    root: the warehouse, if not given. buckets: fixed when the table is first written; later batches follow it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, root: str | None = None):
        self.spark, self.table = spark, table
        self.home = f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{table}"
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._found() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _found(self) -> int | None:
        """The number of buckets of the index that is there."""
        if not self.fs.exists(self._path(self.home)):
            return None
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(self._path(self.home))]
        return next((int(n[1:]) for n in names if n[:1] == "b" and n[1:].isdigit()), None)

    @property
    def location(self) -> str:
        return f"{self.home}/b{self.buckets}"

    def exists(self) -> bool:
        if self._found() is None:
            return False
        if not self.spark.catalog.tableExists(self.table):  # written by an earlier session
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.location).schema)
            self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'")
        return True

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.fs.delete(self._path(self.home), True)

    def create(self, id_type: str) -> None:
        """An empty index, if there is none."""
        if not self.exists():
            self.spark.sql(f"CREATE TABLE {self.table} (digest binary, keep_id {id_type}, keep_len bigint, batch string) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'")

    def unseen(self, winners: DataFrame) -> DataFrame:
        """The winners that the index has not: a sort-merge anti-join, bucket by bucket."""
        return winners.repartition(self.buckets, "digest").hint("merge").join(self.spark.table(self.table).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, winners: DataFrame, batch: str) -> DataFrame:
        """Add the winners (digest, win_rid, win_id, win_len, group_size) that are new; give all, with the keeper that
        other batches have left, if any (old, old_id)."""
        self.create(winners.schema["win_id"].dataType.simpleString())
        others = self.spark.table(self.table).where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        told = materialize(winners.repartition(self.buckets, "digest").hint("merge").join(others.hint("merge"), "digest", "left"), "resolved")
        rows = self.unseen(winners).select("digest", F.col("win_id").alias("keep_id"), F.col("win_len").alias("keep_len"), F.lit(batch).alias("batch"))
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.location).saveAsTable(self.table)
        return told


def batch_name(keys: DataFrame) -> str:
    """The name of a batch without one: a checksum of its rows, in whatever order."""
    n, total = keys.agg(F.count("*"), F.sum(F.xxhash64("digest", "_id", "len").cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}"


def decide(keys: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """One row per digest of keys (_rid, _id, digest, len): keep_id, win_rid (null if nothing of it stays), group_size."""
    best = F.min(F.struct((-F.col("len")).alias("neg"), F.col("_id").alias("id"), F.col("_rid").alias("rid"))).alias("best")
    winners = keys.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    winners = winners.select("digest", F.col("best.rid").alias("win_rid"), F.col("best.id").alias("win_id"), (-F.col("best.neg")).alias("win_len"), "group_size")
    told = index.append(materialize(winners, "winners"), batch)
    old = F.coalesce("old", F.lit(False))
    return told.select("digest", F.when(old, F.col("old_id")).otherwise(F.col("win_id")).alias("keep_id"), F.when(~old, F.col("win_rid")).alias("win_rid"), "group_size")


def _with_keepers(keys: DataFrame, told: DataFrame, *more: str) -> DataFrame:
    # both sides are scans or nearly: a hot digest is split over tasks by the skew join
    out = keys.join(told, "digest")
    return out.select("_rid", F.col("_id").alias("doc_id"), "keep_id", "group_size", F.coalesce(F.col("_rid") == F.col("win_rid"), F.lit(False)).alias("kept"), "digest", *more)


def find_keepers(keys: DataFrame, index: DigestIndex, *more: str, batch: str | None = None) -> DataFrame:
    """keys (_rid, _id, digest, len, more) with keep_id, group_size and kept; appends to the index."""
    return _with_keepers(keys, decide(keys, index, batch or batch_name(keys)), *more)


def find_in_batches(keys: DataFrame, index: DigestIndex, *more: str, batches: int = 2) -> DataFrame:
    """find_keepers() for keys in batches, longer texts first, with group_size over all.

    The longest of equal texts stays, so what the index has from the batches before is what stays in the next.
    """
    cuts = keys.agg(F.percentile_approx("len", [k / batches for k in range(batches - 1, 0, -1)])).first()[0] or []
    edges = sorted(set(cuts), reverse=True)
    name, length = batch_name(keys), F.col("len")
    parts = [(length >= lo) & (length < hi if hi is not None else F.lit(True)) for hi, lo in zip([None, *edges], [*edges, 0], strict=True)]
    told = reduce(DataFrame.unionByName, [decide(keys.where(part), index, f"{name}/{k}") for k, part in enumerate(parts)])
    one = told.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min("win_rid").alias("win_rid"), F.sum("group_size").alias("group_size"))
    return _with_keepers(keys, materialize(one, "keepers"), *more)


def keys_of(docs: DataFrame, *ids: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of docs: (_rid, _id, digest, len, ids)."""
    length = F.length(text_or_empty(F.col(f"`{text_col}`"))).cast("long").alias("len")
    return with_row_id(docs.select(*ids, F.col(f"`{id_col}`").alias("_id"), digest(F.col(f"`{text_col}`")).alias("digest"), length), "digests")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, batches: int = 1) -> DataFrame:
    """The rows of docs that stay, all columns kept. batches: how many docs are dealt into (find_in_batches)."""
    rows, ids = identified(docs, "exact")
    keys = keys_of(rows, *ids, id_col=id_col, text_col=text_col)
    found = find_keepers(keys, index, *ids, batch=batch) if batches < 2 else find_in_batches(keys, index, *ids, batches=batches)
    return keep_rows(rows, ids, found.where("kept"))


def query_index(spark: SparkSession, use: str) -> DigestIndex:
    """An empty index of its own for one run of a query, which drops it when its rows are decided."""
    return DigestIndex(spark, f"llm_digests_{use}_{uuid.uuid4().hex}")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = query_index(spark, "op8")
    out = find_in_batches(keys_of(read_table(spark, sf_dir, "documents")), index)
    index.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(x) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
