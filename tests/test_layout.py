"""Orders that do not depend on tasks, and plans that shuffle a source once."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sigloom.operators import dataset, derived
from sigloom.schema import ORD, with_order
from sigloom.sources import tables


def exchanges(df):
    df.collect()
    return len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Two files; rows of a day are spread over both, and the first one of the first file counts."""
    home = tmp_path_factory.mktemp("parts")
    for name, rows in (("a", [(k % 7, k, 1000 + k) for k in range(4000)]), ("b", [(k % 9, k, 9000 + k) for k in range(4000)])):
        spark.createDataFrame(rows, "day int, k int, v int").withColumn("date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("day"))).coalesce(1).write.parquet(f"{home}/{name}")
    return str(home)


FIRST = {d: float(1000 + d) for d in range(7)} | {7: 9007.0, 8: 9008.0}


@pytest.mark.parametrize("split", ["200", "134217728"])
@pytest.mark.parametrize("paths", [("a", "b"), ("b", "a")])
def test_first_does_not_depend_on_tasks(spark, files, split, paths):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.read.parquet(*[f"{files}/{p}" for p in paths])
        ordered = with_order(df.where("k >= 0").withColumn("v", F.col("v").cast("double")))
        shuffled = ordered.repartition(7, F.rand(3))
        for one in (ordered, shuffled):
            wide, _ = dataset.wide_context(one, ["v"], [], "ctx")
            assert {(r.date.day - 1): r.ctx__v for r in wide.collect()} == FIRST
            assert {(r.date.day - 1): r.v for r in derived.first_rows(one, []).collect()} == FIRST
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_diaries_in_many_blocks(spark, tmp_path):
    lines = ["Date;v"] + [f"{1 + k % 20:02d}.01.2026;{k},5" for k in range(3000)]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = tables.read_diary(spark, str(tmp_path / "d.csv")).repartition(5, F.rand(1))
        assert {r.date.day: r.v for r in derived.first_rows(df, []).collect()} == {1 + k: k + 0.5 for k in range(20)}
        assert [r.v for r in df.orderBy(ORD).select("v").collect()] == [k + 0.5 for k in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_assembly_shuffles_a_source_once(spark):
    """Sources are grouped by entity and date, which is how they are joined: no join shuffles again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).select((F.col("id") % 5).alias("who"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 200).cast("int")).alias("date"), F.col("id").cast("double").alias("v"), F.col("id").alias(ORD))
        parts = [dataset.wide_context(rows.withColumnRenamed("v", f"v{k}"), [f"v{k}"], ["who"], f"c{k}")[0] for k in range(4)]
        base = parts[0].select("who", "date")
        assert exchanges(dataset.assemble(parts[0], parts[1:], ["who"])) == 4
        assert dataset.assemble(base, parts, ["who"]).count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_derived_rows_are_made_once(spark):
    """The plan that makes derived rows runs once for the names and the values of the wide form."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "date string, operation_id string, operation_type string, feature string, formula string, base_formula string, value double, valid boolean"
    rows = spark.createDataFrame([(f"2026-01-0{k}", "op", "t", f, "delta", None, float(k), True) for k in range(1, 6) for f in ("a", "b")], schema)
    wide, catalog = dataset.wide_derived(rows.mapInArrow(count, schema), [], "der")
    assert len(wide.collect()) == 5 and len(catalog) == 2 and seen.value == 10


def test_review_outcomes_over_rows(spark):
    """The rule over rows is that of one record."""
    from sigloom.operators import quality
    from sigloom.signal import record

    rows = [(m, p, s, g) for m in ("auto", "none", "manual", "bad_only", "odd") for p in (True, False) for s in (None, "accepted", "skipped") for g in (None, True, False)]
    df = spark.createDataFrame(rows, "m string, p boolean, s string, g boolean")
    out = df.select("*", *[c.alias(n) for n, c in quality.review_outcome(*map(F.col, "mpsg")).items()]).collect()
    assert all((r.status, r.source, r.passed) == record.decided(r.m, r.p, r.s, r.g) for r in out) and len(out) == len(rows)
