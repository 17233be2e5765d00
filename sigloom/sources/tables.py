"""Tables in, tables out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.scalars import normal_record, normal_segment, with_numbers
from sigloom.plans.protocol import java_date_format, resolve_path
from sigloom.schema import nan_to_null, with_order


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "utf-8", schema: str | None = None) -> DataFrame:
    """A CSV file as text columns (or by schema), with blank and generated column names dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8" if encoding.lower().startswith("utf-8") else encoding).option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    names = [c.removeprefix("﻿").strip() for c in df.columns]
    df = df.toDF(*[n or f"_c{k}" for k, n in enumerate(names)])
    keep = [c for c in df.columns if not c.lower().startswith("unnamed:") and not _generated(c)]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def _generated(name: str) -> bool:
    return name.startswith("_c") and name[2:].isdigit()


def read_diary(spark: SparkSession, path: str, *, date_column: str = "Date", date_format: str = "%d.%m.%Y", sep: str = ";", text_columns: tuple[str, ...] = ()) -> DataFrame:
    """A diary with decimal commas: numbers are found by sniffing; `date` is added, NULL where it cannot be read."""
    df = with_numbers(read_csv(spark, path, sep=sep), (date_column, *text_columns))
    return with_order(with_date(df, date_column, date_format, "null"))


def with_date(df: DataFrame, column: str, fmt: str, policy: str = "raise") -> DataFrame:
    """df with `date` of type date from a text column in a strict format. Policy for what cannot be read: raise, or null
    (which raises as well if no date at all can be). A text column of the same name is kept as <name>_text."""
    if column.lower() == "date":
        df = df.withColumnRenamed(column, column := f"{column}_text")
    text = F.col(f"`{column}`").cast("string")
    out = df.withColumn("date", F.try_to_timestamp(text, F.lit(java_date_format(fmt))).cast("date"))
    lost = F.col("date").isNull()
    n, bad = out.agg(F.count("*"), F.count(F.when(lost, 1))).first()
    if bad and (policy == "raise" or bad == n):
        some = [str(r[0]) for r in out.where(lost).select(text).limit(5).collect()]
        raise ValueError(f"{bad} of {n} dates in {column} are not like {fmt}: {', '.join(some)}")
    return out


def read_tables(spark: SparkSession, tables: Mapping[str, Mapping[str, Any]], root: str = "") -> dict[str, DataFrame | None]:
    """The tables of a dataset: CSV or Parquet by the end of the name. A missing one raises if required, else is None."""
    out: dict[str, DataFrame | None] = {}
    for name, spec in tables.items():
        path = resolve_path(spec["path"], root)
        try:
            df = spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path, sep=(spec.get("csv") or {}).get("sep", ","))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            if spec.get("required", True):
                raise FileNotFoundError(f"table {name}: nothing at {path}") from e
            out[name] = None
            continue
        out[name] = nan_to_null(with_date(df, spec.get("date_column", "date"), spec.get("date_format", "%Y-%m-%d"), "raise"))
    return out


#: The names under which older tables have the record and the segment.
RECORD_NAMES = ("record_type", "recording", "recording_id", "record")
SEGMENT_NAMES = ("segment", "segment_label", "segment_id", "segment_name")


def normal_raw(df: DataFrame) -> DataFrame:
    """A raw feature table with phase, record_type and segment in their normal form."""
    if "phase" not in df.columns:
        raise ValueError("the raw table has no column phase")
    record = next((c for c in RECORD_NAMES if c in df.columns), None)
    if record is None:
        raise ValueError(f"the raw table has none of {', '.join(RECORD_NAMES)}")
    segment = next((c for c in SEGMENT_NAMES if c in df.columns), None)
    return df.withColumns({"phase": F.trim("phase"), "record_type": normal_record(F.col(record)), "segment": normal_segment(F.col(segment) if segment else F.lit("full"))})


def select_source(df: DataFrame, phase: str | None, recording: str | None, segment: str | None) -> DataFrame:
    """The rows of a source: the conditions given, all of them."""
    asked = [F.col(c) == v for c, v in (("phase", phase), ("record_type", recording), ("segment", segment)) if v is not None]
    return df.where(reduce(lambda a, b: a & b, asked, F.lit(True)))


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", *, sep: str = ",", bom: bool = False, order: list[str] | None = None) -> None:
    """CSV with a header, in the order given. bom: each file begins with a byte order mark (as part of its first name)."""
    df = df.orderBy(*[F.col(f"`{c}`") for c in order]) if order else df
    df = df.toDF(*[("\ufeff" if bom and k == 0 else "") + c for k, c in enumerate(df.columns)])
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").option("sep", sep).csv(path)


def write_days(df: DataFrame, path: str) -> None:
    """Parquet by date; only the dates that df holds are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_reviews(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities as null."""
    nan_to_null(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


REVIEW_SCHEMA = (
    "signal_review struct<status:string,signal:array<double>,signal_filtered:array<double>,rpeaks:array<int>,rpeaks_no_edge:array<int>,sampling_rate:double,log:array<struct<step:string,value:string>>,"
    "qc:struct<clipping_ratio:double,rr_phys_bad_ratio:double,n_rpeaks:bigint,mean_hr_bpm_rough:double>>, "
    "hrv_review struct<status:string,qc_gate:struct<passed:boolean,stage:string,reasons:array<string>>,source:string,log:array<struct<step:string,value:string>>>, "
    "morphology_review struct<status:string,qc_gate:struct<passed:boolean,stage:string,reasons:array<string>>,corr_threshold:double,error:string,log:array<struct<step:string,value:string>>>, "
    "meta struct<date:string,phase:string,record_type:string,sampling_rate:double,segment_label:string,segment_start_sec:double,segment_end_sec:double,window_idx:int>"
)


def read_reviews(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Review records: a file each, or lines of them as write_reviews() makes them."""
    return spark.read.schema(REVIEW_SCHEMA).option("multiLine", not lines).option("recursiveFileLookup", True).json(path)


def decisions(reviews: DataFrame) -> DataFrame:
    """A row per reviewed segment: its key, the status of each part, whether the gate passed on what was reviewed, and its peaks."""
    m, gate = F.col("meta"), "qc_gate.passed"
    return reviews.select(
        m["date"].alias("date"), m["phase"].alias("phase"), m["record_type"].alias("record_type"), F.coalesce(m["segment_label"], F.lit("full")).alias("segment_label"), m["window_idx"].alias("window_idx"),
        F.col("signal_review.status").alias("signal_review_status"), F.col("hrv_review.status").alias("hrv_review_status"), F.col(f"hrv_review.{gate}").alias("hrv_qc_passed"),
        F.col("morphology_review.status").alias("morphology_review_status"), F.col(f"morphology_review.{gate}").alias("morphology_qc_passed"),
        F.col("signal_review.rpeaks").alias("rpeaks"), F.col("signal_review.rpeaks_no_edge").alias("rpeaks_no_edge"),
    )
