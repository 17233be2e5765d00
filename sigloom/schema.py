"""The canonical row of derived results, and what every boundary does with missing values.

Inside the engine NULL is the only missing value: NaN is turned into NULL wherever data come in. `_ord` is the order in
which rows came in; "first" always means the lowest `_ord`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORD = "_ord"

DERIVED_FIELDS: tuple[tuple[str, str], ...] = (
    ("date", "string"),
    ("operation_id", "string"),
    ("operation_type", "string"),
    ("feature", "string"),
    ("formula", "string"),
    ("base_formula", "string"),
    ("left_source", "string"),
    ("right_source", "string"),
    ("left_value", "double"),
    ("right_value", "double"),
    ("value", "double"),
    ("valid", "boolean"),
    ("reason", "string"),
)
DERIVED_COLUMNS = tuple(name for name, _ in DERIVED_FIELDS)


def finite(c: Column) -> Column:
    """NaN and the infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """df with NaN as NULL in all float and double columns."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(kinds[c])).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def with_order(df: DataFrame, *by: str) -> DataFrame:
    """df with `_ord`: by the given columns if any, else by the place of each row in its file.

    That is the file's path and the row's number in it (Parquet), or the place of its block and its turn there (other
    files), so it does not depend on how the files are dealt to tasks, and stays with the row through all that follows.
    Only tables that come from no file are numbered as they are scanned.
    """
    if by:
        return df.withColumn(ORD, F.struct(*by))
    known = file_metadata(df)
    turn = F.monotonically_increasing_id()  # within a block it rises row by row, whichever task reads it
    if "row_index" in known:
        return df.withColumn(ORD, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    if "file_block_start" in known:
        return df.withColumn(ORD, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), turn.alias("row")))
    return df.withColumn(ORD, turn)


def file_metadata(df: DataFrame) -> str:
    """The type of what Spark knows of the files that the rows of df come from; empty where they come from none, or from
    more tables than one."""
    found = df._jdf.queryExecution().analyzed().metadataOutput()
    kinds = [found.apply(k).dataType().catalogString() for k in range(found.size()) if found.apply(k).name() == "_metadata"]
    return kinds[0] if len(kinds) == 1 else ""


def iso(date: str | Column) -> Column:
    """A date as ISO text."""
    return F.date_format(date, "yyyy-MM-dd")


def day_number(date: str | Column) -> Column:
    """Days since 1970: what range frames are ordered by."""
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def derived_row(keys: list[str], **values: Column) -> list[Column]:
    """The columns of a derived row, in order; what is not given is NULL."""
    kinds = dict(DERIVED_FIELDS)
    return [*[F.col(k) for k in keys], *[values.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in DERIVED_COLUMNS]]
