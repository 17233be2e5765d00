"""The analysis dataset: families of features widened to one row per date, joined on a dense spine of dates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from string import Formatter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import flag, suspicious_names, to_number
from sigloom.plans.protocol import Source
from sigloom.schema import ORD, with_order
from sigloom.storage import materialize

SEPARATOR = "__"
#: How columns are named.
TEMPLATES = {
    "raw_ecg_template": "{prefix}__{phase}__{recording}__{segment}__{feature}",
    "ecg_derived_template": "{prefix}__{operation_id}__{formula_key}__{feature}",
    "context_computed_template": "{prefix}__{feature}",
    "context_derived_template": "{prefix}__{operation_id}__{formula_key}__{feature}",
    "target_template": "{prefix}__{id}",
    "covariate_template": "{prefix}__{id}",
}


def templated(template: str, parts: Mapping[str, Column]) -> Column:
    """A naming template over columns, as str.format has it over texts."""
    out = []
    for text, name, _, _ in Formatter().parse(template):
        out += ([F.lit(text)] if text else []) + ([F.coalesce(parts[name].cast("string"), F.lit("None"))] if name else [])
    return F.concat(*out)


def _ordered(df: DataFrame) -> DataFrame:
    return df if ORD in df.columns else with_order(df)


def first_value(value: Column, where: Column | None = None) -> Column:
    """The first value that is there (and meets a condition), as an aggregate."""
    if where is not None:
        value = F.when(where, value)
    return F.min_by(value, F.when(value.isNotNull(), F.col(ORD)))


def spine(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """All (keys, date) of the tables, each once."""
    parts = [t.select(*keys, "date").where(F.col("date").isNotNull()) for t in tables]
    return reduce(DataFrame.unionByName, parts).distinct()


def feature_flag(feature: str, columns: list[str], names: Mapping[str, str] | None = None) -> str | None:
    """The flag that must be set for a feature of the raw table to count."""
    names = names or {}
    for start, key, usual in (("hrv_", "hrv_valid", "hrv_validated"), ("morph_", "morphology_valid", "morphology_validated")):
        if feature.startswith(start):
            name = names.get(key, usual)
            return name if name in columns else None
    return None


def formula_key(formula: Column, base: Column) -> Column:
    return F.when(base.isNotNull() & (base != ""), F.concat(base, F.lit("_to_"), formula)).otherwise(formula)


def family(feature: str) -> str:
    if SEPARATOR in feature:
        return feature.split(SEPARATOR)[0]
    return next((name for start, name in (("hrv_", "hrv"), ("morph_", "morphology")) if feature.startswith(start)), "context")


def source_mask(source: Source) -> Column:
    asked = [F.col(c) == v for c, v in (("phase", source.phase), ("record_type", source.recording), ("segment_label", source.segment)) if v is not None]
    return reduce(lambda a, b: a & b, asked, F.lit(True))


def wide_raw(raw: DataFrame, sources: list[Source], features: list[str], keys: list[str], prefix: str = "raw_ecg", valid_only: bool = True, template: str = TEMPLATES["raw_ecg_template"]) -> tuple[DataFrame, list[dict]]:
    """One column per source and feature, and the catalog of them: one aggregation, with conditions, for all."""
    raw = _ordered(raw)
    columns, catalog = [], []
    for s in sources:
        for f in features:
            if f not in raw.columns:
                continue
            ok = source_mask(s)
            if valid_only and (name := feature_flag(f, raw.columns)):
                ok = ok & flag(F.col(name))
            column = template.format(prefix=prefix, phase=s.phase, recording=s.recording, segment=s.segment, feature=f)
            columns.append(first_value(to_number(F.col(f"`{f}`")), ok).alias(column))
            catalog.append({"column": column, "role": "input", "source_table": "raw_ecg_features", "feature_family": family(f), "source_id": s.id, "feature": f})
    return raw.where(F.col("date").isNotNull()).groupBy(*keys, "date").agg(F.lit(1).alias("_n"), *columns).drop("_n"), catalog


def wide_derived(derived: DataFrame, keys: list[str], prefix: str, operations: list[str] | None = None, valid_only: bool = True, table: str = "derived", template: str = TEMPLATES["ecg_derived_template"]) -> tuple[DataFrame, list[dict]]:
    """One column per operation, formula and feature that has a value on any date, and the catalog of them.

    The names come from one pass over the distinct operations; there are as many as the protocol has features. The rows
    are written once, so that the plan that makes them does not run for the names and again for the values.
    """
    names = ["operation_id", "operation_type", "formula", "base_formula", "formula_key", "feature"]
    rows = _ordered(derived)
    if operations:
        rows = rows.where(F.col("operation_id").isin(operations))
    ok = flag(F.col("valid")) if valid_only else F.lit(True)
    rows = rows.withColumn("formula_key", formula_key(F.col("formula"), F.col("base_formula"))).where(ok).select(*keys, "date", *names, "value", ORD)
    rows = materialize(rows, "derived")
    found = sorted(rows.where(F.col("value").isNotNull()).select(*names).distinct().collect(), key=lambda r: tuple(map(str, r)))
    catalog = [{"column": template.format(prefix=prefix, operation_id=r.operation_id, formula_key=r.formula_key, feature=r.feature), "role": "input", "source_table": table, "feature_family": family(r.feature), **r.asDict()} for r in found]
    rows = rows.withColumn("_column", templated(template, {"prefix": F.lit(prefix)} | {c: F.col(c) for c in ("operation_id", "formula_key", "feature")}))
    grouped = rows.groupBy(*keys, "date").pivot("_column", list(dict.fromkeys(c["column"] for c in catalog))).agg(first_value(F.col("value")))
    return grouped, catalog


def wide_context(context: DataFrame, features: list[str], keys: list[str], prefix: str = "ctx", template: str = TEMPLATES["context_computed_template"]) -> tuple[DataFrame, list[dict]]:
    rows = _ordered(context)
    known = [f for f in features if f in rows.columns]
    name = {f: template.format(prefix=prefix, feature=f) for f in known}
    out = rows.groupBy(*keys, "date").agg(F.lit(1).alias("_n"), *[first_value(F.col(f"`{f}`")).alias(name[f]) for f in known]).drop("_n")
    return out, [{"column": name[f], "role": "input", "source_table": "context_computed", "feature_family": "context", "feature": f} for f in known]


def named_items(items: list[Mapping[str, Any]], tables: Mapping[str, DataFrame], keys: list[str], prefix: str, template: str = TEMPLATES["target_template"]) -> list[tuple[DataFrame, list[dict]]]:
    """(keys, date, a column for each target or covariate) and their entries in the catalog, for each source table: one
    aggregation with conditions makes all columns of a table."""
    made: dict[str, tuple[list[Column], list[dict]]] = {}
    ordered: dict[str, DataFrame] = {}
    for item in items:
        column, source = template.format(prefix=prefix, id=item["id"]), item["source"]
        entry = {"column": column, "role": prefix, "source_table": source, "feature_family": prefix, "feature": item.get("feature") or item.get("column")} | {k: item.get(k) for k in ("operation_id", "formula", "base_formula")}
        df = tables.get(source)
        if df is None:
            continue
        rows = ordered.setdefault(source, _ordered(df))
        if "column" in item:
            if item["column"] not in rows.columns:
                continue
            value, ok = F.col(f"`{item['column']}`"), F.lit(True)
        else:
            ok = flag(F.col("valid"))
            for k in ("operation_id", "feature", "formula", "base_formula"):
                if item.get(k) is not None:
                    ok = ok & (F.col(k).cast("string") == str(item[k]))
            value = F.col("value")
        columns, entries = made.setdefault(source, ([], []))
        columns.append(first_value(value, ok).alias(column))
        entries.append(entry)
    return [(ordered[source].groupBy(*keys, "date").agg(*columns), entries) for source, (columns, entries) in made.items()]


def qc_summary(raw: DataFrame, sources: list[Source], keys: list[str], context: DataFrame | None = None, required: list[str] | None = None, need_hrv: bool = True, need_morphology: bool = False) -> DataFrame:
    """Per date how many of the required recordings are there and valid, and whether the day is complete."""
    found, hrv, shape = [], [], []
    asked = []
    for k, s in enumerate(sources):
        mask = source_mask(s)
        asked.append(F.max(mask.cast("int")).alias(f"f{k}"))
        for name, column in (("h", "hrv_validated"), ("m", "morphology_validated")):
            asked.append(F.max((mask & (flag(F.col(column)) if column in raw.columns else F.lit(False))).cast("int")).alias(f"{name}{k}"))
        found.append(F.coalesce(F.col(f"f{k}"), F.lit(0)))
        hrv.append(F.coalesce(F.col(f"h{k}"), F.lit(0)))
        shape.append(F.coalesce(F.col(f"m{k}"), F.lit(0)))
    days = raw.groupBy(*keys, "date").agg(F.lit(1).alias("_n"), *asked)
    total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
    n = len(sources)
    complete = total(found) == n
    if need_hrv:
        complete = complete & (total(hrv) == n)
    if need_morphology:
        complete = complete & (total(shape) == n)
    if required:
        if context is None:
            complete = F.lit(False)
        else:
            rows = _ordered(context)
            full = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() if c in rows.columns else F.lit(False) for c in required])
            # the day's first row decides
            per = rows.groupBy(*keys, "date").agg(F.min_by(full, ORD).alias("_full"))
            days = days.join(per, [*keys, "date"], "left")
            complete = complete & F.coalesce("_full", F.lit(False))
    return days.select(
        *keys, "date", F.lit(n).cast("long").alias("n_ecg_records_expected"), total(found).cast("long").alias("n_ecg_records_found"), total(hrv).cast("long").alias("n_ecg_records_valid_hrv"),
        total(shape).cast("long").alias("n_ecg_records_valid_morphology"), complete.alias("complete_core_day"),
    )


def assemble(base: DataFrame, parts: list[DataFrame], keys: list[str], core_days_only: bool = False) -> DataFrame:
    """The spine with all parts joined to it. The parts are grouped by the same keys, so each is shuffled once only."""
    out = base
    for part in parts:
        out = out.join(part, [*keys, "date"], "left")
    if core_days_only:
        out = out.where(F.coalesce("complete_core_day", F.lit(False)))
    return out


CATALOG = "column string, role string, source_table string, feature_family string, source_id string, operation_id string, operation_type string, formula string, base_formula string, formula_key string, feature string, is_target boolean"


def catalog_table(spark, entries: list[dict]) -> DataFrame:
    """The first entry of each column. As small as the protocol."""
    seen: dict[str, dict] = {}
    for e in entries:
        seen.setdefault(e["column"], e)
    names = [x.split()[0] for x in CATALOG.split(", ")][:-1]
    return spark.createDataFrame([(*[e.get(n) for n in names], e["role"] == "target") for e in seen.values()], CATALOG)


def dataset_warnings(columns: list[str], low_unique: int = 0, low_iqr: int = 0, bad_targets: list[str] | None = None) -> list[str]:
    out = []
    if twice := sorted({c for c in columns if columns.count(c) > 1}):
        out.append(f"duplicate columns: {', '.join(twice)}")
    if odd := suspicious_names(columns):
        out.append(f"suspicious column names: {', '.join(odd)}")
    if low_unique or low_iqr:
        out.append(f"features with few values: {low_unique}, with almost no spread: {low_iqr}")
    return out + [f"target not usable: {t}" for t in bad_targets or []]
