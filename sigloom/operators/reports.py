"""Reports on a dataset. All columns are summarised in one job over the unpivoted form."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.scalars import report_flag
from sigloom.operators.ranks import exact_quantiles

STATS = ("n_total", "n_valid", "valid_ratio", "n_missing", "missing_ratio", "n_unique", "mean", "median", "std", "iqr", "min", "max")
FEATURE_RULES = {"min_valid_n": 10, "min_valid_ratio": 0.6, "min_unique_values": 5, "min_iqr": 1e-9}
TARGET_RULES = FEATURE_RULES | {"min_unique_values": 4}
OVERLAP_RULES = {"min_overlap_n": 10, "min_overlap_ratio": 0.5}
READINESS_RULES = {"min_samples_regression": 15, "max_features_to_samples_ratio": 0.5}


#: What each report is sorted by where it is written.
ORDER = {
    "coverage_by_day": ["date"], "ecg_quality": ["phase", "record_type", "segment_label"], "context_completeness": ["column"], "derived_operations": ["table", "operation_id", "formula"], "targets": ["target"],
    "feature_availability": ["feature"], "feature_target_overlap": ["target", "feature"], "ml_readiness": ["target"],
}


def order_of(name: str, df: DataFrame) -> list[str]:
    """The columns that a report is sorted by; the others follow, so that ties have one order too."""
    first = [c for c in ORDER.get(name, []) if c in df.columns]
    return first + [c for c in df.columns if c not in first]


def top(df: DataFrame, name: str = "", n: int = 20) -> DataFrame:
    """The first n rows of a report in its order."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_of(name, df)]).limit(n)


def unpivot(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, column, v): one row per row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def summarize(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, STATS) of each column.

    Quartiles are exact by a second pass between brackets (ranks.exact_quantiles), distinct values are counted where they
    fall, so no column comes together in one task; exact=False takes sketches in one pass (ranks within 0.01 %, counts
    within 1 %).
    """
    asked = [0.25, 0.5, 0.75]
    unique = F.count_distinct("v") if exact else F.approx_count_distinct("v", 0.01)
    sketch = [] if exact else [F.percentile_approx("v", asked, 10000).alias("q")]
    long = unpivot(df, columns)
    per = long.groupBy("column").agg(F.count("*").alias("n_total"), F.count("v").alias("n_valid"), unique.alias("n_unique"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), *sketch)
    if exact:
        per = per.join(exact_quantiles(long, ["column"], "v", asked), "column", "left")
    ratio = F.col("n_valid") / F.col("n_total")
    per = per.withColumns({"valid_ratio": ratio, "n_missing": F.col("n_total") - F.col("n_valid"), "missing_ratio": 1.0 - ratio, "median": F.col("q")[1], "iqr": F.col("q")[2] - F.col("q")[0]})
    return per.select("column", *STATS)


def rule_reasons(rules: Mapping[str, Any]) -> Column:
    """The rules that a summarised column breaks, or `ok`."""
    asked = {
        "low_valid_n": F.col("n_valid") < rules.get("min_valid_n", 0),
        "low_valid_ratio": F.col("valid_ratio") < rules.get("min_valid_ratio", 0),
        "low_unique_values": F.col("n_unique") < rules.get("min_unique_values", 0),
        "low_iqr": F.coalesce(F.col("iqr") <= rules.get("min_iqr", 0), F.lit(False)),
    }
    text = F.concat_ws(";", *[F.when(bad, F.lit(name)) for name, bad in asked.items()])
    return F.when(text == "", "ok").otherwise(text)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """The summary of each column asked for; a column that is absent is a row as well."""
    known = [c for c in columns if c in df.columns]
    found = summarize(df, known).select("column", F.lit(True).alias("present"), *STATS, F.lit("ok").alias("reason"))
    lost = [c for c in columns if c not in known]
    if not lost:
        return found
    blank = {"n_valid": F.lit(0).cast("long"), "valid_ratio": F.lit(0.0), "n_total": F.col("n_total")}
    kinds = dict(found.dtypes)
    rows = df.agg(F.count("*").alias("n_total")).select("n_total", F.explode(F.array(*map(F.lit, lost))).alias("column"))
    return found.unionByName(rows.select("column", F.lit(False).alias("present"), *[blank.get(s, F.lit(None)).cast(kinds[s]).alias(s) for s in STATS], F.lit("missing_column").alias("reason")))


def targets(df: DataFrame, items: list[Mapping[str, Any]], columns: Mapping[str, str], rules: Mapping[str, Any] = TARGET_RULES) -> DataFrame:
    """A row per target: its labels, summary, and whether it is usable."""
    spark = df.sparkSession
    labels = ("label", "direction", "horizon", "data_type", "scale_type")
    rows = [(t["id"], columns.get(t["id"]), *[t.get(k, "") for k in labels]) for t in items]
    asked = spark.createDataFrame(rows, "target string, column string, " + ", ".join(f"{k} string" for k in labels))
    stats = summarize(df, sorted({c for _, c, *_ in rows if c in df.columns}))
    there = F.col("n_total").isNotNull()
    out = F.broadcast(asked).join(stats, "column", "left")  # a row per target of the protocol
    reason = F.when(there, rule_reasons(rules)).otherwise("missing_target_column")
    return out.select("target", "column", *labels, there.alias("present"), *STATS, (there & (reason == "ok")).alias("usable"), reason.alias("reason"))


def availability(df: DataFrame, catalog: DataFrame, rules: Mapping[str, Any] = FEATURE_RULES) -> DataFrame:
    """A row per feature of the catalog that is neither meta, quality figure nor target."""
    asked = catalog.where(~F.col("role").isin("meta", "qc", "target")).select(F.col("column").alias("feature"), "role", "source_table", "feature_family")
    names = [r[0] for r in asked.select("feature").collect() if r[0] in df.columns]  # as many as the protocol has
    stats = summarize(df, names).withColumnRenamed("column", "feature")
    reason = rule_reasons(rules)
    return stats.join(F.broadcast(asked), "feature").select("feature", "role", "source_table", "feature_family", *STATS, (reason == "ok").alias("usable"), reason.alias("reason"))


def overlap(df: DataFrame, target_columns: Mapping[str, str], features: list[str], rules: Mapping[str, Any] = OVERLAP_RULES) -> DataFrame:
    """For each target and feature on how many rows both are there. One pass: counts per target over the unpivoted features."""
    flags = [F.col(f"`{c}`").isNotNull().alias(f"_t{k}") for k, c in enumerate(target_columns.values())]
    long = unpivot(df.select("*", *flags), features, tuple(f"_t{k}" for k in range(len(flags))))
    both = [F.struct(F.lit(t).alias("target"), F.lit(c).alias("target_column"), F.count(F.when(F.col(f"_t{k}"), 1)).alias("nt"), F.count(F.when(F.col(f"_t{k}"), F.col("v"))).alias("n")) for k, (t, c) in enumerate(target_columns.items())]
    per = long.groupBy(F.col("column").alias("feature")).agg(F.count("*").alias("total"), F.count("v").alias("nf"), F.array(*both).alias("x"))
    per = per.select("feature", "total", "nf", F.inline("x"))
    ratio = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    text = F.concat_ws(";", F.when(F.col("n") < rules["min_overlap_n"], "low_overlap_n"), F.when(ratio < rules["min_overlap_ratio"], "low_overlap_ratio"))
    return per.select(
        "target", "target_column", "feature", F.col("nt").alias("n_target_valid"), F.col("nf").alias("n_feature_valid"), F.col("n").alias("n_overlap"), ratio.alias("overlap_ratio"), (text == "").alias("usable"),
        F.when(text == "", "ok").otherwise(text).alias("reason"),
    )


def readiness(target_report: DataFrame, overlap_report: DataFrame, rules: Mapping[str, Any] = READINESS_RULES) -> DataFrame:
    """Per target how many samples and usable features there are, and what they are fit for."""
    per = overlap_report.where("usable").groupBy("target").agg(F.count_distinct("feature").alias("nf"))
    rows = target_report.select("target", F.coalesce("n_valid", F.lit(0)).alias("ns"), "usable").join(per, "target", "left").withColumn("nf", F.coalesce("nf", F.lit(0)))
    ratio = F.try_divide(F.col("nf").cast("double"), F.col("ns").cast("double"))
    text = F.concat_ws(
        ";", F.when(F.col("ns") < rules["min_samples_regression"], "too_few_samples_for_regression"), F.when(ratio > rules["max_features_to_samples_ratio"], "too_many_features_for_samples"), F.when(~F.col("usable"), "target_not_usable")
    )
    use = F.when(text == "", "descriptive_or_feature_analysis").otherwise("diagnostic_only")
    return rows.select("target", F.col("ns").alias("n_samples"), F.col("nf").alias("n_usable_features_by_overlap"), ratio.alias("feature_sample_ratio"), use.alias("recommended_use"), F.when(text == "", "ok").otherwise(text).alias("warning"))


def ecg_quality(raw: DataFrame, group: tuple[str, ...] = ("phase", "record_type", "segment_label"), hrv: str = "hrv_validated", shape: str = "morphology_validated") -> DataFrame:
    asked = [F.count("*").alias("n_total"), F.count_distinct("date").alias("n_dates")]
    for name, column in (("hrv", hrv), ("morphology", shape)):
        if column in raw.columns:
            ok = report_flag(F.col(column))
            asked += [F.count(F.when(ok, 1)).alias(f"{name}_valid_n"), F.avg(ok.cast("double")).alias(f"{name}_valid_ratio")]
    return raw.groupBy(*group).agg(*asked)


def derived_operations(derived: DataFrame, table: str) -> DataFrame:
    """Per operation and formula: rows, dates, features, valid rows and the most frequent reason (the first by name in a tie)."""
    by = ["operation_id", "operation_type", "formula", "base_formula"]
    ok = report_flag(F.col("valid"))
    per = derived.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.count_distinct("feature").alias("n_features"), F.count(F.when(ok, 1)).alias("valid_n"), F.avg(ok.cast("double")).alias("valid_ratio"))
    why = derived.where(F.col("reason") != "").groupBy(*by, "reason").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "reason"))
    top = why.withColumn("_r", rank).where("_r = 1").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("reason").alias("main_invalid_reason"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = per.join(top, same, "left")
    return out.select(F.lit(table).alias("table"), *by, "n_rows", "n_dates", "n_features", "valid_n", "valid_ratio", F.coalesce("main_invalid_reason", F.lit("")).alias("main_invalid_reason"))


def coverage(qc: DataFrame, keys: list[str]) -> DataFrame:
    return qc.select(*keys, "date", "n_ecg_records_expected", "n_ecg_records_found", "n_ecg_records_valid_hrv", "n_ecg_records_valid_morphology", "complete_core_day")


def summary(df: DataFrame, target_report: DataFrame, feature_report: DataFrame) -> DataFrame:
    """One row of counts and the range of dates."""
    rows = df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"))
    t = target_report.agg(F.count("*").alias("n_targets"), F.count(F.when(F.col("usable"), 1)).alias("n_usable_targets"))
    f = feature_report.agg(F.count("*").alias("n_features_total"), F.count(F.when(F.col("usable"), 1)).alias("n_usable_features"))
    return rows.crossJoin(t).crossJoin(f)  # three single rows


def markdown(title: str, facts: Mapping[str, Any], warnings: list[str], reports: Mapping[str, DataFrame], limit: int = 20) -> str:
    """A report as text: facts, warnings, and the first rows of each table."""
    out = [f"# {title}", "", "## Summary", *[f"- **{k}**: {v}" for k, v in facts.items()]]
    if warnings:
        out += ["", "## Warnings", *[f"- {w}" for w in warnings]]
    for name, df in reports.items():
        rows = top(df, name, limit + 1).collect()
        out += ["", f"## {name.replace('_', ' ').title()}"]
        if not rows:
            out.append("No rows.")
            continue
        line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
        out += [line(df.columns), line(["---"] * len(df.columns)), *map(line, rows[:limit])]
        if len(rows) > limit:
            out += ["", f"The first {limit} rows."]
    return "\n".join(out) + "\n"
