"""From a protocol to plans: derived features, context features, the analysis dataset and its reports."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.computed import with_computed
from sigloom.functions.formulas import BASELINE, pairwise_formula
from sigloom.functions.scalars import to_number
from sigloom.operators import analysis, dataset, derived, reports
from sigloom.operators.quality import flag_reason
from sigloom.plans import feature_sets
from sigloom.plans.protocol import Protocol, deep_merge
from sigloom.schema import ORD, nan_to_null, with_order
from sigloom.sources.tables import normal_raw, select_source, write_csv

#: The defaults of the dataset section.
DATASET_DEFAULTS: dict[str, Any] = {
    "include": {
        "qc_summary": {"enabled": True}, "raw_ecg": {"enabled": True, "quality_policy": "valid_only"}, "ecg_derived": {"enabled": True, "quality_policy": "valid_only"}, "context_computed": {"enabled": True},
        "context_derived": {"enabled": True, "quality_policy": "valid_only"},
    },
    "column_naming": {"prefixes": {"raw_ecg": "raw_ecg", "ecg_derived": "ecg_der", "context_computed": "ctx", "context_derived": "ctx_der", "target": "target", "covariate": "covar"}, **dataset.TEMPLATES},
    "join": {"sort_by_date": True},
    "schemas": {},
    "reports": {"save_csv": True, "save_markdown": True, "save_json": True, "sections": {}},
    "feature_set_resolution": {"mode": "strict"},
    "quality_rules": {"feature": reports.FEATURE_RULES, "target": reports.TARGET_RULES, "feature_target_overlap": reports.OVERLAP_RULES, "ml_readiness": reports.READINESS_RULES},
    "core_day_definition": {"require_hrv_valid": True, "require_morphology_valid": False},
    "row_filter": {"enabled": False, "mode": "none"},
}
#: The names that tables have here for those of a schema.
STANDARD = {"recording": "record_type", "segment": "segment_label", "hrv_valid": "hrv_validated", "morphology_valid": "morphology_validated"}


def standard(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """df with the columns that a schema names (what they are -> how they are called) under the names used here."""
    to = {actual: STANDARD.get(what, what) for what, actual in schema.items() if actual in df.columns}
    to = {actual: name for actual, name in to.items() if actual != name}
    keep = [c for c in df.columns if c in to or c not in to.values()]
    return df.select(*[F.col(f"`{c}`").alias(to.get(c, c)) for c in keep])


def _ingested(df: DataFrame) -> DataFrame:
    """df without NaN, and with the order in which its rows came, before any exchange."""
    df = nan_to_null(df)
    return df if ORD in df.columns else with_order(df)


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("the protocol asks for no operation")
    return reduce(DataFrame.unionByName, parts)


def derive_ecg(raw: DataFrame, protocol: Protocol, keys: list[str] | None = None) -> DataFrame:
    """All operations on recordings: one lazy plan, in the order of the protocol; later ones may use earlier ones.

    raw: the feature table with `date` of type date. Give entity keys to do many subjects at once.
    """
    keys = keys or []
    section = protocol.section("derived_features")
    defaults, sets = section.get("defaults") or {}, section.get("feature_sets") or {}
    policy, usual = defaults.get("quality_policy", "valid_only"), defaults.get("feature_set", "full")
    raw = normal_raw(_ingested(raw))
    why = flag_reason(raw.columns)
    done: dict[str, DataFrame] = {}

    def rows(name: str) -> DataFrame:
        s = protocol.sources[name]
        return select_source(raw, s.phase, s.recording, s.segment)

    for op in section.get("operations") or []:
        if op["type"] == "pairwise":
            features = feature_sets.resolve(raw, sets, op.get("feature_set", usual))
            done[op["id"]] = derived.pairwise(rows(op["left"]), rows(op["right"]), raw, features, list(op["formulas"]), operation=op["id"], left_source=op["left"], right_source=op["right"], keys=keys, quality=why, policy=policy)
        elif op["type"] == "pairwise_derived":
            left, right = op["left_operation"], op["right_operation"]
            done[op["id"]] = derived.pairwise_derived(done[left], done[right], list(op["formulas"]), operation=op["id"], left_source=left, right_source=right, base_formulas=op.get("base_formulas"), keys=keys)
        else:
            raise ValueError(f"unknown type of operation: {op['type']}")
    for op in section.get("baseline_deviations") or []:
        features = feature_sets.resolve(raw, sets, op.get("feature_set", usual))
        done[op["id"]] = derived.source_baseline(
            rows(op["source"]), features, list(op["formulas"]), operation=op["id"], profile=section["baseline_profiles"][op["baseline_profile"]], profile_name=op["baseline_profile"],
            include_current=bool(defaults.get("baseline_include_current_day", False)), keys=keys, source=op["source"], spine=raw, quality=why, policy=policy,
        )
    return _union(list(done.values()))


def compute_context(diary: DataFrame, protocol: Protocol) -> DataFrame:
    """The diary with its computed columns."""
    return with_computed(nan_to_null(diary), list(protocol.section("context_features").get("computed_columns") or []))


def derive_context(context: DataFrame, protocol: Protocol, keys: list[str] | None = None) -> DataFrame:
    """All operations on the diary."""
    keys = keys or []
    section = protocol.section("context_features")
    defaults, sets = section.get("defaults") or {}, section.get("feature_sets") or {}
    current = bool(defaults.get("baseline_include_current_day", False))
    context = _ingested(context)
    parts, windows = [], []
    asked = {op["id"]: tuple(feature_sets.resolve(context, sets, op["feature_set"])) if "feature_set" in op else () for op in section.get("operations") or []}
    used = {f for fs in asked.values() for f in fs}
    # text that is no number is missing
    table = context.select(*[to_number(F.col(f"`{c}`")).alias(c) if c in used and k == "string" else F.col(f"`{c}`") for c, k in context.dtypes])
    for op in section.get("operations") or []:
        kind, formulas, features = op["type"], tuple(op.get("formulas") or ()), asked[op["id"]]
        if kind == "pairwise_columns":
            parts.append(derived.pairwise_columns(table, list(op["pairs"]), list(formulas), operation=op["id"], keys=keys))
        elif kind == "lagged_pairwise":
            parts.append(derived.lagged_pairwise(table, list(features), list(formulas), operation=op["id"], lag_days=int(op.get("lag_days", 1)), keys=keys))
        elif kind == "baseline_deviation":
            name = op["baseline_profile"]
            windows.append(derived.Baseline(op["id"], features, formulas, section["baseline_profiles"][name], name, bool(op.get("include_current_day", current))))
        elif kind == "rolling_aggregate":
            windows.append(derived.Rolling(op["id"], features, tuple(op["aggregations"]), int(op["window_days"]), int(op.get("min_periods", 1)), bool(op.get("include_current_day", False))))
        else:
            raise ValueError(f"unknown type of operation: {kind}")
    if windows:  # all trailing windows together: one exchange
        parts.append(derived.trailing_operations(table, windows, keys))
    return _union(parts)


@dataclass
class Dataset:
    data: DataFrame
    catalog: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    settings: Mapping[str, Any] = field(default_factory=dict)

    def enabled(self) -> dict[str, DataFrame]:
        """The reports that the protocol does not switch off."""
        sections = self.settings.get("sections") or {}
        return {k: v for k, v in self.reports.items() if (sections.get(k) or {}).get("enabled", True)}

    def summary(self) -> dict[str, Any]:
        row = reports.summary(self.data, self.reports["targets"], self.reports["feature_availability"]).first()
        return row.asDict() | {"warnings": self.warnings}


def build_dataset(tables: Mapping[str, DataFrame | None], protocol: Protocol, keys: list[str] | None = None) -> Dataset:
    """One row per date from raw_ecg_features, ecg_derived, context_computed and context_derived, with its reports.

    The dataset is cached: all reports read it. unpersist() it when done.
    """
    keys = keys or []
    cfg = deep_merge(DATASET_DEFAULTS, protocol.section("analysis_dataset"))
    include, prefix = cfg["include"], cfg["column_naming"]["prefixes"]
    strict = cfg["feature_set_resolution"].get("mode", "strict") == "strict"
    given = {k: _ingested(standard(t, cfg["schemas"].get(k) or {})).withColumn("date", F.col("date").cast("date")) for k, t in tables.items() if t is not None}
    on, template = (lambda name: bool(include[name].get("enabled", False))), cfg["column_naming"]
    raw, context = given.get("raw_ecg_features"), given.get("context_computed")
    spark = next(iter(given.values())).sparkSession
    parts: list[DataFrame] = []
    entries: list[dict] = [{"column": "date", "role": "meta"}]
    core = cfg["core_day_definition"]
    if raw is not None and on("qc_summary"):
        sources = [protocol.sources[s] for s in core.get("required_ecg_sources") or []]
        qc = dataset.qc_summary(raw, sources, keys, context, list(core.get("required_context_columns") or []), core["require_hrv_valid"], core["require_morphology_valid"])
        parts.append(qc)
        entries += [{"column": c, "role": "qc"} for c in qc.columns if c not in (*keys, "date")]
    if raw is not None and on("raw_ecg"):
        asked = include["raw_ecg"]
        features = feature_sets.union(list(asked.get("feature_sets") or []), protocol.section("derived_features").get("feature_sets") or {}, raw.columns, strict)
        wide, catalog = dataset.wide_raw(raw, [protocol.sources[s] for s in asked.get("sources") or []], features, keys, prefix["raw_ecg"], asked.get("quality_policy") == "valid_only", template["raw_ecg_template"])
        parts.append(wide)
        entries += catalog
    for name in ("ecg_derived", "context_derived"):
        if name in given and on(name):
            wide, catalog = dataset.wide_derived(given[name], keys, prefix[name], list(include[name].get("operations") or []), include[name].get("quality_policy", "valid_only") == "valid_only", name, template[f"{name}_template"])
            parts.append(wide)
            entries += catalog
    if context is not None and on("context_computed"):
        features = feature_sets.union(list(include["context_computed"].get("feature_sets") or []), protocol.section("context_features").get("feature_sets") or {}, context.columns, strict)
        wide, catalog = dataset.wide_context(context, features, keys, prefix["context_computed"], template["context_computed_template"])
        parts.append(wide)
        entries += catalog
    items = {kind: list(cfg.get(f"{kind}s") or []) for kind in ("target", "covariate")}
    columns: dict[str, str] = {}
    for kind, given_items in items.items():
        for part, found in dataset.named_items(given_items, given, keys, prefix[kind], template[f"{kind}_template"]):
            parts.append(part)
            entries += [entry | {"role": kind} for entry in found]
        columns |= {t["id"]: template["target_template"].format(prefix=prefix["target"], id=t["id"]) for t in given_items if kind == "target"}
    core_only = cfg["row_filter"].get("enabled") and cfg["row_filter"].get("mode") == "complete_core_day" and raw is not None and on("qc_summary")
    data = dataset.assemble(dataset.spine(list(given.values()), keys), parts, keys, bool(core_only)).cache()
    out = Dataset(data, dataset.catalog_table(spark, entries), order=["date", *keys] if cfg["join"].get("sort_by_date", True) else [], settings=cfg["reports"])
    rules = cfg["quality_rules"]
    made = out.reports
    if raw is not None and on("qc_summary"):
        made["coverage_by_day"] = reports.coverage(data, keys)
    if raw is not None:
        made["ecg_quality"] = reports.ecg_quality(raw)
    if context is not None:
        asked_columns = dict.fromkeys([e["feature"] for e in entries if e.get("source_table") == "context_computed" and e["role"] == "input"] + [t["column"] for kind in items.values() for t in kind if "column" in t])
        made["context_completeness"] = reports.completeness(context, list(asked_columns))
    operations = [reports.derived_operations(given[n], n) for n in ("ecg_derived", "context_derived") if n in given]
    if operations:
        made["derived_operations"] = _union(operations)
    made["targets"] = reports.targets(data, items["target"], columns, rules["target"])
    made["feature_availability"] = reports.availability(data, out.catalog, rules["feature"])
    inputs = [e["column"] for e in entries if e["role"] not in ("meta", "qc", "target")]
    there = {t: c for t, c in columns.items() if c in data.columns}
    made["feature_target_overlap"] = reports.overlap(data, there, list(dict.fromkeys(inputs)), rules["feature_target_overlap"])
    made["ml_readiness"] = reports.readiness(made["targets"], made["feature_target_overlap"], rules["ml_readiness"])
    low = made["feature_availability"].agg(F.count(F.when(F.col("reason").contains("low_unique"), 1)), F.count(F.when(F.col("reason").contains("low_iqr"), 1))).first()
    bad = [r[0] for r in made["targets"].where("NOT usable").select("target").collect()]  # a row a target
    out.warnings = dataset.dataset_warnings(data.columns, low[0], low[1], bad)
    return out


def analyse(built: Dataset, protocol: Protocol, row_id: list[str]) -> dict[str, DataFrame]:
    """Association, stability, ranks and redundancy of the features in scope, by the protocol's feature_analysis."""
    cfg = protocol.section("feature_analysis")
    scope, rules = cfg.get("feature_scope") or {}, cfg.get("quality_rules") or {}
    asked = [t for t in (cfg.get("target_analysis") or {}).get("targets") or [] if t["column"] in built.data.columns]
    targets = [t["column"] for t in asked]
    # a target that is better when higher is turned round, so that a positive association means worse for all
    turned = {t["column"]: analysis.directed(F.col(f"`{t['column']}`"), t.get("direction", "")) for t in asked}
    data = built.data.select(*[turned[c].alias(c) if c in turned else F.col(f"`{c}`") for c in built.data.columns])
    wanted = analysis.in_scope(built.catalog, scope.get("ecg_only", True), scope.get("access_mode", "all"), tuple(scope.get("exclude_roles") or ()), tuple(scope.get("manual_features") or ()), scope.get("selection_mode", "auto"))
    names = [r[0] for r in wanted.select("column").collect() if r[0] in data.columns]  # as many as the protocol has
    fit = analysis.quality_rules(reports.summarize(data, names), rules.get("max_missing_ratio", 0.5), rules.get("min_unique_values", 4))
    names = [r[0] for r in fit.select("column").collect()]
    control = cfg.get("leakage_control") or {}
    both = analysis.pairs(data, row_id, targets, names)
    if control.get("enabled", True):
        gone = analysis.leaks(data, built.catalog, targets, control.get("forbidden_features_by_target") or {})
        both = both.join(F.broadcast(gone.select("target", "feature")), ["target", "feature"], "left_anti")  # columns of the protocol
    association = analysis.spearman(both).where(F.col("n") >= rules.get("min_overlap_n", 10))
    stability = analysis.direction_stability(both)
    weights = ((cfg.get("ranking") or {}).get("rank_score") or {}).get("weights") or {}
    limits = cfg.get("association") or {}
    ranked = analysis.ranking(association, stability, (weights.get("abs_spearman", 0.7), weights.get("direction_stability", 0.3)), limits.get("min_abs_spearman", 0.3), limits.get("min_direction_stability", 0.7))
    multi = cfg.get("multi_target_validation") or {}
    across = analysis.across_targets(ranked, len(targets), multi.get("require_pass_all_targets", True), multi.get("min_cross_target_direction_consistency", 1.0))
    links = analysis.redundancy(data, row_id, names, (cfg.get("redundancy") or {}).get("threshold_abs_corr", 0.85))
    out = {"ranking": ranked, "across_targets": across, "redundancy": links}
    if (cfg.get("redundancy") or {}).get("enabled", True):
        best = ranked.groupBy("feature").agg(F.max("score").alias("score"))
        stand = sorted(analysis.representatives(links, best).items())  # as many as the protocol has features
        out["representatives"] = data.sparkSession.createDataFrame(stand, "feature string, representative string")
    return out


def write_dataset(built: Dataset, path: str) -> None:
    """Dataset and catalog as Parquet, reports as CSV, and a summary as JSON and Markdown, under path; what is sorted, and
    which reports are written and under which names, as the protocol says."""
    data = built.data.orderBy(*[F.col(f"`{c}`") for c in built.order]) if built.order else built.data
    data.write.mode("overwrite").parquet(f"{path}/dataset")
    built.catalog.write.mode("overwrite").parquet(f"{path}/catalog")
    wanted, sections = built.enabled(), built.settings.get("sections") or {}
    if built.settings.get("save_csv", True):
        for name, df in wanted.items():
            file = (sections.get(name) or {}).get("output", f"report_{name}")
            write_csv(df, f"{path}/{file.removesuffix('.csv')}", bom=True, order=reports.order_of(name, df))
    facts = built.summary()
    shown = {k: v for k, v in facts.items() if k != "warnings"} if (sections.get("summary") or {}).get("enabled", True) else {}
    text = reports.markdown("Analysis dataset", shown, built.warnings, wanted)
    rows = built.data.sparkSession.createDataFrame([(json.dumps(facts, ensure_ascii=False, default=str), text)], "facts string, text string")
    if built.settings.get("save_json", True):
        rows.select("facts").write.mode("overwrite").text(f"{path}/summary_json")
    if built.settings.get("save_markdown", True):
        rows.select("text").write.mode("overwrite").text(f"{path}/summary_markdown")


def check_formulas(protocol: Protocol) -> list[str]:
    """The formulas that the protocol names and nothing defines."""
    bad = []
    for section in ("derived_features", "context_features"):
        s = protocol.section(section)
        for op in [*(s.get("operations") or []), *(s.get("baseline_deviations") or [])]:
            for f in op.get("formulas") or []:
                if op.get("type") == "baseline_deviation" or "baseline_profile" in op:
                    bad += [f"{op['id']}: {f}"] if f not in BASELINE else []
                else:
                    try:
                        pairwise_formula(f)
                    except ValueError:
                        bad.append(f"{op['id']}: {f}")
    return bad
