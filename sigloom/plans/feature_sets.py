"""Feature sets: names, rules and unions, resolved against the schema when a plan is built."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")
#: What `full` takes.
FULL = {
    "include_prefixes": ["hrv_time__", "hrv_freq__", "hrv_nonlinear__", "morph_p__", "morph_qrs__", "morph_t__"],
    "exclude_contains": ["_idx", "threshold", "Threshold", "Noise", "noise", "snr", "SNR"],
    "exclude": ["hrv_time__n_rr"],
}


def by_rules(df: DataFrame, rules: Mapping[str, Any]) -> list[str]:
    """The numeric columns that the rules take, sorted."""
    take, leave = tuple(rules.get("include_prefixes") or ("",)), tuple(rules.get("exclude_prefixes") or ())
    return sorted(
        c for c, kind in df.dtypes
        if kind in NUMBERS and c.startswith(take) and not (leave and c.startswith(leave)) and c not in (rules.get("exclude") or ()) and not any(x in c for x in rules.get("exclude_contains") or ())
    )


def resolve(df: DataFrame, sets: Mapping[str, Any], name: str, above: tuple[str, ...] = ()) -> list[str]:
    """The features of a set. A list keeps its order and unknown names; these become rows with reason feature_missing."""
    if name in above:
        raise ValueError(f"feature sets include one another: {' > '.join((*above, name))}")
    if name == "full" and name not in sets:
        return by_rules(df, FULL)
    if name not in sets:
        raise ValueError(f"unknown feature set: {name}")
    spec = sets[name]
    if spec == "full":
        return by_rules(df, FULL)
    if "features" in spec:
        return list(spec["features"])
    if "include_feature_sets" in spec:
        return sorted({f for x in spec["include_feature_sets"] for f in resolve(df, sets, x, (*above, name))})
    return by_rules(df, spec)


def union(names: list[str], sets: Mapping[str, Any], columns: list[str], strict: bool = True, above: tuple[str, ...] = ()) -> list[str]:
    """The features of several sets in order, each once. Strict: unknown sets and absent columns raise; else an unknown
    name is taken as the start of column names."""
    out: list[str] = []
    for name in names:
        if name in above:
            raise ValueError(f"feature sets include one another: {' > '.join((*above, name))}")
        spec = sets.get(name)
        if spec is None:
            if strict:
                raise ValueError(f"unknown feature set: {name}")
            out += [c for c in columns if c.startswith(name)]
            continue
        mine = union(list(spec.get("include_feature_sets") or ()), sets, columns, strict, (*above, name))
        mine += list(spec.get("features") or ())
        starts = tuple(spec.get("include_prefixes") or ())
        mine += [c for c in columns if starts and c.startswith(starts)]
        gone = spec.get("exclude_contains") or ()
        out += [f for f in mine if f not in (spec.get("exclude") or ()) and not any(x in f for x in gone)]
    out = list(dict.fromkeys(out))
    if strict and (lost := [f for f in out if f not in columns]):
        raise ValueError(f"features without a column: {', '.join(lost)}")
    return [f for f in out if f in columns]
