"""The protocol: a YAML or JSON file that says which recordings, features, operations and reports there are.

It is read and checked on the driver, once, before any plan is built: all errors are collected and raised together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from sigloom.operators.quality import MORPHOLOGY_LIMITS, SIGNAL_LIMITS

#: Groups, modes of segmentation and of recordings, and review modes with whether they need a human.
FEATURE_GROUPS = ("hrv_time", "hrv_extended", "morphology")
SEGMENTATION_MODES = ("full", "fixed_windows", "named_subsegments")
RECORD_MODES = ("static", "windowed", "breath_hold")
REVIEW_MODES = {"manual": True, "manual_all": True, "manual_each_window": True, "bad_only": True, "auto": False, "none": False}


class ProtocolError(ValueError):
    """All that is wrong with a protocol, one line each."""


@dataclass(frozen=True)
class Source:
    """Which rows of the raw table are meant: by phase, recording and segment."""

    id: str
    phase: str | None = None
    recording: str | None = None
    segment: str = "full"


@dataclass(frozen=True)
class RecordPlan:
    """All that is needed to process the recordings of one phase and kind."""

    recording: str
    phase: str
    file_names: tuple[str, ...]
    mode: str
    quality_profile: str
    segmentation_profile: str
    segmentation: Mapping[str, Any]
    review_mode: str
    review_scope: str
    feature_groups: tuple[str, ...]
    signal_limits: Mapping[str, Any]
    morphology_limits: Mapping[str, Any] | None
    sampling_rate: float | None
    expected_duration_sec: float | None
    aggregation_role: str | None = None
    corr_threshold: float = 0.8

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def hash(self) -> str:
        """The same for plans that are the same: what a stored result is valid for."""
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Protocol:
    raw: Mapping[str, Any]
    date_format: str = "dd.MM.yyyy"
    phases: tuple[str, ...] = ()
    plans: tuple[RecordPlan, ...] = ()
    sources: Mapping[str, Source] = field(default_factory=dict)

    def section(self, name: str) -> Mapping[str, Any]:
        return self.raw.get(name) or {}


def load(path: str | Path) -> Mapping[str, Any]:
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() == ".json":
        return json.loads(text)
    if path.suffix.lower() not in (".yaml", ".yml"):
        raise ProtocolError(f"a protocol is .yaml, .yml or .json, not {path.suffix}")
    import yaml

    return yaml.safe_load(text) or {}


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with the values of over; mappings are merged, all else (lists too) is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def resolve_path(path: str, base: str) -> str:
    """A path of the protocol: as it is if absolute or with a scheme, else below base."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


def runtime_protocol(raw: Mapping[str, Any], base: str, inputs: Mapping[str, str] | None = None) -> dict[str, Any]:
    """A copy of the protocol with the paths of all tables absolute: those of inputs where given, else below base."""
    given = dict(inputs or {})
    tables = {k: dict(v) for k, v in ((raw.get("analysis_dataset") or {}).get("tables") or {}).items()}
    for name, path in given.items():
        tables.setdefault(name, {})["path"] = path
    for spec in tables.values():
        if "path" in spec:
            spec["path"] = resolve_path(spec["path"], base)
    return deep_merge(raw, {"analysis_dataset": {"tables": tables}}) if tables else dict(raw)


def java_date_format(text: str) -> str:
    """A strftime format as a Spark one."""
    for a, b in (("%d", "dd"), ("%m", "MM"), ("%Y", "yyyy"), ("%y", "yy"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss")):
        text = text.replace(a, b)
    return text


def requires_manual(mode: str) -> bool:
    return REVIEW_MODES.get(mode, True)


def signal_limits(profile: Mapping[str, Any], technical: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The limits of the signal gate: heart rates become bounds of intervals."""
    hr = profile.get("expected_hr_bpm") or {}
    out = SIGNAL_LIMITS | dict(technical or {})
    if hr.get("max"):
        out["rr_min_sec"] = 60.0 / float(hr["max"])
    if hr.get("min"):
        out["rr_max_sec"] = 60.0 / float(hr["min"])
    return out


def morphology_limits(profile: Mapping[str, Any], technical: Mapping[str, Any] | None = None) -> dict[str, Any] | None:
    shape = profile.get("morphology") or {}
    if not shape.get("enabled"):
        return None
    width = shape.get("expected_qrs_duration_ms") or {}
    out = MORPHOLOGY_LIMITS | dict(technical or {})
    out |= {"qrs_duration_min_ms": float(width.get("min", out["qrs_duration_min_ms"])), "qrs_duration_max_ms": float(width.get("max", out["qrs_duration_max_ms"]))}
    return out | {"require_p": bool(shape.get("require_p_wave", False)), "require_t": bool(shape.get("require_t_wave", False))}


def feature_groups(profile: Mapping[str, Any]) -> tuple[str, ...]:
    """The groups of a profile where none are given."""
    out = ["hrv_time", "hrv_extended"] if (profile.get("hrv") or {}).get("enabled", True) else []
    return (*out, "morphology") if (profile.get("morphology") or {}).get("enabled") else tuple(out)


def _errors(p: Mapping[str, Any]) -> list[str]:
    bad: list[str] = []

    def known(where: str, name: Any, names: Any) -> None:
        if name not in names:
            bad.append(f"{where}: unknown {name!r}")

    phases = [x["id"] if isinstance(x, Mapping) else x for x in p.get("phases") or []]
    bad += [f"phases: {x!r} is there twice" for x in sorted({x for x in phases if phases.count(x) > 1})]
    profiles, cuts, defaults = p.get("quality_profiles") or {}, p.get("segmentation_profiles") or {}, p.get("defaults") or {}
    for name, cut in cuts.items():
        known(f"segmentation_profiles.{name}.mode", cut.get("mode"), SEGMENTATION_MODES)
        if cut.get("mode") == "fixed_windows" and not float(cut.get("window_sec") or 0) > 0:
            bad.append(f"segmentation_profiles.{name}: window_sec must be above 0")
        for part in cut.get("segments") or []:
            if "label" not in part:
                bad.append(f"segmentation_profiles.{name}: a segment has no label")
            if part.get("relative_to", "end") != "end":
                bad.append(f"segmentation_profiles.{name}: relative_to can only be end")
    for name, profile in profiles.items():
        hr = profile.get("expected_hr_bpm") or {}
        if hr and not 0 < float(hr.get("min") or 0) < float(hr.get("max") or 0):
            bad.append(f"quality_profiles.{name}: expected_hr_bpm must have 0 < min < max")
    ids = [r.get("id") for r in p.get("recordings") or []]
    bad += [f"recordings: {x!r} is there twice" for x in sorted({str(x) for x in ids if ids.count(x) > 1})]
    for r in p.get("recordings") or []:
        at = f"recordings.{r.get('id')}"
        if not r.get("file_names"):
            bad.append(f"{at}: no file_names")
        known(f"{at}.mode", r.get("mode", "static"), RECORD_MODES)
        known(f"{at}.quality_profile", r.get("quality_profile", defaults.get("quality_profile")), profiles)
        known(f"{at}.segmentation", r.get("segmentation", defaults.get("segmentation")), cuts)
        for g in r.get("feature_groups") or defaults.get("feature_groups") or []:
            known(f"{at}.feature_groups", g, FEATURE_GROUPS)
        for x in r.get("phases") or []:
            known(f"{at}.phases", x, phases)
    derived = p.get("derived_features") or {}
    sources = derived.get("sources") or {}
    done: set[str] = set()
    for op in derived.get("operations") or []:
        at = f"derived_features.operations.{op.get('id')}"
        if op.get("type") == "pairwise":
            for side in ("left", "right"):
                known(f"{at}.{side}", op.get(side), sources)
        elif op.get("type") == "pairwise_derived":
            for side in ("left_operation", "right_operation"):
                known(f"{at}.{side}", op.get(side), done)
        else:
            bad.append(f"{at}: unknown type {op.get('type')!r}")
        done.add(op.get("id"))
    for op in derived.get("baseline_deviations") or []:
        known(f"derived_features.baseline_deviations.{op.get('id')}.source", op.get("source"), sources)
        known(f"derived_features.baseline_deviations.{op.get('id')}.baseline_profile", op.get("baseline_profile"), derived.get("baseline_profiles") or {})
    return bad


def compile_protocol(p: Mapping[str, Any]) -> Protocol:
    """Check a protocol and resolve its defaults."""
    if bad := _errors(p):
        raise ProtocolError("\n".join(bad))
    defaults, subject, storage = p.get("defaults") or {}, p.get("subject_defaults") or {}, p.get("storage") or {}
    profiles, cuts = p.get("quality_profiles") or {}, p.get("segmentation_profiles") or {}
    phases = tuple(x["id"] if isinstance(x, Mapping) else x for x in p.get("phases") or [])
    fixed = subject.get("sampling_rate_mode", "fixed") == "fixed"
    plans = []
    for r in p.get("recordings") or []:
        of = lambda key, last=None, r=r: r.get(key) if r.get(key) is not None else defaults.get(key, last)
        profile = profiles[of("quality_profile")]
        for phase in r.get("phases") or phases:
            plans.append(
                RecordPlan(
                    recording=r["id"], phase=phase, file_names=tuple(r["file_names"]), mode=r.get("mode", "static"), quality_profile=of("quality_profile"), segmentation_profile=of("segmentation"),
                    segmentation=cuts[of("segmentation")], review_mode=of("review_mode", "auto"), review_scope=of("review_scope", "record"), feature_groups=tuple(of("feature_groups") or feature_groups(profile)),
                    signal_limits=signal_limits(profile), morphology_limits=morphology_limits(profile), sampling_rate=float(subject["sampling_rate_hz"]) if fixed and subject.get("sampling_rate_hz") else None,
                    expected_duration_sec=r.get("expected_duration_sec"), aggregation_role=r.get("aggregation_role"),
                )
            )
    sources = {k: Source(k, v.get("phase"), v.get("recording"), v.get("segment", "full")) for k, v in ((p.get("derived_features") or {}).get("sources") or {}).items()}
    return Protocol(p, java_date_format(storage.get("date_format", "%d.%m.%Y")), phases, tuple(plans), sources)
