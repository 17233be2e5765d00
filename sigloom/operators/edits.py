"""Logs of reviewers' edits, replayed over recordings side by side: the review records that a session would write."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.ship import ship
from sigloom.signal import edits as e
from sigloom.sources.tables import REVIEW_SCHEMA

META = ("date", "phase", "record_type", "segment_label")


def replayed(recordings: DataFrame, edits: DataFrame, morphology_limits: Mapping[str, Any], *, keys: tuple[str, ...] = META, corr_threshold: float = 0.8, trim_sec: float = 0.0, guard_sec: float = 0.5) -> DataFrame:
    """recordings (keys, signal, fs) and edits (keys, part: signal or morphology, seq, edit) -> records of reviews, as
    tables.write_reviews() writes and tables.decisions() reads them.

    Edits count in the order of seq (then of their text). A recording without edits has no review; edits of a recording that
    is not there are left out. Shapes are reviewed on what the review of peaks left, if it was accepted.
    """
    ship(recordings.sparkSession)
    order = F.sort_array(F.collect_list(F.when(F.col("part") == "signal", F.struct("seq", "edit")))), F.sort_array(F.collect_list(F.when(F.col("part") == "morphology", F.struct("seq", "edit"))))
    logs = edits.groupBy(*keys).agg(*[F.transform(o, lambda x: x["edit"]).alias(n) for o, n in zip(order, ("_signal", "_shape"), strict=True)])
    rows = recordings.join(logs, list(keys)).select(*[F.col(k).cast("string").alias(k) for k in keys], "signal", F.col("fs").cast("double").alias("fs"), "_signal", "_shape")

    def one(r: Mapping[str, Any]) -> dict[str, Any]:
        signal = np.asarray(r["signal"] if r["signal"] is not None else [], float)
        out: dict[str, Any] = {"signal_review": None, "hrv_review": None, "morphology_review": None, "meta": {k: r[k] for k in keys} | {"sampling_rate": r["fs"]}}
        try:
            state = e.SignalEdits(signal, r["fs"], trim_sec, guard_sec)
        except e.Refused:
            return out
        out["signal_review"] = e.replay(state, list(r["_signal"]))
        if len(r["_shape"]) and state.status != "skipped":
            out["morphology_review"] = e.replay(e.ShapeEdits(state.raw, state.at, r["fs"], corr_threshold, morphology_limits), list(r["_shape"]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(r) for r in batch.to_dict("records")], columns=["signal_review", "hrv_review", "morphology_review", "meta"])

    return rows.mapInPandas(run, REVIEW_SCHEMA)
