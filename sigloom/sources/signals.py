"""Recordings: found by path, read whole (a file is a row, so samples keep their order), turned into features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.plans.protocol import Protocol
from sigloom.ship import ship
from sigloom.signal import hrv, morphology, record
from sigloom.sources.store import DayStore

PATH = r"(\d{2}\.\d{2}\.\d{4})/([^/]+)/([^/]+)$"


def _schema() -> list[tuple[str, str]]:
    text = "string"
    out = [("record_type", text), ("phase", text), ("date", text), ("segment_label", text), ("window_idx", "int"), ("start_sec", "double"), ("end_sec", "double"), ("duration_sec", "double")]
    out += [("hrv_validated", "boolean"), ("morphology_validated", "boolean")]
    out += [("hrv_time__n_rr", "bigint"), *[(f"hrv_time__{n}", "double") for n in hrv.TIME_NAMES], *[(f"hrv_freq__{n}", "double") for n in hrv.FREQ_NAMES]]
    out += [(f"hrv_nonlinear__{n}", "double") for n in ("SD1_ms", "SD2_ms", "SD1_SD2_ratio", "Ellipse_area", "ApproxEntropy", "SampleEntropy", "ShannonEntropy", "DFA_alpha1", "DFA_alpha2", "FractalDimension")]
    special = {"QRS_polarity_raw": text, "P_polarity": text, "T_polarity": text, "QRS_inverted_for_analysis": "boolean", "P_present": "boolean", "T_present": "boolean"}
    for group, names in (("qrs", morphology.QRS_NAMES), ("p", morphology.P_NAMES), ("t", morphology.T_NAMES)):
        out += [(f"morph_{group}__{n}", special.get(n, "double")) for n in names]
    out += [(n, text) for n in ("aggregation_role", "processing_mode", "processing_profile", "segmentation_profile", "quality_profile", "review_source", "signal_review_status", "hrv_review_status", "hrv_review_source", "hrv_qc_reasons")]
    out += [("hrv_qc_passed", "boolean"), ("morphology_review_status", text), ("morphology_error", text), ("morphology_qc_reasons", text), ("morphology_qc_passed", "boolean")]
    numbers = [("clipping_ratio", "double"), ("rr_phys_bad_ratio", "double"), ("n_rpeaks", "bigint"), ("n_beats_extracted", "bigint"), ("n_beats_good", "bigint"), ("corr_min", "double"), ("corr_median", "double"), ("corr_max", "double")]
    out += [("sampling_rate", "double"), ("morph_corr_threshold", "double"), *numbers]
    out += [("meta__sampling_rate", "double"), ("meta__segment_duration_sec", "double"), ("meta__analyzed_duration_sec", "double"), ("meta__rpeaks_source", text), ("meta__hrv_validated", "boolean"), ("meta__morphology_validated", "boolean")]
    return out + [(f"qc__{n}", k) for n, k in numbers]


#: The feature table: names, types and order are fixed, whatever the data hold.
FEATURE_FIELDS = _schema()
FEATURE_DDL = ", ".join(f"`{n}` {k}" for n, k in FEATURE_FIELDS)


def find_recordings(spark: SparkSession, root: str) -> DataFrame:
    """(date, phase, file, path, content): all files under root/<dd.MM.yyyy>/<phase>/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = [F.regexp_extract("path", PATH, k) for k in (1, 2, 3)]
    return files.select(part[0].alias("date"), part[1].alias("phase"), part[2].alias("file"), "path", "content").where("date <> ''")


def grid(spark: SparkSession, protocol: Protocol) -> DataFrame:
    """(phase, recording, file, priority): the files that the protocol asks for. As small as the protocol."""
    rows = [(p.phase, p.recording, f, k) for p in protocol.plans for k, f in enumerate(p.file_names)]
    return spark.createDataFrame(rows, "phase string, recording string, file string, priority int")


def planned(files: DataFrame, protocol: Protocol) -> DataFrame:
    """Of each date, phase and recording the file with the best priority."""
    asked = F.broadcast(grid(files.sparkSession, protocol))  # the protocol's own size
    found = files.join(asked, ["phase", "file"])
    best = found.groupBy("date", "phase", "recording").agg(F.min_by("path", "priority").alias("path"))
    return found.join(best, ["date", "phase", "recording", "path"]).drop("priority")


def missing(files: DataFrame, protocol: Protocol) -> DataFrame:
    """(date, phase, recording) that the protocol asks for and no file has."""
    spark = files.sparkSession
    want = files.select("date").distinct().crossJoin(F.broadcast(grid(spark, protocol).select("phase", "recording").distinct()))
    have = files.join(F.broadcast(grid(spark, protocol)), ["phase", "file"]).select("date", "phase", "recording")
    return want.join(have, ["date", "phase", "recording"], "left_anti")


def _number(line: str) -> float:
    try:
        return float(line.replace(";", ",").split(",")[0])
    except ValueError:
        return np.nan


def parse_signal(content: bytes) -> np.ndarray | None:
    """The first column of a CSV file without a header; None if a line of it is no number, or it has none."""
    x = np.array([_number(line) for line in content.decode("utf-8-sig", "replace").splitlines() if line.strip()], float)
    return x if len(x) and np.isfinite(x).all() else None


def _rate(signal: np.ndarray, plan: dict) -> float | None:
    """Samples a second: as the plan has it, else by the duration that it expects; None if it has neither."""
    seconds = float(plan["expected_duration_sec"] or 0)
    return plan["sampling_rate"] or (len(signal) / seconds if seconds > 0 else None)


_REVIEW = ("signal_review_status", "hrv_review_status", "hrv_qc_passed", "morphology_review_status", "morphology_qc_passed", "rpeaks", "rpeaks_no_edge")


def with_reviews(files: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """planned() files with `_reviews`: what tables.decisions() has of each, as an array with an entry a segment."""
    if reviews is None:
        return files.withColumn("_reviews", F.lit(None).cast("array<struct<segment_label:string>>"))
    per = reviews.groupBy("date", "phase", F.col("record_type").alias("recording")).agg(F.sort_array(F.collect_list(F.struct("segment_label", *_REVIEW))).alias("_reviews"))
    return files.join(per, ["date", "phase", "recording"], "left")


def extract_features(files: DataFrame, protocol: Protocol, reviews: DataFrame | None = None) -> DataFrame:
    """The feature table of planned() files. Recordings are independent; they are small and cost much each, so they are
    dealt to a set number of tasks by path. A file that is no signal, or whose rate nothing tells, gives no row.

    reviews: what reviewers said (tables.decisions()); see record.process().
    """
    ship(files.sparkSession)
    plans = {(p.phase, p.recording): p.as_dict() for p in protocol.plans}
    names = [n for n, _ in FEATURE_FIELDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                plan = plans[f.phase, f.recording]
                signal = parse_signal(f.content)
                fs = _rate(signal, plan) if signal is not None else None
                if fs is None:
                    continue
                said = {r["segment_label"]: r for r in (f.reviews if f.reviews is not None else [])}
                more = {"date": f.date, "phase": f.phase, "record_type": f.recording, "processing_mode": plan["mode"], "processing_profile": plan["quality_profile"], "quality_profile": plan["quality_profile"]}
                more |= {"segmentation_profile": plan["segmentation_profile"], "aggregation_role": plan["aggregation_role"]}
                rows += [r | more for r in record.process(signal, fs, plan, said)]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names, dtype=object)

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    given = files if "_reviews" in files.columns else with_reviews(files, reviews)
    return given.select("date", "phase", "recording", "content", "path", F.col("_reviews").alias("reviews")).repartition(tasks, "path").mapInPandas(run, FEATURE_DDL)


def unreadable(files: DataFrame, protocol: Protocol) -> DataFrame:
    """(date, phase, recording, path, reason) of the planned() files that give no row for what they hold."""
    ship(files.sparkSession)
    plans = {(p.phase, p.recording): p.as_dict() for p in protocol.plans}

    def reason(f) -> str | None:
        signal = parse_signal(f.content)
        return "not_numeric" if signal is None else None if _rate(signal, plans[f.phase, f.recording]) else "no_sampling_rate"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            why = [reason(f) for f in batch.itertuples(index=False)]
            out = batch[["date", "phase", "recording", "path"]].assign(reason=why)
            yield out[out.reason.notna()]

    return files.select("date", "phase", "recording", "path", "content").mapInPandas(run, "date string, phase string, recording string, path string, reason string")


def stored_features(files: DataFrame, protocol: Protocol, path: str, reviews: DataFrame | None = None) -> DataFrame:
    """The feature table of planned() files, taken from the store at path where it has them.

    A stored recording counts only if it was processed under the same plan and the same reviews; only the others are
    processed and added, all in one commit (sources.store): a run that is killed leaves none of its recordings, and one that
    meets another run over the same days gets a Conflict.
    """
    spark = files.sparkSession
    key = ["date", "phase", "record_type", "plan_hash"]
    hashes = spark.createDataFrame([(p.phase, p.recording, p.hash()) for p in protocol.plans], "phase string, recording string, plan_hash string")
    asked = with_reviews(files.join(F.broadcast(hashes), ["phase", "recording"]), reviews)  # a row a plan of the protocol
    said = F.sha2(F.to_json("_reviews"), 256)
    asked = asked.withColumn("plan_hash", F.when(F.col("_reviews").isNull(), F.col("plan_hash")).otherwise(F.concat_ws("/", "plan_hash", said)))
    want = asked.select("date", "phase", F.col("recording").alias("record_type"), "plan_hash")
    store = DayStore(spark, path)
    known = store.commits()
    schema = f"{FEATURE_DDL}, plan_hash string"
    have = store.read(schema, commits=known)
    todo = asked
    if have is not None:
        todo = asked.join(have.select(*key).distinct().withColumnRenamed("record_type", "recording"), ["date", "phase", "recording", "plan_hash"], "left_anti")
    made = extract_features(todo, protocol)
    named = want.distinct()  # one a recording
    store.write(made.join(named, ["date", "phase", "record_type"]).select(*[n for n, _ in FEATURE_FIELDS], "plan_hash"), add=True, known=known)
    stored = store.read(schema)
    if stored is None:
        stored = spark.createDataFrame([], schema)
    return stored.select(*[n for n, _ in FEATURE_FIELDS], "plan_hash").join(named, key, "left_semi").drop("plan_hash")
