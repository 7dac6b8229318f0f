"""Calibration: a new baseline and threshold for frozen models, behind gates."""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions.features import from_map
from reqlens.models.bundle import check_contract, score
from reqlens.operators import baseline as bl
from reqlens.operators import eventlog, metrics
from reqlens.session import cut
from reqlens.sources import artefacts


class GateFailed(ValueError):
    def __init__(self, gates: list):
        self.gates = gates
        names = ", ".join(f"{g.gate} ({g.value:.4g} against {g.threshold:.4g})" for g in gates)
        super().__init__(f"calibration refused: {names}")


@dataclass
class CalibrationReport:
    version: str
    threshold: float
    would_block: float
    frames: dict[str, DataFrame]
    notes: list[str]


def with_window(df: DataFrame) -> DataFrame:
    """`win` from the logged count, else from the older log-scaled feature."""
    logged = F.try_element_at(F.col("features"), F.lit("win_log_count"))
    return df.withColumns({
        "win": F.coalesce(F.col("window_count").cast("double"), F.expm1(logged), F.lit(0.0)),
        "burst_count": F.coalesce("burst_count", F.lit(0)),
        "template": F.coalesce("template", F.lit("/"))})


def calibrate(log: DataFrame, store: artefacts.Store, settings: Settings = DEFAULTS,
              now: float | None = None, minutes: float | None = None,
              force: bool = False) -> CalibrationReport:
    spark = log.sparkSession
    window = eventlog.require_features(
        eventlog.since(log, time.time() if now is None else now, minutes))
    dirt = bl.contamination(window).first()
    early = bl.calibration_gates(spark.createDataFrame(
        [(dirt.n, float(dirt.fraction), 1.0, 0.0, 1.0)],
        "n bigint, fraction double, threshold double, median double, previous double"),
        settings, force).filter("gate IN ('samples', 'contamination') AND NOT passed").collect()
    if early:
        raise GateFailed(early)

    models = artefacts.load_models(spark, store, settings=settings)
    check_contract(models.feature_names)
    clean = cut(with_window(eventlog.clean_rows(window)))
    fresh = bl.build_baseline(clean, settings)
    rows = bl.apply_baseline(from_map(clean), fresh)
    scored = cut(score(rows, models, settings, window="win").select("p"))

    picked = metrics.calibrated_threshold(scored, settings.target_fpr).first()
    spread = metrics.score_distribution(scored)
    facts = scored.agg(
        F.lit(dirt.n).alias("n"), F.lit(float(dirt.fraction)).alias("fraction"),
        F.lit(picked.threshold).alias("threshold"),
        F.max(spread.select("p50").scalar()).alias("median"),
        F.lit(models.threshold).alias("previous"))
    gates = cut(bl.calibration_gates(facts, settings, force))
    failed = gates.filter(~F.col("passed")).collect()
    if failed:
        raise GateFailed(failed)

    old = models.baseline
    rates = {k: spark.createDataFrame([(b.rate_mean, b.rate_std)], "mean double, std double")
             for k, b in (("old", old), ("new", fresh))}
    drift = bl.rate_drift(rates["old"], rates["new"])
    full = metrics.saturation(scored, F.lit(picked.would_block), settings.target_fpr)
    notes = []
    if full.first().unreachable:
        notes.append("the false-positive budget cannot be reached on this window")
    if drift.first().large:
        notes.append("large rate drift; check that the window is representative")

    version = artefacts.new_version()
    artefacts.save_baseline(spark, store, version, fresh)
    artefacts.save_decision(spark, store, version, {
        **models.decision, "threshold": picked.threshold,
        "calibrated_at": time.strftime("%Y-%m-%dT%H:%M:%S"),
        "calibration_samples": clean.count(), "calibration_target_fpr": settings.target_fpr,
        "calibration_observed_fpr": round(picked.would_block, 4)})
    artefacts.publish(spark, store, version)
    frames = {"gates": gates, "distribution": spread, "saturation": full, "drift": drift,
              "shared": bl.shared_endpoints(old.endpoints, fresh.endpoints),
              "new": bl.new_endpoints(old.endpoints, fresh.endpoints)}
    return CalibrationReport(version, picked.threshold, picked.would_block, frames, notes)
