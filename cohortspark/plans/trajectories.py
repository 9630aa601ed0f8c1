"""Cluster labels to outcome trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortspark.operators import survival as sv
from cohortspark.runtime import cut


def trajectories(features: DataFrame, labels: DataFrame, key: str, time: str, event: str, competing: str | None = None,
                 landmark: int = 30, reference: int = 0) -> dict[str, DataFrame]:
    """Incidence curves, tests, hazards and early/late/overall summaries from one survival frame."""
    frame = cut(sv.survival_frame(features, labels, key, time, event, competing))
    return {
        "cumulative_incidence": sv.cumulative_incidence(frame),
        "gray": sv.logrank_k_sample(frame),
        "cox": sv.cause_specific_hazards(frame, reference),
        "early": sv.group_summary(sv.landmark_early(frame, landmark)),
        "late": sv.group_summary(sv.landmark_late(frame, landmark)),
        "mortality": sv.cluster_mortality(frame, landmark),
        "overall": sv.event_rate(frame),
    }
