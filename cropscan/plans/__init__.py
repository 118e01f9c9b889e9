from .increments import damaged_scenes, score_into, stored_predictions, stored_report
from .ingestion import ingested, report_from_files, scene_files
from .scoring import (
    StandardModel, harvest_report, observed_scores, prepared, scored, scored_in_place, train_scaled,
    train_standardised, trained_report,
)

__all__ = [
    "StandardModel", "damaged_scenes", "harvest_report", "ingested", "observed_scores", "prepared",
    "report_from_files", "scene_files", "score_into", "scored", "scored_in_place",
    "stored_predictions", "stored_report", "train_scaled", "train_standardised", "trained_report",
]
