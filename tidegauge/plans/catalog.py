"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from tidegauge.plans import q_clean, q_core, q_detect, q_features, q_frames, q_inventory, q_labels, q_queue, q_records, q_residual, q_review, q_score, q_stores, q_text
from tidegauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_clean", "q_core", "q_detect", "q_features", "q_frames", "q_inventory", "q_labels", "q_queue", "q_records", "q_residual", "q_review", "q_score", "q_stores", "q_text"]
