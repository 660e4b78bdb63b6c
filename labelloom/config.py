"""Thresholds of the scoring, fusion and reward jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FidelityConfig:
    iou_weight: float = 0.60
    label_weight: float = 0.40
    min_iou: float = 0.50
    # weight of one false positive in the precision penalty m / (m + factor * h)
    false_positive_factor: float = 1.0
    # per-detection factor on empty items
    empty_item_penalty: float = 0.5
    # multiply by the geometry audit and require it to pass
    audit: bool = True


@dataclass(frozen=True)
class FusionConfig:
    min_voters: int = 3
    min_object_votes: int = 3
    min_support_ratio: float = 0.80
    accept_confidence: float = 0.90
    min_mean_iou: float = 0.70
    max_box_ratio: float = 0.50
    cluster_iou: float = 0.50
    fallback: bool = False
    fallback_min_reliability: float = 0.05


STRICT = FusionConfig()
SERVICE = FusionConfig(min_voters=2, min_object_votes=1, min_support_ratio=0.50, accept_confidence=0.20, fallback=True)


@dataclass(frozen=True)
class RewardConfig:
    alpha: float = 0.7
    min_positive_items: int = 3
    min_iou: float = 0.75
    min_label_match: float = 1.0
    min_fidelity: float = 0.75
    # adoption gates, not configurable in the service preset
    adoption_min_items: int = 3
    adoption_min_score: float = 0.75
    adoption_min_localization: float = 0.75


STRICT_REWARD = RewardConfig()
SERVICE_REWARD = RewardConfig(min_positive_items=1, min_iou=0.0, min_label_match=0.0, min_fidelity=0.01)


@dataclass(frozen=True)
class IncentiveConfig:
    temperature: float = 1.0
    floor: float = 0.08
    min_score: float = 0.05
    proportional: bool = True
    # fixed values
    lowest_cutoff: float = 0.05
    max_total_floor: float = 0.20
