"""Typed configuration: feature groups, thresholds, search spaces."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureGroup:
    """One group of the prepare step: clip every column, then cut if bins given."""
    name: str
    columns: tuple[str, ...]
    lower_bound: float | None = None
    upper_bound: float | None = None
    bins: tuple[float, ...] | None = None


# The account-table feature config the pipeline is defined by
# (group -> columns, right-closed bin edges, clip bounds).  They must stay equal
# to the original configuration for identical bins and labels.
CREDIT_FEATURE_GROUPS: tuple[FeatureGroup, ...] = (
    FeatureGroup("pay_x", ("PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"), -2, 4, None),
    FeatureGroup("bill_amt", ("BILL_AMT1", "BILL_AMT2", "BILL_AMT3", "BILL_AMT4", "BILL_AMT5", "BILL_AMT6"),
                 -350000, 2000000, (-350000, -1, 0, 25000, 75000, 200000, 2000000)),
    FeatureGroup("pay_amt", ("PAY_AMT1", "PAY_AMT2", "PAY_AMT3", "PAY_AMT4", "PAY_AMT5", "PAY_AMT6"),
                 -1, 2000000, (-1, 0, 25000, 50000, 100000, 2000000)),
    FeatureGroup("Age", ("AGE",), 20, 80, (20, 25, 30, 35, 40, 50, 60, 80)),
    FeatureGroup("limit", ("LIMIT_BAL",), 5000, 1100000,
                 (5000, 50000, 100000, 150000, 200000, 300000, 400000, 500000, 1100000)),
)

# Thresholds of the three selection steps (eval metric, allowed
# train-test gap, minimum test accuracy) and the split seed.
TRAINER_GATE = ("roc_auc", 0.6, 0.7)
EVALUATION_GATE = ("accuracy", 0.05, 0.805)
PUSHER_GATE = ("accuracy", 0.02, 0.805)
SPLIT_SEED = 1961
TEST_SHARE = 0.2


@dataclass(frozen=True)
class DriftConfig:
    """Drift thresholds (our explicit choice; the original delegates them)."""
    numeric_threshold: float = 0.1      # normed Wasserstein distance
    categorical_threshold: float = 0.1  # Jensen-Shannon distance
    dataset_share: float = 0.5          # dataset drifts when this share of columns drift
    prefix_buckets: int | None = None   # running-sum buckets; None: by the number of distinct values


@dataclass(frozen=True)
class MetricConfig:
    threshold: float = 0.5   # predicted class 1 when P(1) >= threshold
    log_loss_eps: float = 1e-15


@dataclass
class SearchSpace:
    """Uniform/log-uniform/choice ranges for a seeded random parameter search."""
    family: str
    ranges: dict = field(default_factory=dict)
