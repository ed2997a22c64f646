"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SsaParams:
    window: int = 24
    rank: int = 5


@dataclass(frozen=True)
class ForecastParams:
    lags_v: int = 24
    lags_exo: int = 12
    alpha: float = 0.2
    l1_ratio: float = 0.1
    max_iter: int = 10_000
    tol: float = 1e-4
    test_size: float = 0.4
    scaler: str = "robust"  # or "standard"
    poly_degree: int = 2  # 1 switches the expansion off
    poly_v: int = 6
    poly_p: int = 4
    poly_t: int = 4
    max_train_samples: int = 0  # 0 means no cap; only for the split by position
    min_samples: int = 10
    split: str = "position"  # or "time": the cut falls inside every client

    @property
    def maxlag(self) -> int:
        return max(self.lags_v, self.lags_exo)


@dataclass(frozen=True)
class AnomalyParams:
    roll_window: int = 12
    n_estimators: int = 300
    max_samples: int = 256
    contamination: float = 0.03
    fusion: str = "or"  # or "and"
    z_threshold: float = 1e9


@dataclass(frozen=True)
class SeverityParams:
    mild: float = 0.70
    medium: float = 0.85
    critical: float = 0.95

    def __post_init__(self) -> None:
        if not self.mild < self.medium < self.critical:
            raise ValueError("severity thresholds must rise: mild < medium < critical")


@dataclass(frozen=True)
class SegmentParams:
    eps: float = 0.3425
    min_samples: int = 3


@dataclass(frozen=True)
class JobParams:
    seed: int = 69069
    ssa: SsaParams = field(default_factory=SsaParams)
    forecast: ForecastParams = field(default_factory=ForecastParams)
    anomaly: AnomalyParams = field(default_factory=AnomalyParams)
    severity: SeverityParams = field(default_factory=SeverityParams)
    segment: SegmentParams = field(default_factory=SegmentParams)
