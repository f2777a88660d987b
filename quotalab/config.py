"""All parameters of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

# fixed value: the seed of the data model
SEED = 20260501


@dataclass(frozen=True)
class Settings:
    """Thresholds and weights of layers 1 to 4."""

    # fixed values: statuses, cuts and weights of the data model
    pending: tuple[str, ...] = ("Pendente", "Aprovado", "Aguardando Gerente")
    finished: tuple[str, ...] = ("Finalizado", "Recebimento Confirmado")
    rejected: str = "Rejeitado"
    cv_regular: float = 0.30
    cv_moderate: float = 0.70
    cv_upper: float = 1.20
    k_steps: tuple[float, float, float, float] = (0.5, 1.0, 1.25, 1.5)
    least_mean: float = 0.5
    low_rotation_mean: float = 1.0
    extra_share: float = 0.40
    weights: tuple[float, ...] = (0.10, 0.20, 0.30, 0.40)  # oldest month first
    months: tuple[str, ...] = ("2026-01", "2026-02", "2026-03", "2026-04")
    shortage_cost: float = 1.0
    excess_cost: float = 0.3
    replicas: int = 5000
    grid: int = 200
    seed: int = SEED


@dataclass(frozen=True)
class ForecastSettings:
    """Gate, features, models and drift of layers 5 and 6."""

    # fixed values: cuts, windows and penalties of the data model
    preliminary: int = 8
    operational: int = 18
    lags: int = 4
    window: int = 3
    alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)
    least_training: int = 3
    drift_window: int = 3
    drift_z: float = 2.0
    percentiles: tuple[float, float] = (0.05, 0.95)
    draws: int = 500
    seed: int = SEED
