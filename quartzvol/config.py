"""Settings of the engine, in one frozen record."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Fixed values that results depend on.
    variance_scale: float = 10_000.0
    vol_points: float = 100.0
    window: int = 21
    annualisation: int = 252
    calm_below: float = 15.0
    stressed_above: float = 25.0
    regimes: tuple[str, ...] = ("calm", "normal", "stressed")
    lag_months: tuple[int, ...] = (1, 3, 6)
    har_days: tuple[int, ...] = (1, 5, 22)
    har_min_rows: int = 5
    horizon: int = 1
    alpha: float = 0.05
    min_paired: int = 8
    bootstrap_draws: int = 9999
    bootstrap_seed: int = 20260617
    block_exponent: float = 1 / 3
    initial_years: int = 12
    min_dataset_rows: int = 24
    cw_scale: float = 0.5
    nw_factor: float = 4.0
    nw_exponent: float = 2 / 9
    regime_multiplier: int = 2
    low_power: int = 50
    boost_seed: int = 20260623
    grid_depth: tuple[int, ...] = (2, 3, 4)
    grid_rate: tuple[float, ...] = (0.01, 0.05, 0.1)
    grid_trees: tuple[int, ...] = (100, 300, 500)
    grid_min_child: tuple[int, ...] = (1, 5)
    cv_folds: int = 4
    cv_min_train: int = 60
    cost_rate: float = 0.01
    stress_factor: float = 2.0
    spike_level: float = 40.0
    worst_months: int = 3
    months_per_year: int = 12
    acf_lags: tuple[int, ...] = (1, 3, 6, 12)
    gate_trials: int = 100
    gate_z: float = 2.0
    burn_in: int = 200
    crash_windows: tuple[tuple[str, str, str], ...] = (
        ("2008-09_2009-03", "2008-09-01", "2009-03-31"),
        ("2018-02", "2018-02-01", "2018-02-28"),
        ("2020-02_2020-04", "2020-02-01", "2020-04-30"),
    )

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @property
    def features(self) -> tuple[str, ...]:
        return ("vix_level", "cboe_skew", *self.vrp_columns, "realised_skew_21d", "regime")

    @property
    def vrp_columns(self) -> tuple[str, ...]:
        return tuple(f"vrp_h{k}m" for k in self.lag_months)

    @property
    def numeric_features(self) -> tuple[str, ...]:
        return self.features[:-1]

    @property
    def regime_min_rows(self) -> int:
        return self.regime_multiplier * (len(self.numeric_features) + 1)


DEFAULT = EngineConfig()
