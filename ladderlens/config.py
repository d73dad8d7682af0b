"""Thresholds, horizons and seeds, all in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the analyses; every one can be set by the caller."""

    daily_horizons: tuple[int, ...] = (1, 7, 28)
    weekly_horizons: tuple[int, ...] = (1, 2, 4)
    ranks_keep: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
    anchor_days: tuple[int, ...] = (1, 8, 15, 22)
    quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)
    exponent_horizons: tuple[int, ...] = (1, 2, 4, 8, 28)
    exponent_bands: tuple[int, ...] = (50, 200)
    daily_pair_ranks: int = 900
    weekly_pair_ranks: int = 10_000
    window_lows: tuple[int, ...] = (100, 500, 1000)
    window_high: int = 10_000
    min_rows_per_rank: int = 10
    min_rows_per_day: int = 1850
    min_rows_bad_day: int = 1800
    min_rows_per_week: int = 12_000
    k_head: int = 1000
    micro_share: float = 1e-8
    winsor_q: float = 0.99
    k0: int = 500
    trim: float = 0.10
    protect: int = 1000
    lambda_share: float = 1.0
    uplift_grid: tuple[int, ...] = (50, 100, 200, 500, 1000, 2500, 5000)
    uplift_least: int = 50
    capture_windows: tuple[int, ...] = (4, 13, 26, 52)
    capture_sizes: tuple[int, ...] = (1000, 2000, 5000)
    bootstrap_replicates: int = 200
    bootstrap_block: int = 8
    simulation_paths: int = 100
    simulation_days: int = 365
    share_tolerance: float = 0.05
    seed: int = 42


#: Sizes that suit the small test tables.
SMALL = EngineConfig(exponent_bands=(20, 60), daily_pair_ranks=90, weekly_pair_ranks=20, window_lows=(5, 10, 20), window_high=60, min_rows_per_day=135, min_rows_bad_day=130, min_rows_per_week=75, k_head=50, k0=25, protect=60, uplift_grid=(5, 10, 20, 50, 100), uplift_least=5, capture_windows=(4, 13, 26), capture_sizes=(10, 20, 50))
