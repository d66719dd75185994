"""Settings: paths, model names, seed and the engine's size limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    data_path: str = "data"
    models_path: str = "models"
    reports_path: str = "reports"
    encoder_name: str = "token-hash-384"
    seed: int = 42
    # Years in text are read relative to this one.
    reference_year: int = 2026
    recent_window_years: int = 4
    # A query side is shipped to every task only within both limits;
    # beyond them the block top-k falls back to shuffled tiles.
    max_query_rows: int = 512
    max_query_bytes: int = 32 << 20
    tile_rows: int = 50_000
    pool: int = 50


settings = Settings()
