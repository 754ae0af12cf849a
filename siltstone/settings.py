"""Settings with their defaults: paths and sizes that callers pass on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    raw: str = "data/raw"
    processed: str = "data/processed"
    reports: str = "reports"
    cache: str = "data/cache"
    chunk_rows: int = 1000

    def __post_init__(self) -> None:
        if self.chunk_rows <= 0:
            raise ValueError("chunk_rows must be over 0")
