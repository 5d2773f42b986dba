"""Settings of a run; the defaults are the engine's documented ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``eps``, ``min_samples``: density clustering, in degrees; ``pixel``: heat map cell in degrees;
    ``min_members``: smallest cluster kept; ``valid_share``: share of collects for the validity
    threshold, which is reported and only applied if ``apply_valid_share``."""

    eps: float = 0.006
    min_samples: int = 4
    pixel: float = 0.006
    min_members: int = 5
    valid_share: float = 0.01
    apply_valid_share: bool = False
    signal_type: str = "flare"
