"""Run parameters, passed to functions; nothing here is global state."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Significance cut-offs for one, two and three stars.
PROJECTION_CUTOFFS = (1.645, 1.96, 2.576)
LONG_RUN_CUTOFFS = (1.645, 1.960, 2.326)

# Critical value by confidence level.
CRITICAL_VALUES = {0.1: 1.645, 0.05: 1.96, 0.01: 2.576}

# Lag, in periods, of each kind of rate of change, by frequency.
RATE_LAGS = {12: {"m": 1, "q": 3, "y": 12}, 4: {"q": 1, "y": 4}}

LEVELS = (4, 7, 32)


def critical_value(alpha: float) -> float:
    """Two-sided critical value for ``alpha``; other levels are an error."""
    try:
        return CRITICAL_VALUES[float(alpha)]
    except (KeyError, TypeError, ValueError):
        raise ValueError(f"alpha must be one of {sorted(CRITICAL_VALUES)}, got {alpha!r}") from None


def rate_lag(rate: str, freq: int, monthly_q_lag: int = 3) -> int:
    """Periods between the two values of a rate of change.

    ``monthly_q_lag=4`` gives the lag the original study used for quarterly rates on months.
    """
    if freq not in RATE_LAGS:
        raise ValueError("freq must be 4 or 12")
    if rate not in RATE_LAGS[freq]:
        raise ValueError(f"rate must be one of {sorted(RATE_LAGS[freq])} at frequency {freq}")
    return monthly_q_lag if (freq, rate) == (12, "q") else RATE_LAGS[freq][rate]


@dataclass(frozen=True)
class PanelConfig:
    """All choices of one run."""

    start: date = date(2003, 12, 1)
    end: date = date(2024, 12, 1)
    freq: int = 4
    rate: str = "q"
    level: int = 7
    adjusted: bool = True
    centred: bool = False
    weighted: bool = True
    norm_years: tuple[int, ...] = (20, 30, 40)
    extreme_flags: bool = False
    extreme_threshold: float = 0.02
    horizon_years: int = 2
    alpha: float = 0.05
    source: str = "grid"

    def __post_init__(self) -> None:
        if self.freq not in RATE_LAGS:
            raise ValueError("freq must be 4 or 12")
        if self.level not in LEVELS:
            raise ValueError(f"level must be one of {LEVELS}")
        if self.start > self.end:
            raise ValueError("start must not be after end")
        critical_value(self.alpha)
        rate_lag(self.rate, self.freq)

    @property
    def horizon(self) -> int:
        return self.horizon_years * self.freq

    def path(self, root: str, table: str) -> str:
        """Where a table of this run lives; the same choices always give the same path."""
        return "/".join(
            [
                root.rstrip("/"),
                table,
                f"source={self.source}",
                f"freq={self.freq}",
                f"level={self.level}",
                f"adjusted={str(self.adjusted).lower()}",
                f"centred={str(self.centred).lower()}",
            ]
        )
