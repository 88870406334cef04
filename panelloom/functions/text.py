"""Pieces of SQL expressions.

Operators that make many similar columns write them as SQL text: Catalyst sees the same plan, and the driver
sends one string in place of a call per operand.
"""

from __future__ import annotations

from collections.abc import Sequence


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def idents(names: Sequence[str]) -> list[str]:
    return [ident(n) for n in names]


def over(keys: Sequence[str], order: str | None = "period_idx", frame: str = "") -> str:
    """An OVER clause: partition keys, optional order, optional frame."""
    by_order = f" ORDER BY {ident(order)}" if order else ""
    return f"OVER (PARTITION BY {', '.join(idents(keys))}{by_order} {frame})"


def log_of(x: str) -> str:
    """Natural log, NULL for values that are not positive."""
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def rounded_text(x: str, places: int, tolerance: float) -> str:
    return f"floor(({x}) * 1e{places}D + {0.5 + tolerance}D) / 1e{places}D"
