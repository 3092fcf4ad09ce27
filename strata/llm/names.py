"""Column names that operators use for their own results."""

from __future__ import annotations

from collections.abc import Iterable


def apart(given: Iterable[str], own: Iterable[str]) -> None:
    """Raise if a given column would have the name of one of the operator's own; other columns do not matter."""
    given = list(given)
    clash = sorted({g for g in given if g in set(own) or given.count(g) > 1})
    if clash:
        raise ValueError(f"rename the columns {clash}: the result has columns of these names")
