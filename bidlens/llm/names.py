"""Column names that an input does not have."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added until none is a column, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(columns: Iterable[str], *names: str) -> dict[str, str]:
    """A new name for each column whose name, whatever its case, is one of these."""
    columns = list(columns)
    clash = [c for c in columns if c.lower() in names]
    return dict(zip(clash, unused([*columns, *names], *clash)))
