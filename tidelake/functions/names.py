"""Column names."""

from __future__ import annotations


def normalized(name: str) -> str:
    """Lower case, without outer blanks, inner blanks as underscores."""
    return name.strip().lower().replace(" ", "_")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
