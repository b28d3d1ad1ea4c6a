"""Names for columns that an operator adds to tables whose own columns may have any name."""

from __future__ import annotations


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores at its end until no column of `taken` is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
