"""Column names that clash with none of the user's."""

from __future__ import annotations


def free_name(name: str, *taken: list[str]) -> str:
    """name, with as many _ in front as it takes to clash with none of the taken ones (case does not count)."""
    low = {t.lower() for names in taken for t in names}
    while name.lower() in low:
        name = f"_{name}"
    return name
