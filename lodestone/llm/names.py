"""Names for columns beside a caller's own."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as keep it from clashing; case does not count, as in Spark."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name
