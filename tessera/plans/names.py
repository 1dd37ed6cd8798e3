"""Names for columns that an operator adds for a while."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores in front as it takes to differ from all of ``taken``; case does not tell names apart."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name
