"""Words: maximal runs of letters and digits of any script, lower-cased."""

from __future__ import annotations

import re

_RUN = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """Words in order; none of a null text."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a mark that is no letter
        return [w.lower() for w in _RUN(text)]
    return _RUN(text.lower())
