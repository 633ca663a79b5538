"""Option values from text, with the bounds that each kind has."""

from __future__ import annotations

import math
import re


def positive(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) == 0:
        raise ValueError(f"{text!r} is no positive whole number")
    return int(text)


def _between(text: str, most: float, what: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not 0 <= value <= most:
        raise ValueError(f"{text!r} is no {what}: 0 to {most:g}")
    return value


def fraction(text: str) -> float:
    return _between(text, 1, "fraction")


def percent(text: str) -> float:
    return _between(text, 100, "percentage")


def quality(text: str) -> float:
    return _between(text, 93, "quality")


def byte_size(text: str) -> int | None:
    """Bytes of a number with b, k, m or g (powers of 1024; kb and kib, too); None for auto."""
    if text.strip().lower() == "auto":
        return None
    m = re.fullmatch(r"([0-9]+)(?:b|([kmg])(?:i?b)?)?", text.strip().lower())
    if not m or int(m[1]) == 0:
        raise ValueError(f"{text!r} is no byte size")
    return int(m[1]) << {None: 0, "k": 10, "m": 20, "g": 30}[m[2]]
