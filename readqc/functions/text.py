"""Numbers as people read them."""

from __future__ import annotations

import html


def number(n: int) -> str:
    return f"{n:,}"


def bases(n: int) -> str:
    for unit, size in (("Gb", 10**9), ("Mb", 10**6), ("Kb", 10**3)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{n} bp"


def duration(seconds: float) -> str:
    whole = int(seconds)
    return f"{whole // 3600:02}:{whole % 3600 // 60:02}:{whole % 60:02}"


def escape(text: str) -> str:
    return html.escape(text, quote=True)


def percent_delta(before: float, after: float) -> str:
    """Signed difference; none worth showing below 0.01."""
    d = after - before
    return "±0" if abs(d) < 0.01 else f"{d:+.2f}"


def delta(before: float, after: float, unit: str = "") -> str:
    return f"{after - before:+.1f}{unit}"
