"""Sizes and durations for people."""

from __future__ import annotations


def format_bytes(n: float) -> str:
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{int(n)} B"


def format_duration(ms: float) -> str:
    for unit, size in (("h", 3_600_000), ("min", 60_000), ("s", 1000)):
        if ms >= size:
            return f"{ms / size:.2f} {unit}"
    return f"{int(ms)} ms"
