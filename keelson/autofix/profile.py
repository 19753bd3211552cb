"""What is known of a query: its runs, the best hints, and those to try next."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..plans.hints import Hint, parse

LEARNING, OPTIMIZING, CONVERGED = "learning", "optimizing", "converged"
VERSION = 1


@dataclass(frozen=True)
class Attempt:
    hints: tuple[Hint, ...]
    duration_ms: int
    ts: int
    improved: bool = False


@dataclass(frozen=True)
class Profile:
    fingerprint: str
    sample: str = ""
    status: str = LEARNING
    baseline_ms: int | None = None
    best_ms: int | None = None
    best_hints: tuple[Hint, ...] = ()
    pending_hints: tuple[Hint, ...] = ()
    attempts: tuple[Attempt, ...] = ()
    updated_ts: int = 0
    baseline_plan: str | None = None
    current_plan: str | None = None
    recommendations: tuple[str, ...] = field(default=())

    @property
    def saved_percent(self) -> float | None:
        if not self.baseline_ms or self.best_ms is None:
            return None
        return max(0.0, 100.0 * (self.baseline_ms - self.best_ms) / self.baseline_ms)

    def next_hints(self) -> tuple[Hint, ...]:
        """What the next run should use: pending hints, or the best."""
        return self.pending_hints or self.best_hints

    def to_json(self) -> dict:
        text = lambda hints: [h.render() for h in hints]
        optional = {"baselineMs": self.baseline_ms, "bestMs": self.best_ms, "baselinePlan": self.baseline_plan, "currentPlan": self.current_plan}
        return {
            "version": VERSION, "fingerprint": self.fingerprint, "sample": self.sample, "status": self.status, "bestHints": text(self.best_hints), "pendingHints": text(self.pending_hints),
            "attempts": [{"hints": text(a.hints), "durationMs": a.duration_ms, "ts": a.ts, "improved": a.improved} for a in self.attempts],
            "updatedTs": self.updated_ts, "recommendations": list(self.recommendations), **{k: v for k, v in optional.items() if v is not None},
        }

    @classmethod
    def from_json(cls, d: dict) -> Profile:
        if d.get("version") != VERSION:
            raise ValueError(f"unknown profile version {d.get('version')}")
        hints = lambda texts: read_hints(texts or [])
        return cls(
            d["fingerprint"], d.get("sample", ""), d.get("status", LEARNING), d.get("baselineMs"), d.get("bestMs"), hints(d.get("bestHints")), hints(d.get("pendingHints")),
            tuple(Attempt(hints(a["hints"]), a["durationMs"], a["ts"], a.get("improved", False)) for a in d.get("attempts", [])),
            d.get("updatedTs", 0), d.get("baselinePlan"), d.get("currentPlan"), tuple(d.get("recommendations", [])),
        )


def read_hints(texts: Sequence[str]) -> tuple[Hint, ...]:
    return tuple(h for h in map(parse, texts) if h is not None)
