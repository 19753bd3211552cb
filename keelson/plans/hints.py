"""Plan hints: seven kinds, their text, and the DataFrame calls they stand for."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass



@dataclass(frozen=True)
class Hint:
    """A hint; of hints with the same `key` only one can hold."""

    @property
    def key(self) -> str:
        return "partitioning"

    def render(self) -> str:
        raise NotImplementedError

    def dataframe_call(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Broadcast(Hint):
    tables: tuple[str, ...]

    @property
    def key(self) -> str:
        return "broadcast:" + ",".join(self.tables)

    def render(self) -> str:
        return f"BROADCAST({', '.join(self.tables)})"

    def dataframe_call(self) -> str:
        return f"broadcast({', '.join(self.tables)})"


@dataclass(frozen=True)
class Repartition(Hint):
    n: int

    def render(self) -> str:
        return f"REPARTITION({self.n})"

    def dataframe_call(self) -> str:
        return f".repartition({self.n})"


@dataclass(frozen=True)
class Coalesce(Hint):
    n: int

    def render(self) -> str:
        return f"COALESCE({self.n})"

    def dataframe_call(self) -> str:
        return f".coalesce({self.n})"


@dataclass(frozen=True)
class Rebalance(Hint):
    def render(self) -> str:
        return "REBALANCE"

    def dataframe_call(self) -> str:
        return '.hint("rebalance")'


@dataclass(frozen=True)
class _Skew(Hint):
    table: str
    n: int

    @property
    def key(self) -> str:
        return f"skew:{self.table}"


@dataclass(frozen=True)
class SplitBroadcast(_Skew):
    def render(self) -> str:
        return f"SPLIT_BROADCAST({self.table}, {self.n})"

    def dataframe_call(self) -> str:
        return f"split_join(large, {self.table}, keys, how, splits={self.n})"


@dataclass(frozen=True)
class Salt(_Skew):
    def render(self) -> str:
        return f"SALT({self.table}, {self.n})"

    def dataframe_call(self) -> str:
        return f"salted_join(skewed, {self.table}, keys, salt_factor={self.n})"


@dataclass(frozen=True)
class TargetedSalt(_Skew):
    """Salt for some keys only. Plain keys are rendered as they are, others as JSON strings, so any key reads back."""

    keys: tuple[str, ...] = ()

    def render(self) -> str:
        return f"TARGETED_SALT({', '.join([self.table, str(self.n), *(_key_text(k) for k in self.keys)])})"

    def dataframe_call(self) -> str:
        return f"salted_join(skewed, {self.table}, keys, salt_factor={self.n}, hot=[{', '.join(self.keys)}])"


def _key_text(key: str) -> str:
    return key if re.fullmatch(r"[\w.\-]+", key) else json.dumps(key)


def split_arguments(text: str, separators: str = ",") -> list[str]:
    """Split at separators outside parentheses and quotes; parts are stripped, empty ones left out."""
    parts, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote == '"':
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c in separators and depth == 0:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _number(text: str) -> int | None:
    return int(text) if text.isdigit() else None


def parse(text: str) -> Hint | None:
    """A hint from its text; None if it isn't one of ours or lacks arguments."""
    call = re.fullmatch(r"\s*([A-Za-z_]+)\s*(?:\((.*)\))?\s*", text, re.S)
    if not call:
        return None
    word, args = call[1].upper(), split_arguments(call[2] or "", ",|")
    n = _number(args[0]) if args else None
    if word == "REBALANCE":
        return Rebalance()
    if word in ("REPARTITION", "COALESCE"):
        return (Repartition if word == "REPARTITION" else Coalesce)(n) if n is not None and len(args) == 1 else None
    if word == "BROADCAST":
        return Broadcast(tuple(args)) if args else None
    if word in ("SPLIT_BROADCAST", "SALT", "TARGETED_SALT") and len(args) >= 2 and (n := _number(args[1])) is not None:
        if word == "TARGETED_SALT":
            return TargetedSalt(args[0], n, tuple(json.loads(a) if a.startswith('"') else a.strip("'") for a in args[2:]))
        return (SplitBroadcast if word == "SPLIT_BROADCAST" else Salt)(args[0], n) if len(args) == 2 else None
    return None


def dedupe(hints: Iterable[Hint]) -> list[Hint]:
    """One hint per key: the last one, at the place of the first."""
    return list({h.key: h for h in hints}.values())


def render_all(hints: Sequence[Hint]) -> frozenset[str]:
    return frozenset(h.render() for h in hints)
