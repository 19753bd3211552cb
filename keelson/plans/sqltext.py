"""Hints in SQL text, and fingerprints of it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

from .hints import Hint, Salt, SplitBroadcast, TargetedSalt, dedupe, parse, split_arguments

#: What stands for itself in SQL: strings, quoted names, comments; then words, and single characters.
TOKEN = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", re.S)
HINT_BLOCK = re.compile(r"\s*/\*\+(.*?)\*/", re.S)


def tokens(sql: str) -> Iterator[tuple[int, str]]:
    """Start and text of each token."""
    for m in TOKEN.finditer(sql):
        yield m.start(), m[0]


def outer_select(sql: str) -> int | None:
    """Where the first SELECT outside parentheses, strings and comments ends."""
    depth = 0
    for at, token in tokens(sql):
        if token in "()":
            depth += 1 if token == "(" else -1
        elif depth == 0 and token.upper() == "SELECT":
            return at + len(token)
    return None


def rewrite(sql: str, hints: Sequence[Hint]) -> str:
    """Put hints after the outer SELECT; they replace those of the same key that stand there."""
    hints = dedupe(hints)
    at = outer_select(sql) if sql and hints else None
    if at is None:
        return sql
    head, tail, present = sql[:at], sql[at:], []
    if block := HINT_BLOCK.match(tail):
        tail = tail[block.end() :]
        keys = {h.key for h in hints}
        present = [t for t in split_arguments(block[1]) if (h := parse(t)) is None or h.key not in keys]
    merged = dict.fromkeys([*present, *(h.render() for h in hints)])
    return f"{head} /*+ {', '.join(merged)} */{tail}"


def extract(sql: str) -> tuple[str, list[Hint]]:
    """The text without our own three hints (split broadcast and salts), and those; Spark's own hints stay."""
    at = outer_select(sql)
    block = HINT_BLOCK.match(sql[at:]) if at is not None else None
    if block is None:
        return sql, []
    ours, others = [], []
    for text in split_arguments(block[1]):
        hint = parse(text)
        if isinstance(hint, (SplitBroadcast, Salt, TargetedSalt)):
            ours.append(hint)
        else:
            others.append(text)
    kept = f" /*+ {', '.join(others)} */" if others else ""
    return sql[:at] + kept + sql[at + block.end() :], ours


def normalized(sql: str) -> str:
    """The query without comments, literals, case and spacing."""
    out = []
    for _, token in tokens(sql or ""):
        if token.startswith(("--", "/*")) or token.isspace():
            out.append(" ")
        elif token[0] == "'":
            out.append("?")
        else:
            out.append(token.lower())
    text = re.sub(r"(?<![\w.`])\d+(?:\.\d+)?\b", "?", "".join(out))
    return re.sub(r"\s+", " ", text).strip().removesuffix(";").strip()


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def fingerprint(sql: str) -> str:
    """32 hex digits, equal for queries that differ in literals, comments, case and spacing only."""
    return short_hash(normalized(sql))
