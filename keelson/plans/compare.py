"""Two plans side by side."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

#: Longer plans are shown without alignment. Fixed value.
LONGEST = 1200
_NOISE = ((re.compile(r"\*\(\d+\)\s*"), ""), (re.compile(r"plan_id=\d+"), "plan_id"), (re.compile(r"#\d+L?"), "#"), (re.compile(r"\s+"), " "))


def canonical(line: str) -> str:
    """A line without codegen stage numbers, ids and spacing."""
    for pattern, by in _NOISE:
        line = pattern.sub(by, line)
    return line.strip()


def compare(before: str, after: str) -> list[tuple[str, str | None, str | None]] | None:
    """Rows (S same, C changed, D only before, A only after; line before; line after); None for very long plans."""
    a, b = before.splitlines(), after.splitlines()
    if max(len(a), len(b)) > LONGEST:
        return None
    out: list[tuple[str, str | None, str | None]] = []
    for tag, i, j, k, n in SequenceMatcher(None, [canonical(x) for x in a], [canonical(x) for x in b], autojunk=False).get_opcodes():
        left, right = a[i:j], b[k:n]
        if tag == "equal":
            out += [("S", x, y) for x, y in zip(left, right, strict=True)]
            continue
        paired = min(len(left), len(right))
        out += [("C", x, y) for x, y in zip(left[:paired], right[:paired], strict=True)]
        out += [("D", x, None) for x in left[paired:]] + [("A", None, y) for y in right[paired:]]
    return out
