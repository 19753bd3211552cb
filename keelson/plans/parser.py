"""Facts from the text of a physical plan.

Works on tree and on formatted text. An operator that has a number counts once, however often it is printed, and of an
adaptive plan only the final part counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NODE = re.compile(r"^[\s:+\-|!*]*(?:\*?\s*\((\d+)\)\s*)?(?P<body>[A-Z(].*)$")
JOINS, CARTESIANS = ("SortMergeJoin", "ShuffledHashJoin"), ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInPandas", "MapInArrow", "AggregateInPandas", "ArrowAggregatePython")
LIMITS = ("CollectLimit", "GlobalLimit")
_SCAN = re.compile(r"(?:File)?Scan (csv|json|text|parquet|orc|avro)\b", re.I)
_DETAIL = {"partition": re.compile(r"PartitionFilters: \[(.*?)\](?:,|$|\s)"), "pushed": re.compile(r"PushedFilters: \[(.*?)\](?:,|$|\s)"), "data": re.compile(r"DataFilters: \[(.*?)\](?:,|$|\s)"), "location": re.compile(r"Location: (\S+?\[.*?\])")}
#: Details of a scan stand on its line or on one of the next ones.
LOOK_AHEAD = 8


@dataclass(frozen=True)
class Scan:
    format: str
    partition_filters: str = ""
    pushed_filters: str = ""
    data_filters: str = ""
    location: str = ""


@dataclass(frozen=True)
class ParsedPlan:
    adaptive: bool = False
    joins: list[str] = field(default_factory=list)
    exchanges: int = 0
    scans: list[Scan] = field(default_factory=list)
    cartesians: list[str] = field(default_factory=list)
    python: list[str] = field(default_factory=list)
    limits: list[str] = field(default_factory=list)
    sorts: int = 0


def _final_part(text: str) -> str:
    """Without the initial plan of an adaptive one."""
    return re.split(r"== Initial Plan ==", text)[0]


def parse_plan(text: str) -> ParsedPlan:
    text = text or ""
    body = _final_part(text)
    # Formatted text repeats the tree as details: a line "(3) Exchange" under it is the operator numbered in the tree.
    lines = body.splitlines()
    seen: set[tuple[str, str]] = set()
    joins, cartesians, python, limits, scans = [], [], [], [], []
    exchanges = sorts = 0
    for at, line in enumerate(lines):
        node = _NODE.match(line)
        if not node:
            continue
        inner = re.sub(r"^\(\d+\)\s*", "", node["body"])
        word = re.match(r"(?:File)?\w+", inner)
        if word is None:
            continue
        operator = word[0]
        # The number of an operator: at the start of its details, or at the end of its line in a formatted tree. (That after
        # an asterisk is of a code generation stage.)
        number = re.match(r"\((\d+)\) ", line) or re.search(r"\((\d+)\)\s*$", line)

        def new(what: str, number=number) -> bool:
            if number is None:
                return True
            key = (what, number[1])
            return not (key in seen or seen.add(key))

        if operator in JOINS and new(operator):
            joins.append(operator)
        elif operator in CARTESIANS and new(operator):
            cartesians.append(operator)
        elif operator == "Exchange" and new(operator):
            exchanges += 1
        elif operator in PYTHON and new(operator):
            python.append(operator)
        elif operator in LIMITS and new(operator):
            limits.append(operator)
        elif operator == "Sort" and new(operator):
            sorts += 1
        elif found := _SCAN.search(inner[:60]):
            context = [line]
            for other in lines[at + 1 : at + 1 + LOOK_AHEAD]:
                if _SCAN.search(other):
                    break
                context.append(other)
            joined = "\n".join(context)
            detail = {k: (m[1].strip() if (m := p.search(joined)) else "") for k, p in _DETAIL.items()}
            scan = Scan(found[1].lower(), detail["partition"], detail["pushed"], detail["data"], detail["location"])
            if new("scan"):
                scans.append(scan)
            elif any(detail.values()):
                # The details of a scan that the tree has named already.
                bare = next((i for i, s in enumerate(scans) if s.format == scan.format and not (s.partition_filters or s.pushed_filters or s.data_filters or s.location)), None)
                if bare is not None:
                    scans[bare] = scan
    return ParsedPlan("AdaptiveSparkPlan" in text or "AQEShuffleRead" in text, joins, exchanges, scans, cartesians, python, limits, sorts)
