"""Suffix sorting in external memory by induction, with common prefixes.

As in SA-IS and its external form eSAIS: suffixes are L or S by whether they are larger or smaller than their successor; the
leftmost S of each run (S*) are sorted first, by sorting the substrings between them and, where those repeat, by recursion
on the string of their names. Then one pass in ascending order induces the L suffixes from their successors, and one in
descending order the S suffixes. A suffix that is taken from the queues, smallest (largest) first, sends its predecessor,
with the length of their common prefix, to the queue of the predecessor's first character; in that queue suffixes arrive in
order, so the priority queue is one first-in-first-out queue per character. Queues, and every array with an entry for each
suffix or S*, are on disk beyond `in_memory` entries; they are worked on in blocks by array operations. What
stays in memory: a recursion's last string, of up to `base_case` names (some 50 bytes each), and in a recursion above that a
queue object for each distinct name.

Prefixes are compared, and counted, up to `cap` characters only; suffixes equal that far come in any order.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from ._text import GOLD, U64, mix

#: Suffixes in a block; entries that all queues of a sort hold in memory; the longest string sorted in memory by doubling.
BLOCK, IN_MEMORY, BASE_CASE = 1 << 18, 1 << 22, 1 << 22
ENTRY = np.dtype([("at", "<i8"), ("lcp", "<u2")])


def scratch(n: int, dtype, in_memory: int) -> np.ndarray:
    """An array of n, in a file that ends with it where it would be larger than `in_memory` entries."""
    if n <= in_memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(n,))


class Queue:
    """Entries in order of arrival; what doesn't fit in memory goes to one scratch file of the sort."""

    __slots__ = ("parts", "spool")

    def __init__(self, spool: Spool):
        self.parts: list = []
        self.spool = spool

    def put(self, at: np.ndarray, lcp: np.ndarray) -> None:
        entries = np.empty(len(at), ENTRY)
        entries["at"], entries["lcp"] = at, lcp
        self.parts.append(self.spool.keep(entries))

    def blocks(self) -> Iterator[np.ndarray]:
        """Take all entries, also those that arrive meanwhile."""
        taken = 0
        while taken < len(self.parts):
            upto, entries = taken, []
            n = 0
            while upto < len(self.parts) and n < BLOCK:
                part = self.spool.read(self.parts[upto])
                self.parts[upto] = None
                entries.append(part)
                n += len(part)
                upto += 1
            taken = upto
            yield np.concatenate(entries) if len(entries) > 1 else entries[0]

    def reversed_blocks(self) -> Iterator[np.ndarray]:
        """All entries from the last to the first."""
        while self.parts:
            yield self.spool.read(self.parts.pop())[::-1]


class Spool:
    def __init__(self, in_memory: int):
        self.room, self.file = in_memory, None

    def keep(self, entries: np.ndarray):
        if len(entries) <= self.room:
            self.room -= len(entries)
            return entries
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(entries.tobytes())
        return at, len(entries)

    def read(self, kept) -> np.ndarray:
        if isinstance(kept, tuple):
            self.file.seek(kept[0])
            return np.frombuffer(self.file.read(kept[1] * ENTRY.itemsize), ENTRY)
        self.room += len(kept)
        return kept

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def types(text: np.ndarray, in_memory: int) -> np.ndarray:
    """1 for S suffixes, 0 for L. The end of the text is smaller than any character."""
    n = len(text)
    out = scratch(n, np.uint8, in_memory)
    following, follow_type = -1, 0
    for lo in reversed(range(0, n, BLOCK)):
        part = text[lo : lo + BLOCK].astype(np.int64)
        after = np.append(part[1:], following)
        # Where a character equals the next one, the type is that of the next position at which they differ.
        differs = np.flatnonzero(part != after)
        where = np.searchsorted(differs, np.arange(len(part)))
        kind = np.append((part < after)[differs], follow_type).astype(np.uint8)
        out[lo : lo + BLOCK] = kind[where]
        following, follow_type = part[0], out[lo]
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes."""
    n, step = len(text), 16
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero((a >= 0) & (b >= 0))
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        reach = np.minimum(np.minimum(n - i, n - j), step)
        ahead = np.arange(step)
        x, y = text[np.minimum(i[:, None] + ahead, n - 1)], text[np.minimum(j[:, None] + ahead, n - 1)]
        same = (x == y) & (ahead < reach[:, None])
        run = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
        out[live] += run
        live = live[(run == step) & (out[live] < cap)]
    return np.minimum(out, cap)


class _Pass:
    """One induction pass: sends predecessors to queues and keeps, per character, the least common prefix since the last."""

    def __init__(self, text: np.ndarray, kinds: np.ndarray, spool: Spool, cap: int, want: int, small: bool):
        self.text, self.kinds, self.cap, self.want = text, kinds, cap, want
        self.queues: defaultdict[int, Queue] = defaultdict(lambda: Queue(spool))
        #: Common prefixes are carried for byte texts only; names of a recursion need order alone.
        self.carry = small
        self.least = np.full(256, cap, np.int64)
        self.started = np.zeros(256, bool)

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Take a block of suffixes in order; lcp: with the one before."""
        send = np.flatnonzero(at > 0)
        before = at[send] - 1
        right = self.kinds[before] == self.want
        send, before = send[right], before[right]
        chars = self.text[before]
        order = np.argsort(chars, kind="stable")
        send, before, chars = send[order], before[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        pushed = []
        lcp = lcp.astype(np.int64)
        for s, e in zip([0, *cuts], [*cuts, len(chars)], strict=True):
            if s == e:
                continue
            c, k = int(chars[s]), send[s:e]
            if self.carry:
                pushed.append(c)
                own = np.empty(e - s, np.int64)
                own[0] = min(self.least[c], lcp[: k[0] + 1].min())
                if e - s > 1:
                    own[1:] = np.minimum.reduceat(lcp[: k[-1] + 1], k[:-1] + 1)
                own = np.minimum(own + 1, self.cap)
                if not self.started[c]:
                    own[0], self.started[c] = 0, True
                self.least[c] = lcp[k[-1] + 1 :].min(initial=self.cap)
            else:
                own = np.zeros(e - s, np.int64)
            self.queues[c].put(before[s:e], own)
        if self.carry and len(lcp):
            rest = np.ones(256, bool)
            rest[pushed] = False
            self.least[rest] = np.minimum(self.least[rest], lcp.min())


def _pair(text: np.ndarray, a: int, b: int, cap: int) -> int:
    return int(common_prefix(text, np.array([a]), np.array([b]), cap)[0]) if a >= 0 and b >= 0 else 0


def _induce(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, star_lcp: np.ndarray, cap: int, in_memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in blocks, each with its common prefix with the one before (the larger one).

    stars: the S* suffixes in ascending order (by first character at least), with common prefixes.
    """
    small = text.dtype == np.uint8
    spool = Spool(in_memory)
    up = _Pass(text, kinds, spool, cap, 0, small)
    runs = _Runs(text, stars)
    alphabet = np.unique(text).tolist() if len(text) <= in_memory or small else _distinct(text)
    larger = {c: Queue(spool) for c in alphabet} if small else defaultdict(lambda: Queue(spool))
    # The end of the text comes first: its predecessor is an L suffix.
    up.scan(np.array([len(text)]), np.zeros(1, np.int64))
    for c in alphabet:
        last = -1
        if c in up.queues:
            for block in up.queues[c].blocks():
                larger[c].put(block["at"], block["lcp"])
                up.scan(block["at"], block["lcp"])
                last = int(block["at"][-1])
            del up.queues[c]
        s, e = runs.take(c)
        if s < e:
            for lo in range(s, e, BLOCK):
                hi = min(e, lo + BLOCK)
                lcp = np.array(star_lcp[lo:hi], np.int64)
                if lo == s:
                    lcp[0] = _pair(text, last, int(stars[s]), cap) if small else 0
                up.scan(np.asarray(stars[lo:hi]), lcp)
    down = _Pass(text, kinds, spool, cap, 1, small)
    for c in reversed(alphabet):
        last = -1
        if c in down.queues:
            for block in down.queues[c].blocks():
                yield block["at"], block["lcp"]
                down.scan(block["at"], block["lcp"])
                last = int(block["at"][-1])
            del down.queues[c]
        carried = None  # common prefix of the last entry seen with the next smaller one
        for block in larger[c].reversed_blocks() if c in larger else ():
            lcp = np.empty(len(block), np.int64)
            lcp[0] = (_pair(text, last, int(block["at"][0]), cap) if small else 0) if carried is None else carried
            lcp[1:] = block["lcp"][:-1]
            carried = int(block["lcp"][-1])
            yield block["at"], lcp
            down.scan(block["at"], lcp)
    spool.close()


class _Runs:
    """Where the S* of each first character stand among all, in order; found block by block, as characters go up."""

    def __init__(self, text: np.ndarray, stars: np.ndarray):
        self.text, self.stars, self.lo, self.at, self.first = text, stars, 0, 0, np.zeros(0, text.dtype)

    def take(self, char: int) -> tuple[int, int]:
        s = self.at
        while True:
            self.at = self.lo + int(np.searchsorted(self.first, char, "right"))
            if self.at < self.lo + len(self.first) or self.at == len(self.stars):
                return s, self.at
            self.lo = self.at
            self.first = self.text[np.asarray(self.stars[self.lo : self.lo + BLOCK])]


def _distinct(text: np.ndarray) -> list[int]:
    found = np.zeros(0, text.dtype)
    for lo in range(0, len(text), BLOCK):
        found = np.union1d(found, text[lo : lo + BLOCK])
    return found.tolist()


def _doubling(names: np.ndarray, names_needed: int) -> np.ndarray:
    """Suffixes of a string of names in order, as far as their first names say; in memory."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:] if width < n else rank[:0]
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        rank, width = new, width * 2
        if rank.max(initial=0) == n or width >= names_needed:
            return order


def _name(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, in_memory: int) -> tuple[np.ndarray, int]:
    """Names, in text order, of the substrings from each S* to the next: equal for equal ones, and in their order."""
    # Any order of S* with equal first characters sorts the substrings between them, by induction.
    by_char = _by_char(text, stars, in_memory)
    n = len(stars)
    rank = scratch(n, np.int64, in_memory)
    prefix = scratch(len(text) + 1, U64, in_memory)
    # A hash of a substring: sums of mixed (character, place); compared between neighbours in order only.
    power, total = U64(1), U64(0)
    step = np.uint64(0x9E6C63D0876A9A47)
    with np.errstate(over="ignore"):
        for lo in range(0, len(text), BLOCK):
            part = text[lo : lo + BLOCK].astype(U64) + U64(1)
            powers = np.cumprod(np.concatenate([[power], np.full(len(part), step, U64)]), dtype=U64)
            sums = np.cumsum(mix(part * GOLD) * powers[:-1], dtype=U64) + total
            prefix[lo + 1 : lo + 1 + len(part)] = sums
            total, power = sums[-1], powers[-1]
    count, previous = 0, None
    inverse = pow(int(step), -1, 1 << 64)

    def ends(k: np.ndarray) -> np.ndarray:
        return np.where(k + 1 < n, stars[np.minimum(k + 1, n - 1)] + 1, len(text))

    def hashes(k: np.ndarray) -> np.ndarray:
        # Differences of prefixes carry the power of their start; it is divided out by its inverse.
        start = np.asarray(stars[k])
        return (prefix[ends(k)] - prefix[start]) * _power(inverse, start)

    # The passes give descending order; names count down.
    star_at = scratch(len(text) + 1, np.int64, in_memory)
    for lo in range(0, n, BLOCK):
        star_at[stars[lo : lo + BLOCK]] = np.arange(lo + 1, min(n, lo + BLOCK) + 1)
    for at, _ in _induce(text, kinds, by_char, scratch(n, np.uint8, in_memory), 1, in_memory):
        k = star_at[at]
        k = k[k > 0] - 1
        if not len(k):
            continue
        end = ends(k)
        # The last substring ends with the text, and equals no other.
        h, size = hashes(k), np.where(end == len(text), -1 - k, end - stars[k])
        ph, ps = np.concatenate([[previous[0]], h]) if previous else np.concatenate([h[:1], h]), np.concatenate([[previous[1]], size]) if previous else np.concatenate([[-(1 << 62)], size])
        new = (ph[1:] != ph[:-1]) | (ps[1:] != ps[:-1])
        steps = np.cumsum(new)
        rank[k] = count + steps
        count += int(steps[-1])
        previous = (h[-1], size[-1])
    for lo in range(0, n, BLOCK):
        rank[lo : lo + BLOCK] = count - rank[lo : lo + BLOCK]
    return rank, count


def _by_char(text: np.ndarray, stars: np.ndarray, in_memory: int) -> np.ndarray:
    """The S* by first character, stable: a counting sort, block by block."""
    n = len(stars)
    if n <= in_memory:
        return np.asarray(stars[np.argsort(text[stars], kind="stable")])
    most = max(int(text[stars[lo : lo + BLOCK]].max()) for lo in range(0, n, BLOCK))
    place = scratch(most + 2, np.int64, in_memory)
    for lo in range(0, n, BLOCK):
        char, times = np.unique(text[stars[lo : lo + BLOCK]], return_counts=True)
        place[char.astype(np.int64) + 1] += times
    for lo in range(1, most + 2, BLOCK):
        place[lo : lo + BLOCK] = place[lo - 1] + np.cumsum(place[lo : lo + BLOCK])
    out = scratch(n, np.int64, in_memory)
    for lo in range(0, n, BLOCK):
        own = np.asarray(stars[lo : lo + BLOCK])
        chars = text[own].astype(np.int64)
        order = np.argsort(chars, kind="stable")
        char, first, times = np.unique(chars[order], return_index=True, return_counts=True)
        out[np.repeat(place[char] - first, times) + np.arange(len(own))] = own[order]
        place[char] += times
    return out


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64, by squaring."""
    out, square = np.ones(len(exponents), U64), base
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        out = np.where((exponents >> bit) & 1 == 1, out * U64(square), out)
        square = square * square % (1 << 64)
    return out


def descending(text: np.ndarray, cap: int, in_memory: int = IN_MEMORY, base_case: int = BASE_CASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of a text (bytes, or integers of a recursion) from the largest to the smallest, in blocks: positions, and
    common prefixes, up to `cap`, with the suffix before. For integers common prefixes are not given."""
    if not len(text):
        return
    kinds = types(text, in_memory)
    stars, to = None, 0
    for fill in (False, True):  # counted first
        if fill:
            stars, to = scratch(to, np.int64, in_memory), 0
        for lo in range(0, len(text), BLOCK):
            own = kinds[lo : lo + BLOCK]
            left = np.concatenate([[1 if lo == 0 else kinds[lo - 1]], own[:-1]])
            found = np.flatnonzero((own == 1) & (left == 0))
            if fill:
                stars[to : to + len(found)] = found + lo
            to += len(found)
    order = stars
    if len(stars) > 1:
        names, distinct = _name(text, kinds, stars, in_memory)
        order = scratch(len(stars), np.int64, in_memory)
        if distinct == len(stars):
            for lo in range(0, len(stars), BLOCK):
                order[names[lo : lo + BLOCK]] = stars[lo : lo + BLOCK]
        elif len(stars) <= base_case:
            order[:] = stars[_doubling(np.asarray(names), cap)]
        else:
            to = len(stars)
            for at, _ in descending(names, cap, in_memory, base_case):
                order[to - len(at) : to] = stars[at[::-1]]
                to -= len(at)
    lcp = scratch(len(order), np.uint16, in_memory)
    if text.dtype == np.uint8:
        for lo in range(1, len(order), BLOCK):
            hi = min(len(order), lo + BLOCK)
            lcp[lo:hi] = common_prefix(text, np.asarray(order[lo - 1 : hi - 1]), np.asarray(order[lo:hi]), cap)
    yield from _induce(text, kinds, order, lcp, cap, in_memory)


def repeated(text: np.ndarray, length: int, in_memory: int = IN_MEMORY, base_case: int = BASE_CASE) -> np.ndarray:
    """Flags of the positions at which a string of `length` bytes starts that also starts elsewhere."""
    if length > np.iinfo(np.uint16).max:
        raise ValueError("common prefixes are carried in 16 bits")
    out = scratch(len(text), np.uint8, in_memory)
    before = -1
    for at, lcp in descending(text, length, in_memory, base_case):
        long = np.flatnonzero(lcp >= length)
        out[at[long]] = 1
        out[at[long[long > 0] - 1]] = 1
        if len(long) and long[0] == 0 and before >= 0:
            out[before] = 1
        before = int(at[-1])
    return out
