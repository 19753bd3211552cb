"""Removal of repeated substrings: bytes covered by a string of `length` bytes that also starts elsewhere in the corpus.

Suffixes are sorted by external induction (`suffix_sort`), shard by shard. A shard must hold every place where its strings
start, and little else, so strings are dealt by content: each string of `length` bytes belongs to its anchor, the least
(by hash) of its `SEED`-byte substrings, the first of equals; strings that start one after the other with one anchor make a
segment. Equal strings have the same anchor at the same place. Then

1. segments whose anchor occurs once in the corpus hold no repeated string, and are dropped unseen;
2. equal segments are counted: all strings of a segment that occurs twice are repeated (copies, and the inside of passages);
3. the different segments of an anchor, one of each, go to the anchor's shard. Those that agree with another in enough bytes
   before or after the anchor are sorted, so that strings with a common prefix of `length` bytes stand next to each other in
   suffix order.

Anchors with more than `GROUP` different segments (the edges of a passage that very many documents share) are split first:
strings are dealt anew by narrower places of the anchor in them and by the bytes that all strings of such a part share, and
steps 1 and 2 are repeated, until groups are small or a part is a single string, for which step 2 decides.

Defined cases: null counts as an empty text; matches are of bytes and never cross documents; texts shorter than `length`
lose nothing; of repeated rows each is a copy of the other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, width_for
from ._text import GOLD, U64, as_bytes, blocks, mix, prefix_hashes, span_hashes
from .suffix_sort import IN_MEMORY, repeated

LENGTH, SEED, GROUP = 400, 32, 64
#: Bytes of a shard, about: its pieces go to a scratch file of the task, whatever their number.
SHARD = 8 << 20
#: Longer texts are cut, for anchors, into overlapping parts of so many bytes; places in a part take PLACE_BITS bits.
PART, PLACE_BITS = 1 << 22, 24
SEPARATOR = 0xFF  # not a byte of UTF-8

SEGMENTS = "d1 bigint, d2 bigint, anchor bigint, content bigint, start int, size int, place int"


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each position, the place of the least hash among the `width` from it on (the first of equals)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = U64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes)).astype(U64)
    padded = np.full(-(-len(packed) // width) * width, ~U64(0), U64)
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & mask).astype(np.int64)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Document, anchor, content hash, start in the document, size, and place of the anchor, of all segments."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - seed + 1)
    hashes = span_hashes(prefix, at, at + seed)
    anchor = least_places(hashes, length - seed + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(doc[: len(anchor)] == doc[length - 1 : length - 1 + len(anchor)])
    if not len(whole):
        return none
    place = anchor[whole]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(whole) != 1)) + 1
    first, last = whole[np.concatenate([[0], cut])], whole[np.concatenate([cut - 1, [len(whole) - 1]])]
    place = anchor[first]
    content = mix(span_hashes(prefix, first, last + length) + (place - first).astype(U64) * GOLD)
    return doc[first], hashes[place].view(np.int64), content.view(np.int64), first - offsets[doc[first]], last + length - first, place - first


def segments(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """docs: d1, d2, text (binary). A row per segment; place: of the anchor in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), size=1 << 18):
                step = PART - length + 1
                # Only a block of one text can be longer than a part.
                for lo in range(0, max(1, len(block.data) - length + 1), step):
                    data = block.data[lo : lo + PART]
                    doc, anchor, content, start, size, place = _segments(data, np.minimum(block.offsets, len(data)) if lo == 0 else np.array([0, len(data)]), length, seed)
                    ids = pa.array(doc + block.first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(anchor), pa.array(content), pa.array((start + lo).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))],
                        names=["d1", "d2", "anchor", "content", "start", "size", "place"],
                    )

    return docs.mapInArrow(run, SEGMENTS)


PIECES = "d1 bigint, d2 bigint, grp bigint, content bigint, start int, place int, lo int, hi int, data binary"


def _quarters(length: int):
    """Split pieces: of the places lo to hi of the anchor in its strings, one quarter each, grouped by the bytes that all
    strings with such a place share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for d1, d2, grp, start, place, lo, hi, data in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", "grp", "start", "place", "lo", "hi", "data")), strict=True):
                step = max(1, (hi - lo) // 4)
                for a, b in ((a, a + step) for a in range(lo, hi, step)):
                    # Strings of this piece start at place - r, for r from a up to b.
                    low, high = max(0, place - b + 1), min(len(data) - length, place - a)
                    if low > high:
                        continue
                    own, anchor = data[low : high + length], place - low
                    core = data[place - a : max(place - a, place - b + 1 + length)]  # empty where the places are many
                    group = hashlib.blake2b(core + grp.to_bytes(8, "little", signed=True) + a.to_bytes(4, "little"), digest_size=8).digest()
                    content = hashlib.blake2b(own + anchor.to_bytes(4, "little"), digest_size=8).digest()
                    for column, value in zip(out, (d1, d2, int.from_bytes(group, "little", signed=True), int.from_bytes(content, "little", signed=True), start + low, anchor, a, b, own), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["d1", "d2", "grp", "content", "start", "place", "lo", "hi", "data"])

    return run


SPANS = "d1 bigint, d2 bigint, start int, size int"


def joined(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pieces one after the other, each followed by a separator; and their sizes."""
    text, offsets = as_bytes(data)
    out = np.full(len(text) + len(data), SEPARATOR, np.uint8)
    sizes = np.diff(offsets)
    out[np.arange(len(text)) + np.repeat(np.arange(len(data)), sizes)] = text
    return out, sizes


def sides(group: int, data: bytes, place: int, reach: int, seed: int) -> tuple[int, int]:
    """Hashes of the `reach` bytes before and after a piece's anchor, with its group; 0 where there are not so many."""
    before = hash((group, 0, data[place - reach : place])) if place >= reach else 0
    after = data[place + seed : place + seed + reach]
    return before, hash((group, 1, after)) if len(after) == reach else 0


def hopeful(keys: np.ndarray) -> np.ndarray:
    """Which pieces have one of their two keys in common with another."""
    out = np.zeros(len(keys), bool)
    for own in keys.T:
        _, at, times = np.unique(own, return_inverse=True, return_counts=True)
        out |= (times[at] > 1) & (own != 0)
    return out


def _sorted_shard(length: int, seed: int, in_memory: int):
    """Repeated strings of a shard's pieces, as spans of their documents.

    A string that two pieces hold has the anchor at one place in both, so they agree in half of the other bytes, rounded up,
    just before or just after it. Pieces for which no other does are not sorted.

    Only the pieces' keys are held; their bytes, and all that the sort makes of them beyond `in_memory` entries, are on disk.
    """
    reach = -(-(length - seed) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = [], []
        with tempfile.TemporaryFile() as whole, tempfile.TemporaryFile() as file:
            around, ends = [], [0]
            for batch in batches:
                for data, group, place in zip(batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    data = data.as_py()
                    whole.write(data)
                    ends.append(ends[-1] + len(data))
                    around.append(sides(group, data, place, reach, seed))
                keys.append([batch.column(i).to_numpy() for i in range(3)])
            if not around:
                return
            chosen = np.flatnonzero(hopeful(np.array(around, np.int64)))
            if not len(chosen):
                return
            del around
            for lo in range(0, len(chosen), 1024):
                parts = []
                for k in chosen[lo : lo + 1024].tolist():
                    whole.seek(ends[k])
                    parts.append(whole.read(ends[k + 1] - ends[k]))
                text, own = joined(pa.array(parts, pa.binary()))
                file.write(text.data)
                sizes.append(own)
            file.flush()
            text = np.memmap(file, np.uint8, "r")
        sizes, (d1, d2, at) = np.concatenate(sizes), (np.concatenate([k[i] for k in keys])[chosen] for i in range(3))
        del keys, ends
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flags = repeated(text, length, in_memory)
        lo = 0
        while lo < len(sizes):
            # Some pieces at a time: runs of flags, less those of strings that reach beyond their piece.
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 22), "right")) - 1)
            own = np.zeros(starts[hi] - starts[lo] + 2, bool)
            own[1:-1] = flags[starts[lo] : starts[hi]]
            ends = starts[lo + 1 : hi + 1] - starts[lo]
            for back in range(length):
                own[np.maximum(ends - back, starts[lo:hi] - starts[lo] + 1)] = False
            edge = np.diff(own.astype(np.int8))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            piece = np.searchsorted(starts, first + starts[lo], "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(d1[piece]), pa.array(d2[piece]), pa.array((at[piece] + first + starts[lo] - starts[piece]).astype(np.int32)), pa.array((last - first + length - 1).astype(np.int32))], names=["d1", "d2", "start", "size"])
            lo = hi

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, d1, d2 (a key of id and text), text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.select("id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("d2"), "text")


def places(length: int, seed: int) -> int:
    """A power of two, at least the number of places of an anchor in a string."""
    return 1 << (length - seed).bit_length()


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d1, d2 (key of a document), start, size: spans covered by repeated strings; they may overlap."""
    keyed = _keyed(docs, id_col, text_col)
    found = materialize(segments(keyed.select("d1", "d2", "text"), length, seed), "suffix-segments")
    # 1. Anchors that occur twice.
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    found = materialize(found.join(shared.hint("merge"), "anchor"), "suffix-shared")
    # 2. Equal segments.
    place = F.struct("d1", "d2", "start", "size", "place")
    distinct = materialize(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "suffix-distinct")
    copies = found.join(distinct.where("n > 1").select("anchor", "content").hint("merge"), ["anchor", "content"])
    # Written at once: a join that nothing is grouped on can be split where one content is hot.
    spans = [materialize(copies.select("d1", "d2", "start", "size"), "suffix-copies")]
    # 3. Different segments of an anchor, with their bytes.
    several = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "suffix-groups")
    rows = distinct.join(several.hint("merge"), "anchor").select(F.col("anchor").alias("grp"), "content", "members", "one.*")
    text = keyed.select(F.col("d1").alias("t1"), F.col("d2").alias("t2"), "text").hint("merge")
    bytes_ = F.substring(F.col("text"), F.col("start") + 1, F.col("size"))
    rows = rows.join(text, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2")))
    rows = rows.select("d1", "d2", "grp", "content", "start", "place", F.lit(0).alias("lo"), F.lit(places(length, seed)).alias("hi"), bytes_.alias("data"), "members")
    rows = materialize(rows.dropDuplicates(["grp", "content"]), "suffix-pieces")
    shards = []
    while True:
        shards.append(rows.where(F.col("members") <= GROUP).select("d1", "d2", "start", "data", "grp", "place"))
        large = rows.where(F.col("members") > GROUP)
        if large.isEmpty():
            break
        parts = materialize(large.drop("members").mapInArrow(_quarters(length), PIECES), "suffix-parts")
        one = F.min(F.struct("d1", "d2", "start", "place", "lo", "hi", "data"))
        distinct = materialize(parts.groupBy("grp", "content").agg(F.count(F.lit(1)).alias("n"), one.alias("one")), "suffix-distinct")
        copies = parts.select("d1", "d2", "grp", "content", "start", F.octet_length("data").alias("size")).join(distinct.where("n > 1").select("grp", "content").hint("merge"), ["grp", "content"])
        spans.append(materialize(copies.select("d1", "d2", "start", "size"), "suffix-copies"))
        several = materialize(distinct.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "suffix-groups")
        rows = materialize(distinct.join(several.hint("merge"), "grp").select("grp", "content", "members", "one.*"), "suffix-pieces")
    small = shards[0]
    for s in shards[1:]:
        small = small.union(s)
    volume = small.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    small = small.repartition(width_for(docs.sparkSession, volume, SHARD), "grp")
    spans.append(small.select("d1", "d2", "start", "data", "grp", "place").mapInArrow(_sorted_shard(length, seed, IN_MEMORY), SPANS))
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def remove_repeated(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (array of start, end; maximal, in order), kept (the remaining bytes)."""
    spans = repeated_spans(docs, length, seed, id_col, text_col)
    # Spans of a document meet in its row; repeated rows share them, and adding them twice does no harm.
    own = materialize(spans.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "size")).alias("spans")), "suffix-spans")
    rows = _keyed(docs, id_col, text_col).join(own.hint("merge"), ["d1", "d2"], "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, own = text.as_py(), []
                for s, e in sorted((x["start"], x["start"] + x["size"]) for x in found or ()):
                    if own and s <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], e)
                    else:
                        own.append([s, e])
                edges = [0, *(x for span in own for x in span), len(text)]
                sizes.append(len(text))
                merged.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeated(docs, length, id_col=id_col, text_col=text_col)
    return out.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
