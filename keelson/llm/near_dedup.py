"""Near-duplicates of documents by chosen-path set similarity join.

A document is the set of its word shingles; texts with equal words are one class. Independent trees branch the classes: a
node picks one or two of the minwise tokens, and its members go to the child named by their token. A small node is compared
exhaustively; a large one branches on.

Two passes, both by `_descend`. The first compares signatures, and links classes that may be similar enough: its components
are families. All classes of a small family then meet once, with their texts, and are compared on full sets. Large families
descend the trees again, compared on full sets from the start. A comparison returns stars of what it has linked, never all
pairs, so that all results are linear in the members of nodes.

Skew: no group holds more than about 2 * SMALL classes. Members of larger nodes are passed on to the nodes below as they come,
those of the few nodes with a 20 000th of all members before anything is shuffled. A passage that many documents share makes
large nodes, whose members part as deeper tokens fall outside it. A family of near copies parts slowly, so at every fourth
level large nodes are dealt into parts, each compared exhaustively, and most of such a family become one component wherever
the node is cut; what is outside of the node's largest component is then compared with every part, if it is small, or else
branches on. Pairs of one component are not compared again.

Recall: a pair at the threshold of 0.8 stays together for 1.1 picks of a node on average, so it is not lost with depth: it
is missed by all 12 picks at the roots with a chance of 0.2 ** 12 where these are small, and of 0.01 however deep they are.

Defined cases: null or wordless text has no set, and is linked with nothing; texts with fewer words than a shingle have one
shingle, all their words; very long texts are hashed in whole; repeated rows are one class; a null id is larger than any
other, and of equal ids (ties) the first row counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import attach, discard, materialize_arrow, materialize_rows, width_for, with_key
from ._text import GOLD, U64, Block, as_bytes, blocks, mix, prefix_hashes, shingles, span_hashes
from .components import components

#: Minwise tokens of a signature; independent trees; most members of a node, part or family that is compared exhaustively,
#: and most shingles of those that are compared on full sets; of how many levels one compares large nodes in parts; nodes
#: with more than this part of all members pass them on without meeting in one task; most bits for the sets of a group, in bytes.
TOKENS, TREES, SMALL, HEAVY, CONTRACT, HOT_NODES, BITS = 128, 8, 4096, 1 << 22, 4, 20_000, 1 << 30
#: A pair whose signatures agree in less than the threshold by so many standard deviations is not confirmed.
DEVIATIONS = 4.0
SALTS = mix((np.arange(1, TOKENS + 1).astype(U64)) * GOLD)
FACTORS = mix(SALTS) | U64(1)


def document_shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents of a block: hashes of their shingles, how many before each document, the hash of all words as two
    64-bit numbers, and the number of words."""
    starts, ends, first = block.words()
    words = span_hashes(prefix_hashes(block.data), starts, ends)
    n_words = np.diff(first)
    every = shingles(words, k)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    before = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(before[-1], U64)
    doc = np.repeat(np.arange(block.n), n)
    long = n_words[doc] >= k
    at = first[doc] + np.arange(before[-1]) - before[doc]
    if long.any():
        out[long] = every[at[long]]
    # All words of a document, in order: a polynomial by word, under two bases.
    whole = np.zeros((2, block.n), U64)
    place = (np.arange(len(words)) - np.repeat(first[:-1], n_words)).astype(U64)
    for row, salt in zip(whole, SALTS, strict=False):
        if len(words):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words + salt) * (mix(place * GOLD + salt) | U64(1)), dtype=U64)])
            row[:] = mix(sums[first[1:]] - sums[first[:-1]] + n_words.astype(U64))
    short = ~long
    out[short] = mix(whole[0][doc[short]] ^ (n_words[doc[short]].astype(U64) * GOLD))
    return out, before, whole, n_words


def distinct_sizes(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    own = np.unique(mix(hashes ^ mix(doc.astype(U64))), return_index=True)[1]
    return np.bincount(doc[own], minlength=len(before) - 1)


def minwise(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """TOKENS minima for each document; rows: documents. All documents have a shingle."""
    out = np.empty((TOKENS, len(before) - 1), U64)
    for i in range(TOKENS):
        out[i] = np.minimum.reduceat((hashes ^ SALTS[i]) * FACTORS[i], before[:-1])
    return mix(out).T


def root_picks(trees: int) -> list[tuple[int, int]]:
    """(tree, token) at the roots: two tokens in every other tree, else one; all different."""
    out = []
    for tree in range(trees):
        for _ in range(2 if tree % 2 == 0 else 1):
            out.append((tree, (len(out) * 37 + 11) % TOKENS))
    return out


SETS = "id {id}, kid string, kh bigint, n_shingles bigint, class_key binary, roots array<bigint>, signature binary, row bigint"


def describe(docs: DataFrame, k: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its key, size of its set, key of its class, roots (nodes below the roots of the trees), signature
    (8 bits of each minwise token), and a number of its own; materialized."""
    rows = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").select("id", F.col("_kid").alias("kid"), F.col("_kh").alias("kh"), "text")
    picks = root_picks(trees)
    tree_salt = mix(np.array([(t + 1) * 1000 + p for t, p in picks]).astype(U64))
    tokens = [p for _, p in picks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch.column(3), fold=True):
                hashes, before, whole, _ = document_shingles(block, k)
                sizes = distinct_sizes(hashes, before)
                full = np.flatnonzero(np.diff(before))
                keys: list = [None] * block.n
                roots: list = [None] * block.n
                signatures: list = [None] * block.n
                if len(full):
                    minima = minwise(hashes, before[np.append(full, block.n)])
                    nodes = mix(minima[:, tokens] ^ tree_salt).view(np.int64)
                    bits = (minima & U64(0xFF)).astype(np.uint8)
                    pairs = np.ascontiguousarray(whole[:, full].T)
                    for i, d in enumerate(full):
                        keys[d], roots[d], signatures[d] = pairs[i].tobytes(), nodes[i], bits[i].tobytes()
                own = [batch.column(i).slice(block.first, block.n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(signatures, pa.binary()), pa.array(np.arange(row, row + block.n))], names=["id", "kid", "kh", "n_shingles", "class_key", "roots", "signature", "row"])
                row += block.n

    return materialize_arrow(rows, run, SETS.format(id=rows.schema["id"].dataType.simpleString()), "near-sets")


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for block in blocks(texts, fold=True):
        hashes, before, _, _ = document_shingles(block, k)
        out += [np.unique(hashes[before[i] : before[i + 1]]) for i in range(block.n)]
    return out


class _Shared:
    """Sizes of the intersections of one set with others: by bits for what any two sets share, if these fit in memory."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.bits = sets, None
        if len(sets) > 8:
            code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
            place = np.cumsum(times > 1) - 1
            width = int(place[-1]) + 1
            if width * len(sets) <= BITS:
                self.bits, at = np.zeros((len(sets), -(-width // 64)), U64), 0
                row = np.zeros(self.bits.shape[1] * 64, np.uint8)
                for i, own in enumerate(sets):
                    mine = code[at : at + len(own)]
                    mine = place[mine[times[mine] > 1]]
                    at += len(own)
                    row[mine] = 1
                    self.bits[i] = np.packbits(row).view(U64)
                    row[mine] = 0

    def with_(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        return np.array([len(np.intersect1d(self.sets[j], self.sets[i], assume_unique=True)) for j in others], np.int64)


def united(component: np.ndarray, signature: np.ndarray, size: np.ndarray, least: float, percent: int, shared: _Shared | None) -> tuple[np.ndarray, np.ndarray]:
    """Known components that links among the members of a group unite: the smallest of those that are one now, and each other.

    least: of agreeing minwise tokens of a likely pair. shared: confirms likely pairs on full sets, if given.
    """
    known, label = np.unique(component, return_inverse=True)
    top = np.arange(len(known))
    label = label.astype(np.int64)
    for i in range(1, len(label)):
        others = np.flatnonzero(label[:i] != label[i])
        if not len(others):
            continue
        smaller, larger = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[100 * smaller >= percent * larger]
        others = others[np.count_nonzero(signature[others] == signature[i], axis=1) >= least]
        if shared is not None and len(others):
            both = shared.with_(i, others)
            others = others[100 * both >= percent * (size[others] + size[i] - both)]
        if len(others):
            joined = np.unique(np.append(label[others], label[i]))
            label[np.isin(label, joined)] = joined[0]
            top[np.isin(top, joined)] = joined[0]
    other = np.flatnonzero(top != np.arange(len(top)))
    return known[top[other]], known[other]


OUT = "a bigint, b bigint, node bigint, rep bigint, component bigint, n_shingles bigint, signature binary, text string"
MEMBER = ("node", "rep", "component", "n_shingles", "signature", "text")


def _links_of(table: pa.Table, starts: np.ndarray, k: int, percent: int, least: float) -> pa.RecordBatch:
    """What unites the members of each group of a table; columns as MEMBER, text perhaps null."""
    component, size = table.column(2).to_numpy(), table.column(3).to_numpy()
    signature = as_bytes(table.column(4))[0].reshape(-1, TOKENS)
    exact = table.num_rows > 0 and table.column(5).null_count == 0
    a, b, g = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while g < len(starts) - 1:
        # Sets of some groups at a time.
        upto, weight = g, 0
        while upto < len(starts) - 1 and (upto == g or weight + size[starts[upto] : starts[upto + 1]].sum() <= HEAVY):
            weight += size[starts[upto] : starts[upto + 1]].sum()
            upto += 1
        sets = _sets(table.column(5).slice(starts[g], starts[upto] - starts[g]), k) if exact else []
        for s, e in zip(starts[g:upto], starts[g + 1 : upto + 1], strict=True):
            if e - s > 1:
                low, high = united(component[s:e], signature[s:e], size[s:e], least, percent, _Shared(sets[s - starts[g] : e - starts[g]]) if exact else None)
                a.append(low)
                b.append(high)
        g = upto
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())]], names=["a", "b", *MEMBER])


def _branched(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Members of large nodes in the nodes below, of which a node has one or, three times of eight, two."""
    node = table.column(0).to_numpy().view(U64)
    signature = as_bytes(table.column(4))[0].reshape(-1, TOKENS)
    two = mix(node + GOLD) % U64(8) < 3
    below = []
    for which in (1, 2):
        token = mix(node ^ SALTS[which]) % U64(TOKENS)
        value = signature[np.arange(len(node)), token.astype(np.int64)]
        below.append(mix(mix(node * GOLD + token) + value.astype(U64)).view(np.int64))
    for nodes, at in ((below[0], np.arange(len(node))), (below[1], np.flatnonzero(two & (below[0] != below[1])))):
        if len(at):
            part = table.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(nodes[at]), *[part.column(i).combine_chunks() for i in range(1, 6)]], names=["a", "b", *MEMBER])


def _walk(k: int, percent: int, small: int, heavy: int):
    """Node by node (rows as MEMBER, sorted): links within a small one; the members of a large one, in the nodes below."""
    threshold = percent / 100
    least = (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / TOKENS)) * TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        passing = None  # the large node that is being passed on

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole nodes."""
            node = table.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
            n = np.diff(starts)
            weight = np.add.reduceat(table.column(3).to_numpy(), starts[:-1])
            # Of two there is nothing to branch for.
            large = (n > small) | ((n > 2) & (weight > heavy) & (table.column(5).null_count == 0))
            if large.any():
                chosen = np.repeat(large, n)
                yield from _branched(table.filter(pa.array(chosen)))
                table = table.filter(pa.array(~chosen)).combine_chunks()
                n = n[~large]
                starts = np.concatenate([[0], np.cumsum(n)])
            if (n > 1).any():
                yield _links_of(table.combine_chunks(), starts, k, percent, least)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if passing is not None:
                more = int(np.searchsorted(table.column(0).to_numpy(), passing, "right"))
                if more:
                    yield from _branched(table.slice(0, more))
                    table = table.slice(more)
                if not table.num_rows:
                    continue
                passing = None
            if rest is not None:
                table = pa.concat_tables([rest, table])
            table = table.combine_chunks()
            node = table.column(0).to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last:
                yield from done(table.slice(0, last).combine_chunks())
            rest = table.slice(last)
            if rest.num_rows > small:
                yield from _branched(rest.combine_chunks())
                rest, passing = None, int(node[-1])
        if rest is not None:
            yield from done(rest.combine_chunks())

    return run


def _compare(rows: DataFrame, width: int, k: int, percent: int, label: str, small: int | None = None) -> DataFrame:
    """What links within each node of `rows` (MEMBER) unite, and the members of larger nodes than `small`, if given, in the
    nodes below; materialized."""
    text = F.col("text") if "text" in rows.columns else F.lit(None).cast("string").alias("text")
    rows = rows.select("node", "rep", "component", "n_shingles", "signature", text)
    return materialize_arrow(rows.repartition(width, "node").sortWithinPartitions("node", "rep"), _walk(k, percent, small or 1 << 40, HEAVY if small else 1 << 60), OUT, label)


def _with_component(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their component by all links so far."""
    joined = components(links).withColumnRenamed("id", "rep")
    return members.drop("component").join(joined.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _contract(members: DataFrame, found: list[DataFrame], width: int, k: int, percent: int, label: str) -> DataFrame:
    """Compare the members of large nodes in parts, and what is then outside of a node's largest component with every part
    of it, if that is little; adds to `found`, and returns the members of the nodes below the others."""
    exact, columns = "text" in members.columns, members.columns

    def links(groups: DataFrame) -> DataFrame:
        return _compare(groups, width, k, percent, f"near-links-{label}").select("a", "b")

    pieces = F.ceil(F.greatest(F.col("n") / SMALL, F.col("weight") / HEAVY if exact else F.lit(0.0)))
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = sizes.where("n > 1 AND lo < hi").select("node", F.when(F.col("n") == 2, F.lit(1)).otherwise(pieces).cast("long").alias("pieces"))
    dealt = members.join(materialize_rows(sizes, f"near-sizes-{label}").hint("merge"), "node")
    part = lambda at: F.when(F.col("pieces") == 1, F.col("node")).otherwise(F.xxhash64("node", at))
    dealt = materialize_rows(dealt.withColumn("part", part(F.pmod(F.xxhash64("rep", "node"), F.col("pieces")))), f"near-dealt-{label}")
    found.append(links(dealt.withColumn("node", F.col("part"))))
    large = materialize_rows(_with_component(dealt.where("pieces > 1"), reduce(DataFrame.union, found)), f"near-large-{label}")
    kinds = large.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).groupBy("node")
    kinds = kinds.agg(F.max(F.struct("n", "component", "weight")).alias("top"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    few = (F.col("n") - F.col("top.n") <= SMALL) & (F.lit(not exact) | (F.col("weight") - F.col("top.weight") <= HEAVY))
    kinds = materialize_rows(kinds.select("node", F.col("top.component").alias("major"), few.alias("few")), f"near-kinds-{label}")
    large = materialize_rows(large.join(kinds.hint("merge"), "node"), f"near-mixed-{label}")
    minors = large.where("few AND component <> major").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda at: F.xxhash64("node", at))))
    groups = large.where("few AND component = major").select("part", *columns).union(minors.select("part", *columns))
    found.append(links(groups.withColumn("node", F.col("part"))))
    return materialize_arrow(large.where("NOT few").select(*columns), _passed, OUT, f"near-members-{label}")


def _descend(members: DataFrame, links: DataFrame | None, k: int, percent: int, label: str) -> DataFrame:
    """All links (a, b) that are found at the nodes of `members` and below, and `links`, those known.

    members: MEMBER without component; with text if links are to be confirmed on full sets.
    """
    spark, exact = members.sparkSession, "text" in members.columns
    per_row, per_shingle = (240, 8) if exact else (240, 0)
    columns = [c for c in MEMBER if exact or c != "text"]
    members = _with_component(members, links) if links is not None else members.withColumn("component", F.col("rep"))
    members = materialize_rows(members.select(*columns), f"near-members-{label}")
    found, level, own = [] if links is None else [links], 0, members
    while True:
        rows, weight = members.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
        if not rows:
            break
        level += 1
        width = width_for(spark, rows * per_row + (weight or 0) * per_shingle)
        if level % CONTRACT:
            # Nodes with so many members, of which there are few, pass their members on at once, wherever these are.
            most = max(SMALL, rows // HOT_NODES)
            hot = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node")
            hot = materialize_rows(hot, f"near-hot-{label}") if rows > most else None
            few = members if hot is None else members.join(F.broadcast(hot), "node", "left_anti")
            walked = _compare(few, width, k, percent, f"near-walk-{label}", SMALL)
            found.append(walked.where("a IS NOT NULL").select("a", "b"))
            below, passed = walked.where("a IS NULL").select(*columns), None
            if hot is not None and not hot.isEmpty():
                passed = materialize_arrow(members.join(F.broadcast(hot), "node").select(*columns), _passed, OUT, f"near-members-{label}")
                below = below.union(passed.select(*columns))
            members = below
        else:
            passed = _contract(members, found, width, k, percent, label)
            members = passed.select(*columns)
        # What nothing reads again; `walked` holds links.
        discard(own)
        own = passed
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "a bigint, b bigint")


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            if table.num_columns < len(MEMBER):
                table = table.append_column("text", pa.nulls(table.num_rows, pa.string()))
            yield from _branched(table.combine_chunks())


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The given classes (rep, family, kid, kh, n_shingles, signature) with a text of each."""
    keyed = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    found = keyed.join(wanted.withColumnsRenamed({"kid": "_kid", "kh": "_kh"}).hint("merge"), ["_kid", "_kh"])
    # Repeated rows have one key; they are where the join has put it.
    return found.groupBy("_kid", "_kh").agg(*[F.first(c).alias(c) for c in ("rep", "family", "n_shingles", "signature", "text")]).drop("_kid", "_kh")


def links(docs: DataFrame, described: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes: class_key, rep, id; links between classes: a < b, by rep). described: as `describe` makes it."""
    spark = docs.sparkSession
    full = described.where("class_key IS NOT NULL")
    # The class is named by its first row in order of id, null last.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("m")
    classes = materialize_rows(full.groupBy("class_key").agg(first).select("class_key", F.col("m.row").alias("rep"), F.col("m.id").alias("id")), "near-classes")
    reps = materialize_rows(full.join(classes.select("rep").hint("merge"), F.col("row") == F.col("rep")).select("rep", "kid", "kh", "n_shingles", "roots", "signature"), "near-reps")

    # Families: what signatures link.
    rows = reps.select("rep", "n_shingles", "signature", F.explode("roots").alias("node"))
    of = components(_descend(rows, None, k, percent, "likely"))
    of = of.union(of.select(F.col("component").alias("id"), "component").distinct()).withColumnsRenamed({"id": "rep", "component": "family"})
    owned = materialize_rows(of.join(reps.hint("merge"), "rep"), "near-owned")
    sizes = materialize_rows(owned.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")), "near-sizes")
    large = F.expr(f"n > 2 AND (n > {SMALL} OR weight > {HEAVY})")
    rows, weight, some = sizes.agg(F.sum("n"), F.sum("weight"), F.count_if(large)).first()
    texts = materialize_rows(_texts(docs, owned.drop("roots"), id_col, text_col), "near-texts")

    # Small families meet; large ones descend on full sets.
    width = width_for(spark, (rows or 0) * 240 + (weight or 0) * 8)
    marked = texts.join(sizes.where(large).select("family", F.lit(True).alias("large")).hint("merge"), "family", "left") if some else texts
    small = marked.where("large IS NULL") if some else texts
    small = small.select(F.col("family").alias("node"), "rep", F.col("rep").alias("component"), "n_shingles", "signature", "text")
    found = _compare(small, width, k, percent, "near-links").select("a", "b")
    if some:
        own = materialize_rows(marked.where("large").drop("family", "large"), "near-own")
        roots = materialize_rows(own.select("rep").join(reps.select("rep", "roots").hint("merge"), "rep"), "near-inside")

        def members(picks: Column, links: DataFrame | None) -> DataFrame:
            """At nodes that hold several components."""
            nodes = roots.select("rep", F.explode(picks).alias("node"))
            if links is not None:
                nodes = _with_component(nodes, links)
                several = nodes.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
                nodes = nodes.join(several.hint("merge"), "node", "left_semi")
            return nodes.select("rep", "node").join(own.hint("merge"), "rep")

        # One tree first: it leaves few components, and most nodes of the others in one of them.
        more = _descend(members(F.slice("roots", 1, 2), None), None, k, percent, "first")
        more = _descend(members(F.slice("roots", 3, 2 * TREES), more), more, k, percent, "exact")
        found = found.union(more)
    return classes, found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, stays, and the key of the row (`_kid`, `_kh`).

    component_id: the smallest id among the documents that links reach. kept: id = component_id. stays: true for one row of
    each component, also where ids are null or repeated.
    """
    described = describe(docs, k, trees, id_col, text_col)
    classes, found = links(docs, described, k, percent, id_col, text_col)
    joined = components(found)
    named = classes.join(joined.withColumnRenamed("id", "rep_").withColumnRenamed("component", "top").hint("merge"), F.col("rep") == F.col("rep_"), "left").withColumn("top", F.coalesce("top", "rep"))
    named = materialize_rows(named.select("class_key", "rep", "id", "top"), "near-named")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rep").alias("rep"))).alias("m")
    tops = materialize_rows(named.groupBy("top").agg(first).select("top", F.col("m.id").alias("component_id"), F.col("m.rep").alias("first_row")), "near-tops")
    named = materialize_rows(named.join(tops.hint("merge"), "top").select("class_key", "component_id", "first_row"), "near-named")
    out = described.select("id", "kid", "kh", "row", "n_shingles", "class_key").join(named.hint("merge"), "class_key", "left")
    alone = F.col("class_key").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
        (alone | (F.col("row") == F.col("first_row"))).alias("stays"), F.col("kid").alias("_kid"), F.col("kh").alias("_kh"),
    )


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, with all columns."""
    found = near_duplicates(docs, k, percent, id_col=id_col, text_col=text_col)
    return attach(docs, found.select("_kid", "_kh", "stays"), "stays", id_col, text_col).where("stays").select("doc.*")
