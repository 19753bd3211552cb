"""Token counts without token ids: the pieces of each distinct pre-token are counted once in the whole corpus, and joined to
the pre-token frequencies of each document.

Documents go in slabs of some million pre-tokens. A slab has a dictionary of its distinct pre-tokens, and each of its documents
the codes of its own, with repetitions. Dictionaries are cut by a hash of the pre-token into buckets; all parts of a bucket
meet, where the tokenizer library counts the pieces of each distinct pre-token once. The counts go back to the slabs, in the
order of their dictionaries, and are summed through the codes. Rows of (document, pre-token) are never shuffled one by one:
a dictionary part is one value, and so are the codes of a document.

A very frequent pre-token is one entry of each slab's dictionary, so no bucket is larger for it than by the number of slabs.

Defined cases: null counts as empty, which has no tokens; a special string inside a text is the one token that the library
makes of it; a very long text is a slab of its own; repeated rows are counted alike; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_bytes, width_for

#: A slab ends at so many pre-tokens, or distinct ones; pre-tokens given to the library at once.
SLAB_TOKENS, SLAB_DISTINCT, BATCH = 1 << 22, 400_000, 8192


class PieceCounter:
    """Counts the tokens of pre-tokens as the `tokenizers` library does for a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        #: The pattern of byte-level pre-tokens.
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.find(p)], len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        out: list[int] = []
        for i in range(0, len(pretokens), BATCH):
            out += map(len, self.tokenizer.encode_batch_fast(pretokens[i : i + BATCH], add_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _vocabulary(name: str) -> str:
    """A file name of the public tokenizers, or a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def planes(values: np.ndarray) -> bytes:
    """32-bit values by byte planes, which compress well where they are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def values(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Dictionary:
    """The distinct pre-tokens of a slab, in buckets; the documents' pre-tokens as codes."""

    def __init__(self, buckets: int, most_tokens: int, most_distinct: int):
        self.buckets, self.most_tokens, self.most_distinct = buckets, most_tokens, most_distinct
        self.codes: defaultdict[str, int] = defaultdict(count().__next__)
        self.docs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, pretokens: list[str]) -> None:
        self.docs.append(np.fromiter(map(self.codes.__getitem__, pretokens), np.int32, len(pretokens)))
        self.tokens += len(pretokens)

    def full(self) -> bool:
        return self.tokens >= self.most_tokens or len(self.codes) >= self.most_distinct

    def parts(self) -> tuple[list[tuple[int, bytes]], list[bytes]]:
        """(bucket, its pre-tokens in order) for each bucket that has some, and the codes of each document: places in the
        order of all buckets, sorted, as differences."""
        words = list(self.codes)
        encoded = [w.encode() for w in words]
        bucket = np.fromiter(map(crc32, encoded), np.int64, len(words)) % self.buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        dictionary = []
        for s, e in zip([0, *cuts], [*cuts, len(order)], strict=True):
            if e > s:
                own = [encoded[k] for k in order[s:e]]
                # Sizes first: a pre-token may hold any character.
                dictionary.append((int(bucket[order[s]]), len(own).to_bytes(4, "little") + planes(np.fromiter(map(len, own), np.int64, len(own))) + b"".join(own)))
        coded = [planes(np.diff(np.sort(place[d]), prepend=0)) for d in self.docs]
        return dictionary, coded


def words_of(part: bytes) -> list[str]:
    n = int.from_bytes(part[:4], "little")
    ends = np.cumsum(values(part[4 : 4 + 4 * n])) + 4 + 4 * n
    return [part[a:b].decode() for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


PARTS = "slab bigint, bucket int, id {id}, n_bytes bigint, special bigint, packed binary"
NAMES = ["slab", "bucket", "id", "n_bytes", "special", "packed"]


def _slabs(path: str, *sizes: int):
    """Rows of two kinds. bucket not null: part of a slab's dictionary. bucket null: a document, its size, special tokens and
    codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, number = _counter(path), count(TaskContext.get().partitionId() << 32)
        own, held, special = Dictionary(*sizes), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal own, held, special
            slab, n = next(number), len(special)
            dictionary, coded = own.parts()
            ids, n_bytes = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
            for s in range(0, n, 4096):
                k = min(n - s, 4096)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(slab, pa.int64()), k), pa.nulls(k, pa.int32()), ids.slice(s, k), n_bytes.slice(s, k), pa.array(special[s : s + k], pa.int64()), pa.array(coded[s : s + k], pa.binary())], names=NAMES)
            k = len(dictionary)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(slab, pa.int64()), k), pa.array([b for b, _ in dictionary], pa.int32()), pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([p for _, p in dictionary], pa.binary())], names=NAMES)
            own, held, special = Dictionary(*sizes), [], []

        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column(2)):
                found, n = counter.pretokens(text.as_py() or "")
                own.add(found)
                special.append(n)
                if own.full():
                    held.append((batch.column(0).slice(first, k + 1 - first), batch.column(1).slice(first, k + 1 - first)))
                    first = k + 1
                    yield from flush()
            if first < batch.num_rows:
                held.append((batch.column(0).slice(first), batch.column(1).slice(first)))
        if special:
            yield from flush()

    return run


def _pieces(path: str):
    """Dictionary parts, bucket by bucket, to the piece counts of their pre-tokens, in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, bucket, known = _counter(path), None, {}
        for batch in batches:
            out = []
            for b, part in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                words = words_of(part.as_py())
                new = [w for w in words if w not in known]
                known.update(zip(new, counter.pieces(new), strict=True))
                out.append(planes(np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["slab", "bucket", "packed"])

    return run


def _sums(limit: int):
    """Slab by slab, counts of its dictionary and then its documents, to the counts of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, parts, counts = None, [], np.zeros(0, np.int64)
        for batch in batches:
            keep, tokens = [], []
            for row, (s, bucket, special, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True)):
                if s != slab:
                    slab, parts, counts = s, [], np.zeros(0, np.int64)
                if bucket is not None:
                    parts.append(values(packed.as_py()))
                    continue
                if parts:
                    counts, parts = np.concatenate(parts), []
                keep.append(row)
                tokens.append(special + int(counts[np.cumsum(values(packed.as_py()))].sum()))
            if keep:
                at, n = pa.array(keep), np.array(tokens, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. vocabulary: a byte-level BPE file of `tokenizers`."""
    path, spark = _vocabulary(vocabulary), docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    width = width_for(spark, text_bytes(docs, text_col))
    parts = materialize(rows.mapInArrow(_slabs(path, 4 * width, SLAB_TOKENS, SLAB_DISTINCT), PARTS.format(id=kind)), "pretokens")
    dictionaries = parts.where("bucket IS NOT NULL").select("slab", "bucket", "packed").repartition(width, "bucket").sortWithinPartitions("bucket")
    counts = dictionaries.mapInArrow(_pieces(path), "slab bigint, bucket int, packed binary")
    both = parts.where("bucket IS NULL").unionByName(counts, allowMissingColumns=True)
    both = both.repartition(width, "slab").sortWithinPartitions("slab", F.col("bucket").asc_nulls_last())
    return both.mapInArrow(_sums(limit), f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
