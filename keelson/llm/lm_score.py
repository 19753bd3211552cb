"""Language-model scores: the marginal probability of a text over all its segmentations into the pieces of a vocabulary.

The vocabulary's own scores weight the segmentations at first; expectation maximisation over the training documents then
fits the weights of the same pieces. Pieces don't cross words, so a text's lattice is a chain of its words' lattices: a
forward recursion in log space runs once per distinct word, and a text's log probability is the sum over its words and its
end. The weights of all pieces and the end sum to one.

Flow: each task codes the words of a slab of documents by a dictionary and writes each document as codes, each distinct
word with its training count. Words meet by hash: counts, lattice probabilities. Those of a slab's words, a few bytes
each, go back to the slab, where the documents' codes gather them. Texts are never moved, and no table of the corpus's
words is broadcast or collected; only the weights of the vocabulary's pieces are.

Defined cases: null text is empty, and has the end as its only token; a null id counts as the empty string for the fold;
repeated rows are scored alike, each counting in training; without training documents all counts are zero and the
vocabulary's own scores are used; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_bytes, width_for
from ._text import BASE, GOLD, U64, mix
from .sentencepiece_codec import MARK, Pieces
from .token_count import _vocabulary

#: A slab ends with the document that brings it to so many tokens or distinct words.
SLAB_TOKENS, SLAB_WORDS = 1 << 22, 1 << 19
FOLDS, HELD_OUT = 7, 2
#: Rounds of expectation maximisation, and how many tokens the vocabulary's own scores count as in each.
ROUNDS, PRIOR = 2, 1000.0
#: Words up to this length go through arrays, by length; longer ones one by one.
ARRAY_LENGTH, AT_ONCE = 48, 1 << 13
TABLE_BITS = 18


class Lattice:
    """Pieces with log weights; forward and backward sums over all segmentations of words."""

    def __init__(self, pieces: Pieces):
        names, n = pieces.names, len(pieces.names)
        usable = [i for i in pieces.score if not names[i].strip(MARK) == ""] + [i for i in pieces.score if names[i] == MARK]
        self.byte_id = np.array(pieces.byte_id)
        self.id_of = {names[i]: i for i in usable}
        self.longest = max(map(len, self.id_of))
        least = min(pieces.score.values())
        self.start = np.full(n, -np.inf)
        self.start[usable] = [pieces.score[i] for i in usable]
        self.start[self.byte_id] = least
        self.start -= np.log(np.exp(self.start).sum())
        self.powers = [1]
        for _ in range(self.longest):
            self.powers.append(self.powers[-1] * int(BASE) % (1 << 64))
        # A hash table in three layers, by different bits of the hash.
        self.key = np.zeros(n + 1, U64)
        self.layers = [np.full(1 << TABLE_BITS, n, np.int32) for _ in range(3)]
        for name, i in self.id_of.items():
            h = U64(0)
            for c in name:
                h = U64((int(h) * int(BASE) + ord(c) + 1) % (1 << 64))
            self.key[i] = k = self._finish(np.array([h]), len(name))[0]
            for layer, shift in zip(self.layers, (46, 28, 10), strict=True):
                at = (int(k) >> shift) & ((1 << TABLE_BITS) - 1)
                if layer[at] == n:
                    layer[at] = i
                    break
            else:
                raise ValueError("hash table overflow")
        self.none = n

    @staticmethod
    def _finish(h: np.ndarray, length: int) -> np.ndarray:
        return mix(h + U64(length * int(GOLD) % (1 << 64))) | U64(1)

    def _lookup(self, h: np.ndarray, length: int) -> np.ndarray:
        """Ids of the pieces with these hashes, or `none`."""
        key, out = self._finish(h, length), np.full(len(h), self.none, np.int32)
        for layer, shift in zip(self.layers, (46, 28, 10), strict=True):
            i = layer[(key >> U64(shift)) & U64((1 << TABLE_BITS) - 1)]
            out = np.where(self.key[i] == key, i, out)
        return out

    def _arrays(self, words: list[str], weight: np.ndarray, counts: np.ndarray | None, into: np.ndarray | None) -> np.ndarray:
        """Log probabilities of words of one length; adds expected counts of pieces, times `counts`, to `into`."""
        n, size = len(words), len(words[0])
        chars = np.array(words, f"<U{size}").view(np.uint32).reshape(n, size)
        prefix = np.zeros((size + 1, n), U64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * BASE + chars[:, j].astype(U64) + U64(1)
        extended = np.append(weight, -np.inf)
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0
        arcs = []
        for j in range(1, size + 1):
            for length in range(1, min(self.longest, j) + 1):
                ids = self._lookup(prefix[j] - prefix[j - length] * U64(self.powers[length]), length)
                w = extended[ids]
                if length == 1 and (missing := np.flatnonzero(ids == self.none)).size:
                    w[missing] = [self._bytes_weight(chr(c), weight) for c in chars[missing, j - 1]]
                elif not (w > -np.inf).any():
                    continue
                forward[j] = np.logaddexp(forward[j], forward[j - length] + w)
                if into is not None:
                    arcs.append((j - length, j, ids, w))
        if into is not None:
            backward = np.full((size + 1, n), -np.inf)
            backward[size] = 0
            for i, j, _, w in reversed(arcs):
                backward[i] = np.logaddexp(backward[i], w + backward[j])
            for i, j, ids, w in arcs:
                expected = np.exp(forward[i] + w + backward[j] - forward[size]) * counts
                into += np.bincount(ids, expected, self.none + 1)[:-1]
                if j - i == 1:
                    for k in np.flatnonzero((ids == self.none) & (expected > 0)):
                        np.add.at(into, self.byte_id[list(words[k][i].encode())], expected[k])
        return forward[size]

    def _bytes_weight(self, char: str, weight: np.ndarray) -> float:
        return float(weight[self.byte_id[list(char.encode())]].sum())

    def _single(self, word: str, weight: np.ndarray, times: float, into: np.ndarray | None) -> float:
        """The same for one word of any length."""
        n, forward, arcs = len(word), [0.0], []
        for j in range(1, n + 1):
            ends = []
            for i in range(max(0, j - self.longest), j):
                piece = self.id_of.get(word[i:j])
                if piece is not None:
                    ends.append((i, piece, weight[piece]))
                elif i == j - 1:
                    ends.append((i, None, self._bytes_weight(word[i], weight)))
            top = max(forward[i] + w for i, _, w in ends)
            forward.append(top + math.log(sum(math.exp(forward[i] + w - top) for i, _, w in ends)))
            if into is not None:
                arcs.append(ends)
        if into is not None:
            backward = [-math.inf] * n + [0.0]
            for j in range(n, 0, -1):
                for i, _, w in arcs[j - 1]:
                    a, b = backward[i], w + backward[j]
                    backward[i] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
            for j in range(1, n + 1):
                for i, piece, w in arcs[j - 1]:
                    ids = [piece] if piece is not None else self.byte_id[list(word[i].encode())]
                    np.add.at(into, ids, times * math.exp(forward[i] + w + backward[j] - forward[n]))
        return forward[n]

    def run(self, words: list[str], weight: np.ndarray, counts: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word (with its mark). into: gets the expected counts of pieces, words times `counts`."""
        marked, out = [MARK + w for w in words], np.zeros(len(words))
        sizes = np.fromiter(map(len, marked), np.int64, len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > ARRAY_LENGTH:
                for k in at:
                    out[k] = self._single(marked[k], weight, 0.0 if counts is None else float(counts[k]), into)
                continue
            for s in range(0, len(at), AT_ONCE):
                part = at[s : s + AT_ONCE]
                out[part] = self._arrays([marked[k] for k in part], weight, None if counts is None else counts[part], into)
        return out


@lru_cache(maxsize=2)
def lattice(path: str, scores: str = "zipf") -> Lattice:
    return Lattice(Pieces(path, scores))


def pack(codes: np.ndarray) -> bytes:
    """Codes, in ascending order, as differences by byte planes; small after compression."""
    codes = np.sort(codes).astype("<u4")
    return np.diff(codes, prepend=codes[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


SLABS = "slab bigint, lid int, word string, n bigint, id {id}, held_out boolean, codes binary"


def slabs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds. lid not null: a distinct word of a slab with its count in training documents. lid null: a
    document, its fold, its number of words and their packed codes."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = docs.select(F.col(id_col).alias("id"), (fold == HELD_OUT).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        codes: defaultdict[bytes, int] = defaultdict(count().__next__)
        trained, ids, held, packed, sizes, tokens = np.zeros(0, np.int64), [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal codes, trained, ids, held, packed, sizes, tokens
            slab, n, d = next(number), len(codes), len(sizes)
            words = pa.array([w.decode() for w in codes], pa.string())
            none = lambda k, t: pa.nulls(k, t)
            id_type = ids[0].type if ids else None
            for s in range(0, n, 1 << 16):
                k = min(n, s + (1 << 16)) - s
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(slab, pa.int64()), k), pa.array(np.arange(s, s + k, dtype=np.int32)), words.slice(s, k), pa.array(trained[s : s + k]), none(k, id_type), none(k, pa.bool_()), none(k, pa.binary())], names=NAMES)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(slab, pa.int64()), d), none(d, pa.int32()), none(d, pa.string()), pa.array(sizes, pa.int64()), pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(packed, pa.binary())], names=NAMES)
            codes, trained, ids, held, packed, sizes, tokens = defaultdict(count().__next__), np.zeros(0, np.int64), [], [], [], [], 0

        for batch in batches:
            first = 0
            for k, (out, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                words = (text.as_py() or b"").lower().split()  # bytes: ASCII letters and white space only
                own = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                packed.append(pack(own))
                sizes.append(len(words))
                tokens += len(words)
                if len(trained) < len(codes):
                    trained = np.concatenate([trained, np.zeros(max(len(codes) - len(trained), len(trained)), np.int64)])
                if not out:
                    np.add.at(trained, own, 1)
                if tokens >= SLAB_TOKENS or len(codes) >= SLAB_WORDS:
                    ids.append(batch.column(0).slice(first, k + 1 - first))
                    held.append(batch.column(1).slice(first, k + 1 - first))
                    first = k + 1
                    yield from flush()
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
                held.append(batch.column(1).slice(first))
        if sizes:
            yield from flush()

    return rows.mapInArrow(run, SLABS.format(id=kind))


NAMES = ["slab", "lid", "word", "n", "id", "held_out", "codes"]


def _expectations(path: str, scores: str, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path, scores)
        into = np.zeros(len(weight))
        for batch in batches:
            own.run(batch.column(0).to_pylist(), weight, batch.column(1).to_numpy(zero_copy_only=False).astype(float), into)
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(into[at])], names=["piece", "expected"])

    return run


def _probabilities(path: str, scores: str, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path, scores)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.run(batch.column(0).to_pylist(), weight))], names=["word", "c", "log_p"])

    return run


def train(words: DataFrame, ends: int, path: str, scores: str = "zipf", rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log weights of the pieces, and of the end. words: word, c (training count); ends: training documents.

    What comes to the driver is one number per piece of the vocabulary.
    """
    start = lattice(path, scores).start
    weight, tokens = start, 0.0
    for _ in range(rounds):
        found = words.where("c > 0").mapInArrow(_expectations(path, scores, weight), "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).toPandas()
        expected = np.zeros(len(start))
        expected[found["piece"].to_numpy(np.int64)] = found["expected"].to_numpy()
        tokens = float(expected.sum())
        with np.errstate(divide="ignore"):
            weight = np.log((expected + PRIOR * np.exp(start)) / (tokens + PRIOR))
    end = (ends + 1) / (ends + 1 + tokens + PRIOR)
    return weight + math.log1p(-end), math.log(end)


def score(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", scores: str = "zipf", rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    base_score is that of a word unigram model with add-one smoothing over the same training documents.
    """
    path = _vocabulary(vocabulary)
    parts = materialize(slabs(docs, id_col, text_col), "lm-slabs")
    of_words, of_docs = parts.where("lid IS NOT NULL"), parts.where("lid IS NULL")
    counts = materialize(of_words.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = of_docs.where("NOT held_out").count()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    weight, end = train(counts, ends, path, scores, rounds)
    known = materialize(counts.mapInArrow(_probabilities(path, scores, weight), "word string, c bigint, log_p double"), "lm-words")
    rated = of_words.select("slab", "lid", "word").join(known.hint("merge"), "word").select("slab", "lid", F.col("c").alias("n"), "log_p", F.lit(None).cast(of_docs.schema["id"].dataType).alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("codes"))
    both = rated.unionByName(of_docs.select("slab", "lid", "n", F.lit(None).cast("double").alias("log_p"), "id", "held_out", "codes"))
    width = width_for(docs.sparkSession, text_bytes(docs, text_col), 16 << 20)
    both = both.repartition(width, "slab").sortWithinPartitions("slab", F.col("lid").asc_nulls_last())
    smoothing = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, fresh, own_c, own_p, c, p = None, False, [], [], np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            slabs_, lids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            word = np.asarray(lids.is_valid())
            # Runs of one slab and kind.
            cuts = np.flatnonzero((slabs_[1:] != slabs_[:-1]) | (word[1:] != word[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(word)], strict=True):
                if s == e:
                    continue
                if slabs_[s] != slab:
                    slab, fresh, own_c, own_p, c, p = slabs_[s], True, [], [], np.zeros(0, np.int64), np.zeros(0)
                if word[s]:
                    own_c.append(batch.column(2).slice(s, e - s).to_numpy(zero_copy_only=False))
                    own_p.append(batch.column(3).slice(s, e - s).to_numpy(zero_copy_only=False))
                    continue
                if fresh and own_c:
                    c, p, own_c, own_p = np.concatenate(own_c), np.concatenate(own_p), [], []
                fresh = False
                logs, seen = np.log10(c + 1.0), c > 0
                out: list[list] = [[], [], []]
                for packed in batch.column(6).slice(s, e - s).to_pylist():
                    codes = unpack(packed)
                    out[0].append(int(seen[codes].sum()) + (ends > 0))
                    out[1].append(float(logs[codes].sum()) + math.log10(ends + 1) - (len(codes) + 1) * smoothing)
                    out[2].append((float(p[codes].sum()) + end) / math.log(10))
                tokens = batch.column(2).slice(s, e - s).to_numpy(zero_copy_only=False) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4).slice(s, e - s), batch.column(5).slice(s, e - s), pa.array(tokens.astype(np.int64)), pa.array(out[0], pa.int64()), pa.array(np.full(e - s, n, np.int64)), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = of_docs.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumnRenamed("id", id_col)
