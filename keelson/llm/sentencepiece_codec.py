"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each position its output links name every piece that ends there, and each relaxes the
best score of that position. Characters that no piece covers fall back to their bytes. Pieces hold a white-space mark only
at their start (or nothing else), so a text falls into segments, marks and what follows them, that no piece crosses; the
best path of a text is that of its segments, and a task keeps the paths of segments that it has seen.

The public vocabulary at hand has merge ranks in place of log probabilities. They become log probabilities by Zipf's law
(`scores="zipf"`); a model with log probabilities of its own is taken as it is (`scores="file"`).

Decoding gives back each text exactly. Defined cases: null is encoded like an empty text, to no pieces, and decodes to an
empty text; a literal mark (U+2581) in a text is encoded by its bytes; unpaired input does not occur, as texts are UTF-8;
repeated rows are encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_count import _vocabulary

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters that no piece covers score so much less than the least piece. Fixed value of the library.
UNKNOWN_PENALTY = 10.0
#: Scores are multiples of 1/GRID, so that their sums are exact and equal paths tie; of those, the earliest start wins.
GRID = 1 << 16
#: Segments whose paths a task keeps, and the longest of them.
KEPT, LONGEST = 300_000, 64


class Pieces:
    """A vocabulary: pieces, their scores, and the ids of the 256 bytes."""

    def __init__(self, path: str, scores: str = "zipf"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = [0] * 256
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(self.names[i][3:5], 16)] = i
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        given = [model.get_score(i) for i in normal]
        if scores == "zipf":
            # Merge ranks, the best first; equal scores share their place.
            place = {s: k for k, s in enumerate(sorted(set(given), reverse=True))}
            total = math.log(sum(1 / (place[s] + 2) for s in given))
            given = [-math.log(place[s] + 2) - total for s in given]
        given = [round(s * GRID) / GRID for s in given]
        self.score = dict(zip(normal, given, strict=True))
        self.unknown = min(given) - UNKNOWN_PENALTY
        self.by_segment = not any(MARK in self.names[i].lstrip(MARK) for i in normal)


class Codec:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for i, score in pieces.score.items():
            self.automaton.add_word(pieces.names[i], (len(pieces.names[i]), score, i))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[int, ...]] = {}
        #: What a piece stands for; byte pieces are handled apart.
        self.plain = [name.replace(MARK, " ").encode() for name in pieces.names]
        for b, i in enumerate(pieces.byte_id):
            self.plain[i] = bytes([b])
        self.literal = [pieces.byte_id[b] for b in MARK.encode()]

    def best_path(self, segment: str) -> tuple[list[int], float]:
        """Ids of the best path over `segment` and its score, by one pass of the automaton."""
        n, unknown = len(segment), self.pieces.unknown
        best, back, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here are final

        def step(to: int) -> None:
            nonlocal done
            while done < to:  # nothing ends here but the unknown character itself
                done += 1
                best[done], back[done], piece[done] = best[done - 1] + unknown, done - 1, -1

        at = 0
        for end, (length, score, i) in self.automaton.iter(segment):
            end += 1
            if end != at:
                step(end - 1)
                at = done = end
                best[end] = -math.inf
                single = False
            if length == 1:
                single = True
            total = best[end - length] + score
            if total > best[end] or (total == best[end] and end - length < back[end]):
                best[end], back[end], piece[end] = total, end - length, i
            if not single and (total := best[end - 1] + unknown) > best[end]:
                best[end], back[end], piece[end] = total, end - 1, -1
        step(n)
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.pieces.byte_id[b] for b in reversed(segment[back[n] : n].encode()))
            n = back[n]
        return out[::-1], best[-1]

    def _ids(self, segment: str) -> tuple[int, ...]:
        ids = self.kept.get(segment)
        if ids is None:
            ids = tuple(self.best_path(segment)[0])
            if len(segment) <= LONGEST:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[segment] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.extend(self.literal)
            part = part.replace(" ", MARK)
            if not k:
                part = MARK + part
            for segment in SEGMENT.findall(part) if self.pieces.by_segment else [part] * bool(part):
                out.extend(self._ids(segment))
        return out

    def decode(self, ids: list[int]) -> str:
        plain = self.plain
        return b"".join([plain[i] for i in ids])[1:].decode()


@lru_cache(maxsize=2)
def codec(path: str, scores: str = "zipf") -> Codec:
    return Codec(Pieces(path, scores))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, pieces (array of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(_vocabulary(vocabulary), scores)
        for batch in batches:
            ids = [np.array(own.encode(t), np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "pieces"])

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pieces array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """One row per row: id, text. Null pieces decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(_vocabulary(vocabulary))
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_pieces, n_byte_pieces, pieces_sha256 (of the ids as little-endian 32-bit numbers),
    exact (whether decoding the pieces gives the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(_vocabulary(vocabulary), scores)
        is_byte = np.zeros(len(own.pieces.names), bool)
        is_byte[own.pieces.byte_id] = True
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                text = text or ""
                pieces = own.encode(text)
                ids = np.array(pieces, "<i4")
                for column, value in zip(out, (len(text.encode()), len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), own.decode(pieces) == text), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "n_bytes", "n_pieces", "n_byte_pieces", "pieces_sha256", "exact"])

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_pieces bigint, n_byte_pieces bigint, pieces_sha256 string, exact boolean").withColumnRenamed("id", id_col)
