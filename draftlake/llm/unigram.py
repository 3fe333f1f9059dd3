"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space marker.

The text gets a space in front, spaces become the marker U+2581, and the best-scoring sequence of pieces is chosen
(ties: the longer last piece); a character that no piece covers becomes its UTF-8 bytes' pieces. A marker character in
the text itself is encoded as bytes, so decoding is exact. Where no piece holds two neighbouring characters the best
sequence splits, so texts are cut there and each distinct stretch is segmented once per worker.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows each get their own row;
an empty table gives an empty result; extra columns are ignored by ``encode``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: A character that no piece covers scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of stretches and their ids that a worker remembers, and what an entry takes besides.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 160


class DoubleArrayTrie:
    """Byte strings to values: a child by byte c of node s is base[s] + c if check there is s."""

    def __init__(self, items: dict[bytes, int]):
        root: dict = {}
        for key, value in items.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        self.base, self.check, self.value = [0], [0], [-1]
        self._grow(1 << 16)
        # Nodes with several children go behind all others, lone children fill the gaps from the front.
        gap = tail = 257
        queue = [(root, 0)]
        for node, at in queue:
            self.value[at] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            if len(codes) == 1:
                while self.check[gap] >= 0:
                    gap += 1
                b = gap - codes[0]
            else:
                b = tail - codes[0]
            tail = max(tail, b + codes[-1] + 1)
            self._grow(tail + 512)
            self.base[at] = b
            for c in codes:
                self.check[b + c] = at
                queue.append((node[c], b + c))

    def _grow(self, size: int) -> None:
        if (n := size - len(self.check)) > 0:
            n += len(self.check) // 2
            self.base += [0] * n
            self.check += [-1] * n
            self.value += [-1] * n


@dataclass
class Model:
    """Pieces with log scores. ``tokens[i]``: what piece i decodes to; ``byte_ids[b]``: the piece of byte b."""

    trie: DoubleArrayTrie
    scores: list[float]
    tokens: list[bytes]
    byte_ids: list[int]
    unknown: float
    stretch: str

    def segment(self, stretch: str) -> list[int]:
        """Ids of a stretch in which spaces stand for markers."""
        data = stretch.replace(MARK, "\0").replace(" ", MARK).encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        last = [(0, -1)] * (n + 1)
        s = 0
        while s < n:
            score, node, covered = best[s], 0, False
            lead = data[s]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            for e in range(s, n):
                to = base[node] + data[e]
                if check[to] != node:
                    break
                node = to
                if (piece := value[node]) >= 0:
                    covered |= e + 1 - s == width
                    old = best[e + 1]
                    if old is None or score + scores[piece] > old:
                        best[e + 1], last[e + 1] = score + scores[piece], (s, piece)
            if not covered:
                e = s + width
                if best[e] is None or score + self.unknown > best[e]:
                    best[e], last[e] = score + self.unknown, (s, -1)
            s += 1
            while s < n and best[s] is None:
                s += 1
        out: list[int] = []
        while n:
            s, piece = last[n]
            if piece >= 0:
                out.append(piece)
            else:
                raw = data[s:n] if data[s:n] != b"\0" else MARK.encode()
                out += [self.byte_ids[b] for b in reversed(raw)]
            n = s
        return out[::-1]

    def decode(self, ids) -> bytes:
        out = b"".join([self.tokens[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


def load(path: str) -> Model:
    """Pieces and scores of a SentencePiece model file with byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    trie, scores, tokens, byte_ids, pairs = {}, [], [], [0] * 256, set()
    for i in range(sp.get_piece_size()):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        scores.append(score)
        if sp.is_byte(i):
            tokens.append(bytes([int(piece[1:-1], 16)]))
            byte_ids[tokens[-1][0]] = i
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            tokens.append(b"")
        else:
            tokens.append(piece.replace(MARK, " ").encode())
            trie[piece.encode()] = i
            pairs.update(zip(piece, piece[1:]))
    apart = not any((b == MARK and a != MARK) or "\n" in (a, b) or "\0" in (a, b) for a, b in pairs)
    return Model(DoubleArrayTrie(trie), scores, tokens, byte_ids, min(scores[i] for i in trie.values()) - UNKNOWN_PENALTY, r" *[^ \n\x00]+| +|\n|\x00" if apart else r"(?s).+")


class Encoder:
    """Ids of whole texts as int32 arrays; a stretch is segmented once while the cache, bounded in bytes, holds it."""

    def __init__(self, model: Model):
        self.model, self.stretches, self.known, self.held = model, re.compile(model.stretch).findall, {}, 0

    def _ids(self, stretch: str) -> bytes:
        return np.array(self.model.segment(stretch) if stretch != "\0" else [self.model.byte_ids[0]], "<i4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        known, out = self.known, []
        for p in self.stretches(" " + text):
            ids = known.get(p)
            if ids is None:
                ids = self._ids(p)
                size = ENTRY_BYTES + len(ids) + 4 * len(p)
                if size <= CACHE_BYTES // 8:  # a stretch of a great part of the cache is not worth the others
                    self.held += size
                    if self.held > CACHE_BYTES:
                        known.clear()
                        self.held = size
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


def _path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>)."""
    model = load(_path(path))

    def run(batches):
        enc = Encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([enc(t) for t in b.column(1).to_pylist()])], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; a null list decodes to the empty text, ids without a valid character to U+FFFD."""
    model = load(_path(path))

    def run(batches):
        for b in batches:
            texts = [model.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, how many, how many of bytes, their checksum, and whether they decode to the text."""
    model = load(_path(path))
    schema = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean, ids array<int>"

    def run(batches):
        enc, is_byte = Encoder(model), np.zeros(len(model.tokens), bool)
        is_byte[model.byte_ids] = True
        for b in batches:
            parts, rows = [], []
            for t in b.column(1).to_pylist():
                p = enc(t)
                ids = np.frombuffer(p, "<i4")
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(p), model.decode(ids.tolist()) == t.encode()))
                parts.append(p)
            cols = list(zip(*rows)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, _lists(parts)], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents"))
