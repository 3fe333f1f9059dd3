"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Words are 48-bit hashes. Each batch counts its own word pairs and sends them, packed and sorted, to the shard of the
pair's first word; a shard merges its counts, writes its pairs as a sorted array of 64-bit hashes beside their counts
and its contexts with what their discounts need, and passes on, per second word, tokens and distinct contexts. Those
meet by word and become arrays of the same kind. Discounts come from the counts of counts that the shards report. To
score, a worker maps the arrays it needs and looks up a batch's pairs shard by shard, in sorted order; file pages are
shared and never counted as a worker's own memory. On stores without local files an array is fetched once per worker
into a file that is unlinked as soon as it is mapped.

The order is two: distinct trigrams of the corpora at hand are 1.6 times the distinct pairs and would not fit the
disk that the checks allow (README).

Defined results: a null or empty text is one end token after the start; a null doc_id is never held out; repeated rows
count each time; without training documents every word has the one unknown share, so scores are 0; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written
from .decontaminate import chunks
from .token_records import filesystem

#: Documents whose crc32(doc_id) modulo FOLDS is HELD_OUT are not learned from.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text for each shard, and the least number of shards.
SHARD_BYTES, MIN_SHARDS = 16 << 20, 96
CACHE_WORDS = 300_000
#: Texts counted, and texts scored, at once.
COUNT_BYTES, SCORE_BYTES = 12 << 20, 12 << 20
BITS = 48
START, END = 1, 2  # no word hashes to these but by a chance of 2**-47


class WordHashes(dict):
    """48-bit hashes of words, each computed once while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return h


def token_hashes(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' hashes in a row, each text as start, words, end; and the sizes of the texts."""
    parts = []
    for t in texts:
        words = t.lower().split()
        h = np.empty(len(words) + 2, np.uint64)
        h[0], h[-1] = START, END
        h[1:-1] = np.fromiter((hashes[x] for x in words), np.uint64, len(words))
        parts.append(h)
    return np.concatenate(parts), np.array([len(h) for h in parts], np.int64)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _place(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a word; by the hash's size, so that sorted words are sorted by shard."""
    return ((h >> np.uint64(BITS - 24)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _six(h: np.ndarray) -> bytes:
    """The six low bytes of each, plane by plane: sorted hashes then compress well."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    n = len(data) // 6
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, n).T
    return out.view("<u8").ravel()


def _counted(docs: DataFrame, shards: int) -> DataFrame:
    """(place, a, b, n): each batch's distinct pairs of a shard, packed."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for x, y in chunks(texts, COUNT_BYTES):
                h, sizes = token_hashes(texts[x:y], hashes)
                inner = np.ones(len(h), bool)
                inner[np.cumsum(sizes) - 1] = False
                at = np.flatnonzero(inner)
                a, b = h[at], h[at + 1]
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = _runs(a, b)
                n = np.diff(np.r_[first, len(a)]).astype("<u4")
                a, b = a[first], b[first]
                bounds = np.searchsorted(_place(a, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(bounds))
                cuts = [(bounds[s], bounds[s + 1]) for s in some.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int64()), pa.array([_six(a[i:j]) for i, j in cuts], pa.binary()),
                    pa.array([_six(b[i:j]) for i, j in cuts], pa.binary()), pa.array([n[i:j].tobytes() for i, j in cuts], pa.binary()),
                ], names=["place", "a", "b", "n"])

    return docs.mapInArrow(run, "place long, a binary, b binary, n binary")


def _save(folder: str, name: str, **arrays: np.ndarray) -> str:
    """Writes a shard's arrays as plain files of this attempt; returns their common path."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    base = f"{name}-{uuid.uuid4().hex}"
    for k, v in arrays.items():
        with fs.open_output_stream(f"{path}/{base}.{k}") as f:
            f.write(np.ascontiguousarray(v).tobytes())
    return f"{folder.rstrip('/')}/{base}"


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]


_PART = "kind string, place long, path string, stats array<long>, h binary, n binary, contexts binary"


def _part(kind: str, place: int, path: str | None = None, stats: list[int] | None = None) -> dict:
    return {"kind": kind, "place": place, "path": path, "stats": stats, "h": None, "n": None, "contexts": None}


_SCHEMA = pa.schema([("kind", pa.string()), ("place", pa.int64()), ("path", pa.string()), ("stats", pa.list_(pa.int64())), ("h", pa.binary()), ("n", pa.binary()), ("contexts", pa.binary())])


def _merged_pairs(counted: DataFrame, shards: int, folder: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        a, b = (np.concatenate([_from_six(x) for x in t[c].to_pylist()]) for c in ("a", "b"))
        n = np.frombuffer(b"".join(t["n"].to_pylist()), "<u4").astype(np.int64)
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = _runs(a, b)
        a, b, n = a[first], b[first], np.add.reduceat(n, first)
        context = _runs(a)
        keys = _pair_key(a, b)
        by_key = np.argsort(keys)
        few = [np.add.reduceat((n == k).astype(np.int64), context) for k in (1, 2)]
        many = np.add.reduceat((n >= 3).astype(np.int64), context)
        place = int(t["place"][0].as_py())
        path = _save(folder, f"pairs-{place:06d}", keys=keys[by_key], counts=np.minimum(n[by_key], 0xFFFFFFFF).astype("<u4"), contexts=a[context], totals=np.add.reduceat(n, context), ones=few[0].astype("<u4"), twos=few[1].astype("<u4"), more=many.astype("<u4"))
        rows = [_part("pairs", place, path, _counts_of_counts(n))]
        order = np.argsort(b, kind="stable")
        b, n = b[order], n[order]
        word = _runs(b)
        tokens, contexts, b = np.add.reduceat(n, word), np.diff(np.r_[word, len(b)]), b[word]
        bounds = np.searchsorted(_place(b, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[s], bounds[s + 1]
            rows.append(_part("words", s) | {"h": _six(b[i:j]), "n": tokens[i:j].astype("<i8").tobytes(), "contexts": contexts[i:j].astype("<u4").tobytes()})
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return counted.groupBy("place").applyInArrow(run, _PART)


def _merged_words(parts: DataFrame, folder: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        h = np.concatenate([_from_six(x) for x in t["h"].to_pylist()])
        n = np.frombuffer(b"".join(t["n"].to_pylist()), "<i8")
        contexts = np.frombuffer(b"".join(t["contexts"].to_pylist()), "<u4").astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n, contexts = h[order], n[order], contexts[order]
        first = _runs(h)
        n, contexts = np.add.reduceat(n, first), np.add.reduceat(contexts, first)
        place = int(t["place"][0].as_py())
        path = _save(folder, f"words-{place:06d}", words=h[first], tokens=n, preceding=contexts.astype("<u4"))
        return pa.Table.from_pylist([_part("words", place, path, [*_counts_of_counts(contexts), len(first), int(n.sum()), int(contexts.sum())])], schema=_SCHEMA)

    return parts.where("kind = 'words'").groupBy("place").applyInArrow(run, _PART)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of one, two, and three or more; where the counts of counts are too few, a half of each."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass
class Model:
    """Where each shard's arrays are, and the numbers that hold for all."""

    shards: int
    pairs: dict[int, str]
    words: dict[int, str]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    tokens: int
    vocabulary: int
    pair_types: int
    spread: float

    def lower(self, preceding: np.ndarray) -> np.ndarray:
        """Probability of a word from the number of distinct words before it."""
        if not self.pair_types:
            return np.full(len(preceding), 1.0 / (self.vocabulary + 1))
        d = np.array([0.0, *self.word_discounts])[np.minimum(preceding, 3)]
        return np.maximum(preceding - d, 0) / self.pair_types + self.spread / (self.vocabulary + 1)


def train(docs: DataFrame) -> Model:
    """docs: text as bytes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(MIN_SHARDS, int(size // SHARD_BYTES))
    folder = new_path(spark, "model")
    parts = written(_merged_pairs(_counted(docs, shards), shards, folder), "parts")
    pairs = parts.where("kind = 'pairs'").select("place", "path", "stats").collect()
    words = _merged_words(parts, folder).select("place", "path", "stats").collect()
    of_pairs = [sum(r["stats"][k] for r in pairs) for k in range(5)]
    of_words = [sum(r["stats"][k] for r in words) for k in range(8)]
    d = discounts(*of_words[:4])
    spread = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[4]) / of_words[7] if of_words[7] else 1.0
    return Model(shards, {r["place"]: r["path"] for r in pairs}, {r["place"]: r["path"] for r in words}, discounts(*of_pairs[:4]), d, of_words[6], of_words[5], of_words[7], spread)


class Arrays:
    """A worker's mapped arrays."""

    def __init__(self):
        self.open: dict[str, np.ndarray] = {}

    def __call__(self, path: str, name: str, kind: str) -> np.ndarray:
        uri = f"{path}.{name}"
        if uri not in self.open:
            fs, local = filesystem(uri)
            if fs.type_name == "local":
                self.open[uri] = np.memmap(local, kind, "r") if os.path.getsize(local) else np.zeros(0, kind)
            else:
                with tempfile.NamedTemporaryFile() as f, fs.open_input_stream(local) as source:
                    while block := source.read(1 << 22):
                        f.write(block)
                    f.flush()
                    self.open[uri] = np.memmap(f.name, kind, "r") if f.tell() else np.zeros(0, kind)
        return self.open[uri]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _word_counts(m: Model, arrays: Arrays, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct preceding words of sorted distinct hashes."""
    tokens, preceding = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    bounds = np.searchsorted(_place(h, m.shards), np.arange(m.shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        if path := m.words.get(s):
            i, j = bounds[s], bounds[s + 1]
            at, there = _find(arrays(path, "words", "<u8"), h[i:j])
            tokens[i:j][there] = arrays(path, "tokens", "<i8")[at[there]]
            preceding[i:j][there] = arrays(path, "preceding", "<u4")[at[there]]
    return tokens, preceding


def _conditional(m: Model, arrays: Arrays, a: np.ndarray, b: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """p(b | a) of pairs sorted by a, given the lower order's probability of b."""
    out = lower.copy()
    d = np.array([0.0, *m.pair_discounts])
    bounds = np.searchsorted(_place(a, m.shards), np.arange(m.shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        if path := m.pairs.get(s):
            i, j = bounds[s], bounds[s + 1]
            at, known = _find(arrays(path, "contexts", "<u8"), a[i:j])
            at = at[known]
            total = arrays(path, "totals", "<i8")[at]
            back = (d[1] * arrays(path, "ones", "<u4")[at] + d[2] * arrays(path, "twos", "<u4")[at] + d[3] * arrays(path, "more", "<u4")[at]) / total
            keys = _pair_key(a[i:j][known], b[i:j][known])
            order = np.argsort(keys)
            place, there = _find(arrays(path, "keys", "<u8"), keys[order])
            n = np.zeros(len(keys), np.int64)
            n[order[there]] = arrays(path, "counts", "<u4")[place[there]]
            own = np.maximum(n - d[np.minimum(n, 3)], 0) / total
            out[i:j][known] = own + back * out[i:j][known]
    return out


def score_texts(m: Model, arrays: Arrays, hashes: WordHashes, texts: list[bytes]) -> list[np.ndarray]:
    """Per text: tokens, known tokens, base score and score."""
    h, sizes = token_hashes(texts, hashes)
    ends = np.cumsum(sizes)
    token = np.ones(len(h), bool)
    token[ends - sizes] = False
    at = np.flatnonzero(token)
    starts = np.r_[0, np.cumsum(sizes - 1)[:-1]]
    words, of = np.unique(h[at], return_inverse=True)
    tokens, preceding = _word_counts(m, arrays, words)
    lower = m.lower(preceding)[of]
    order = np.argsort(h[at - 1], kind="stable")
    p = np.empty(len(at))
    p[order] = _conditional(m, arrays, h[at - 1][order], h[at][order], lower[order])
    base = np.log10((tokens + 1) / (m.tokens + 1 * (m.vocabulary + 1)))[of]
    known = (tokens > 0).astype(np.int64)[of]
    return [sizes - 1, np.add.reduceat(known, starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, held_out, tokens, known tokens, both scores; docs: doc_id, held_out, text as bytes."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        hashes, arrays = WordHashes(), Arrays()
        for b in batches:
            texts = b.column(2).to_pylist()
            for x, y in chunks(texts, SCORE_BYTES):
                n, known, base, own = score_texts(m, arrays, hashes, texts[x:y])
                ids, held = b.column(0).slice(x, y - x), b.column(1).slice(x, y - x)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(n), pa.array(known), pa.array(np.full(y - x, m.tokens)), pa.array(base), pa.array(own)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, schema)


def prepared(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(table(spark, sf_dir, "documents"))
    return score(docs, train(docs.where(~F.col("held_out")).select("text")))
