"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items are cut into shards of bounded size by their word counts; one automaton is built per shard in the workers, so
what a worker holds is bounded whatever the number of items. Documents are streamed through every automaton in one
pass without a shuffle. Stretches whose neighbouring words never stand together in any item are skipped: no match can
cross them, so the automaton would fall back to nothing there anyway.

Defined results: a null or empty text has no words, hits or items; repeated rows each get their own row; without items
nothing is hit; an item_id that repeats counts once; a null item_id takes part in hits but is not listed; extra columns
are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

WINDOW = 8
#: Words of items that one automaton takes; an automaton has at most twice as many states.
SHARD_WORDS = 200_000
#: Items are sent to the workers within their closure up to so many bytes of text, and else read by them from shards.
INLINE_BYTES = 4 << 20
#: ``remove`` drops a document when hit words reach this share of its words.
MAX_COVERAGE = 0.8

#: Separators become spaces, A-Z lower case; bytes from 0x80 on are word characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several word sequences; for each state, what ends there: items by 8-word window, and short items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]) for i, ws in items if ws]
        self.shortest = min((min(len(s), WINDOW) for _, s in seqs), default=WINDOW)
        for _, s in seqs:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.windows: list[set | None] = [None] * len(self.next)
        self.shorts: list[list | None] = [None] * len(self.next)
        pairs = set()
        for item, s in seqs:
            pairs.update(zip(s, s[1:]))
            state = length = 0
            for c in s:
                state, length = self._step(state, length, c)
                if length >= WINDOW:
                    at = self._holder(state, WINDOW)
                    if self.windows[at] is None:
                        self.windows[at] = set()
                    self.windows[at].add(item)
            if len(s) < WINDOW:
                at = self._holder(state, len(s))
                self.shorts[at] = [*(self.shorts[at] or []), (len(s), item)]
        size = len(self.vocabulary) + 1
        self.size = size
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)
        self.single = np.zeros(size, bool)
        for _, s in seqs:
            if len(s) == 1:
                self.single[s[0]] = True

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item already goes this way
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            length = self.length[state]
        to = nxt[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def _holder(self, state: int, n: int) -> int:
        """The state on the link path whose strings include the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end) over the words and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not len(ids) or not len(self.vocabulary):
            return spans, found
        for a, b in self._stretches(ids):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self._step(state, length, c)
                if length >= WINDOW:
                    at = self._holder(state, WINDOW)
                    if self.windows[at]:
                        spans.append((i + 1 - WINDOW, i + 1))
                        found |= self.windows[at]
                s = state
                while s:
                    for n, item in self.shorts[s] or ():
                        if n <= length:
                            spans.append((i + 1 - n, i + 1))
                            found.add(item)
                    s = self.link[s] if self.shortest < WINDOW else 0
        return spans, found

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of words in which each neighbouring pair stands in some item, if long enough for a window."""
        pair = ids[:-1] * self.size + ids[1:]
        at = np.searchsorted(self.pairs, pair)
        joined = np.zeros(len(ids) + 1, np.int8)  # joined[i]: words i-1 and i stand together in an item
        if len(self.pairs):
            joined[1:-1] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair
        cuts = np.flatnonzero(joined == 0)
        long = np.flatnonzero(np.diff(cuts) >= self.shortest)
        runs = zip(cuts[long].tolist(), cuts[long + 1].tolist())
        return [(a, b) for a, b in runs if b - a > 1 or self.single[ids[a]]]


class Matcher:
    """Automata over all shards of items; a worker builds each shard once and keeps one when there are many."""

    def __init__(self, inline: list[tuple[str | None, bytes]] | None, shards: list[str]):
        self.inline, self.shards = inline, shards
        self._built: dict[int, SuffixAutomaton] = {}

    def automata(self) -> Iterator[SuffixAutomaton]:
        groups = self._cut(self.inline) if self.inline is not None else self.shards
        for k, g in enumerate(groups):
            if k not in self._built:
                items = g if isinstance(g, list) else _read_shard(g)
                if len(self._built) >= 2:
                    self._built.clear()
                self._built[k] = SuffixAutomaton([(i, words_of(t)) for i, t in items])
            yield self._built[k]

    @staticmethod
    def _cut(items: list[tuple[str | None, bytes]]) -> list[list]:
        out, size = [[]], 0
        for i, t in items:
            n = len(t) // 2 + 1
            if size + n > SHARD_WORDS and out[-1]:
                out.append([])
                size = 0
            out[-1].append((i, t))
            size += n
        return out

    def documents(self, texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray, set]]:
        """For each text: its words, which are hit, and the items that occur."""
        split = [words_of(t) for t in texts]
        hit = [np.zeros(len(w) + 1, np.int32) for w in split]
        found: list[set] = [set() for _ in split]
        for a in self.automata():
            get = a.vocabulary.get
            for k, w in enumerate(split):
                ids = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
                spans, items = a.match(ids)
                if spans:
                    s = np.array(spans)
                    np.add.at(hit[k], s[:, 0], 1)
                    np.add.at(hit[k], s[:, 1], -1)
                    found[k] |= items
        return [(w, np.cumsum(h[:-1]) > 0, f) for w, h, f in zip(split, hit, found)]


def _read_shard(uri: str) -> list[tuple[str | None, bytes]]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(uri)
    t = pq.read_table(path, filesystem=fs)
    return list(zip(t["item"].to_pylist(), t["text"].to_pylist()))


def matcher(items: DataFrame) -> Matcher:
    """Small item tables travel in the closure; larger ones are written as shards of bounded size to the shared folder."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= INLINE_BYTES:
        return Matcher([(r["item"], bytes(r["text"])) for r in rows.collect()], [])
    shards = int(size // (SHARD_WORDS * 2)) + 1
    out = written(rows.repartition(shards, "item", "text"), "items")
    return Matcher(None, [f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file://") else f for f in out.inputFiles()])


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])
#: Texts that a worker holds as word lists at once.
CHUNK_BYTES = 4 << 20


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold at most so many bytes, or one text."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: words, hit words, items with occurring windows."""
    m = matcher(items)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows = []
            for x, y in chunks(texts):
                for w, hit, found in m.documents(texts[x:y]):
                    names = sorted(f for f in found if f is not None)
                    rows.append((len(w), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]], names=FOUND.names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, FOUND)


def without_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between neighbouring ones."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, last = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def remove(docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents with all their columns, hit spans taken out of ``text``; those hit beyond the coverage go."""
    m = matcher(items)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(place).cast(pa.binary()).to_pylist()
            out, stay = list(texts), [True] * len(texts)
            for x, y in chunks([t or b"" for t in texts]):
                for k, (w, hit, _) in enumerate(m.documents([t or b"" for t in texts[x:y]]), x):
                    if hit.any():
                        out[k] = without_spans(texts[k], hit)
                        stay[k] = hit.sum() < max_coverage * len(w)
            cols = [pa.array(out, pa.binary()).cast(pa.string()) if i == place else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM
  (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT r, i, g.n, item FROM g JOIN win ON g.n = win.n AND g.k = win.k),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
