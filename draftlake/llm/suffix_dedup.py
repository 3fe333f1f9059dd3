"""Removes repeated 100-byte strings across documents with suffix arrays over shards.

A shard must hold every string that could equal another one in it, without holding the corpus. Each window of 100 bytes
is filed under its minimizer: the gram of GRAM bytes inside it with the smallest hash. Equal windows have equal
minimizers, so shards by minimizer never split equal windows. Neighbouring windows under one minimizer form a segment;
equal segments are copies as a whole: of these all but the first are removed without another look, already inside
each batch before anything is shuffled, which is what keeps hot passages from meeting in one task. Where one minimizer
has segments that differ, the first copies' bytes go to the minimizer's shard, where suffix arrays over a bounded share
of its minimizers are induced; windows are equal where neighbours in the array share 100 bytes, and all but the first of those are removed. A minimizer with
more than HOT_BYTES of such segments (a short phrase in very many contexts) is divided first, by the minimizers that
other hash functions choose in each window; equal windows agree in these as well.

Order is by doc_id, then start. Defined results: a null or empty text has no bytes; null doc_ids come first; rows that
repeat both doc_id and text count as one document and get the same result each; rows that repeat only the doc_id are
ordered by a hash of their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .suffix_sort import permuted_lcp, suffix_array

WINDOW = 100
GRAM = 24
#: Text that a worker looks at once; longer texts are looked at in overlapping pieces.
PIECE = 1 << 18
#: Bytes of text for each shard, and the least number of shards.
SHARD_BYTES, MIN_SHARDS = 16 << 20, 96
#: Bytes of one minimizer's segments that stay together; for each HOT_FACTOR times as much one more minimizer divides them.
HOT_BYTES, HOT_FACTOR = 2 << 20, 64
#: Bytes of segments in one suffix array; a minimizer with more of them is divided in its task, by so many further ones at most.
SORT_BYTES, MAX_DIVISIONS = 1 << 19, 4
#: Windows whose digests are compared at once.
SINGLE_WINDOWS = 1 << 20
#: The longest segment: a minimizer's windows reach over so many starts.
_REACH = WINDOW - GRAM + 1
_NONE = -(1 << 63)

_OCC = np.dtype([("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("len", "<u2")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Polynomial hashes mod 2**64 of any stretch of a piece, for two independent bases."""

    def __init__(self, size: int = PIECE + 2 * WINDOW):
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.powers = []
        for base in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
            up = np.full(size + 1, base, np.uint64)
            down = np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[which][0][: len(data)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
        return _mix((sums[b] - sums[a]) * self.powers[which][1][a])


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (parts of) texts: bytes, and per part its text's number, place in the run and offset in the text."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        starts = np.cumsum([0, *(len(p[2]) for p in parts)])
        return b"".join(p[2] for p in parts), np.array([p[0] for p in parts]), starts, np.array([p[1] for p in parts], np.int64)

    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1]
            if parts and size + len(part) > PIECE + WINDOW - 1:
                yield flush()
                parts, size = [], 0
            parts.append((k, at, part))
            size += len(part)
    if parts:
        yield flush()


def segments(texts: list[bytes], hasher: Hasher, choice: int = 0) -> np.ndarray:
    """All segments: minimizer, digest of the bytes, number of the text (as doc), start and length; each choice orders the grams by another hash."""
    out = []
    for data, which, starts, offsets in _pieces(texts):
        raw = np.frombuffer(data, np.uint8)
        sums = hasher.sums(raw, 0)
        grams = hasher.stretch(sums, np.arange(len(raw) - GRAM + 1), np.arange(GRAM, len(raw) + 1), 0)
        if choice:
            grams = _mix(grams + np.uint64(choice * 0x9E3779B97F4A7C15 % (1 << 64)))
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= _REACH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < _REACH:
            d = _REACH - span
            least = np.minimum(least[:-d], least[d:])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window start in the run
        part = np.repeat(np.arange(len(which)), np.diff(starts))[: len(at)]
        inside = np.arange(len(at)) + WINDOW <= starts[part + 1]
        new = np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)]
        ok = inside[first]
        first, last = first[ok], last[ok]
        end = last - 1 + WINDOW
        own = hasher.sums(raw, 1)
        rows = np.zeros(len(first), _OCC)
        rows["key"] = grams[at[first]]
        rows["seg"] = hasher.stretch(own, first, end, 1) ^ _mix(((at[first] - first) * 1024 + end - first).astype(np.uint64))
        rows["doc"] = which[part[first]]
        rows["pos"] = first - starts[part[first]] + offsets[part[first]]
        rows["len"] = end - first
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, _OCC)


def _firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by minimizer, segment and place; whether each is the first of its segment. Repeated places go."""
    x = x[np.lexsort((x["pos"], x["tag"], x["doc"], x["seg"], x["key"]))]
    same = (x["key"][1:] == x["key"][:-1]) & (x["seg"][1:] == x["seg"][:-1])
    again = same & (x["doc"][1:] == x["doc"][:-1]) & (x["tag"][1:] == x["tag"][:-1]) & (x["pos"][1:] == x["pos"][:-1])
    stay = np.r_[True, ~again][: len(x)]
    first = np.r_[True, ~same][: len(x)]
    return x[stay], first[stay]


def _cut_rows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list, list]:
    """Per document the removed stretches, merged and packed as pairs of u32."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return [], [], []
    group = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    shift = group * (1 << 33)
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, (start[1:] + shift[1:]) > reach[:-1]]
    a = np.flatnonzero(new)
    pairs = np.stack((start[a], reach[np.r_[a[1:], len(doc)] - 1] - shift[a]), 1).astype("<u4")
    g = group[a]
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    ends = np.r_[cut[1:], len(a)]
    return doc[a][cut].tolist(), tag[a][cut].tolist(), [pairs[i:j].tobytes() for i, j in zip(cut.tolist(), ends.tolist())]


def _batch(kind: str, cols: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(cols[0]), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["kind", "doc", "tag", "rows"])


_FOUND = "kind string, doc long, tag long, rows binary"
_ASK = np.dtype([("pos", "<u4"), ("len", "<u2"), ("key", "<u8"), ("more", "u1")])


def filed(docs: DataFrame, shards: int) -> DataFrame:
    """(place, rows): per batch and shard the first occurrence of each segment; rows with a document are cuts of the other occurrences."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            x = segments(b.column(2).to_pylist(), hasher)
            which = x["doc"]
            x["tag"] = b.column(1).to_numpy()[which]
            x["doc"] = b.column(0).to_numpy()[which]
            x, first = _firsts(x)
            gone = x[~first]
            doc, tag, cuts = _cut_rows(gone["doc"], gone["tag"], gone["pos"], gone["pos"].astype(np.int64) + gone["len"])
            x = x[first]
            place = (x["key"] % np.uint64(shards)).astype(np.int64)
            x = x[order := np.argsort(place, kind="stable")]
            bounds = np.searchsorted(place[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(bounds))
            # Cuts of a batch travel by document, so that they spread over the shards as well.
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[some, np.array(doc, np.int64) % shards if doc else np.zeros(0, np.int64)].astype(np.int64)),
                pa.array([*[None] * len(some), *doc], pa.int64()), pa.array([*[None] * len(some), *tag], pa.int64()),
                pa.array([*[x[bounds[s] : bounds[s + 1]].tobytes() for s in some.tolist()], *cuts], pa.binary()),
            ], names=["place", "doc", "tag", "rows"])

    return docs.mapInArrow(run, "place long, doc long, tag long, rows binary")


def compared(filed_rows: DataFrame) -> DataFrame:
    """Cuts of copied segments, and (kind ask) the first copies of segments that share a minimizer with others."""

    def run(t: pa.Table) -> pa.Table:
        is_cut = pc.is_valid(t["tag"])
        passed = t.filter(is_cut)
        own = t.filter(pc.invert(is_cut))
        x, first = _firsts(np.frombuffer(b"".join(own["rows"].to_pylist()), _OCC))
        gone, x = x[~first], x[first]
        cuts = _cut_rows(gone["doc"], gone["tag"], gone["pos"], gone["pos"].astype(np.int64) + gone["len"])
        beside = np.r_[False, x["key"][1:] == x["key"][:-1]][: len(x)]
        shared = beside | np.r_[beside[1:], False][: len(x)]
        x = x[shared]
        runs = np.flatnonzero(np.r_[True, x["key"][1:] != x["key"][:-1]][: len(x)])
        volume = np.add.reduceat(x["len"].astype(np.int64), runs) if len(x) else np.zeros(0, np.int64)
        more = np.ceil(np.log(np.maximum(volume / HOT_BYTES, 1)) / np.log(HOT_FACTOR)).astype(np.uint8)
        x, more = x[order := np.lexsort((x["pos"], x["tag"], x["doc"]))], np.repeat(more, np.diff(np.r_[runs, len(x)]))[order]
        edge = np.flatnonzero(np.r_[True, (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1])][: len(x)])
        packed = np.zeros(len(x), _ASK)
        for c in ("pos", "len", "key"):
            packed[c] = x[c]
        packed["more"] = more
        asks = (x["doc"][edge].tolist(), x["tag"][edge].tolist(), [packed[i:j].tobytes() for i, j in zip(edge.tolist(), np.r_[edge[1:], len(x)].tolist())])
        through = (passed["doc"].to_pylist(), passed["tag"].to_pylist(), passed["rows"].to_pylist())
        return pa.Table.from_batches([_batch("cut", cuts), _batch("ask", asks), _batch("cut", through)])

    return filed_rows.groupBy("place").applyInArrow(run, _FOUND)


_HEAD = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("len", "<u2"), ("key", "<u8")])


def divided(heads: np.ndarray, texts: list[bytes], more: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, list[bytes]]:
    """Segments of hot minimizers divided by as many further ones as ``more`` says, the others as they are."""
    for choice in range(1, int(more.max(initial=0)) + 1):
        hot = more >= choice
        at = np.flatnonzero(hot)
        x = segments([texts[i] for i in at.tolist()], hasher, choice)
        own = at[x["doc"]]
        h = heads[own]
        h["pos"] += x["pos"]
        h["len"] = x["len"]
        h["key"] = _mix(h["key"] ^ _mix(x["key"]))
        parts = [texts[i][p : p + n] for i, p, n in zip(own.tolist(), x["pos"].tolist(), x["len"].tolist())]
        rest = np.flatnonzero(~hot)
        heads, texts, more = np.concatenate((heads[rest], h)), [texts[i] for i in rest.tolist()] + parts, np.r_[more[rest], more[own]]
    return heads, texts


def fetched(docs: DataFrame, asks: DataFrame, shards: int) -> DataFrame:
    """(place, heads, bytes): the asked segments, packed per batch and shard."""
    wanted = asks.groupBy("doc", "tag").agg(F.collect_list("rows").alias("asks"))

    def run(batches):
        hasher = Hasher()
        for b in batches:
            heads, texts, more = [], [], []
            for doc, tag, text, rows in zip(*[b.column(i).to_pylist() for i in range(4)]):
                x = np.frombuffer(b"".join(rows), _ASK)
                h = np.zeros(len(x), _HEAD)
                h["doc"], h["tag"] = doc, tag
                for c in ("pos", "len", "key"):
                    h[c] = x[c]
                heads.append(h)
                more.append(x["more"])
                texts += [text[p : p + n] for p, n in zip(x["pos"].tolist(), x["len"].tolist())]
            if not heads:
                continue
            h, texts = divided(np.concatenate(heads), texts, np.concatenate(more), hasher)
            place = (h["key"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(bounds)).tolist()
            groups = [order[bounds[s] : bounds[s + 1]] for s in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int64()), pa.array([h[g].tobytes() for g in groups], pa.binary()),
                pa.array([b"".join([texts[i] for i in g.tolist()]) for g in groups], pa.binary()),
            ], names=["place", "heads", "bytes"])

    return docs.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "asks").mapInArrow(run, "place long, heads binary, bytes binary")


def repeated_windows(heads: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, start) of windows that an earlier window equals, over the suffix array of the segments."""
    # An end mark after each segment; marks may equal text bytes, as windows must end inside their segment anyway.
    size = heads["len"].astype(np.int64)
    starts = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.uint8)
    seg = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(text)) - starts[seg]
    text[offset < size[seg]] = np.frombuffer(data, np.uint8)
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa, starts, 4 * WINDOW)
    alike = np.cumsum(lcp[sa] < WINDOW)
    whole = (offset + WINDOW <= size[seg])[sa]
    at, group = sa[whole], alike[whole]
    doc, tag, place = heads["doc"][seg[at]], heads["tag"][seg[at]], heads["pos"][seg[at]].astype(np.int64) + offset[at]
    order = np.lexsort((place, tag, doc, group))
    group, doc, tag, place = group[order], doc[order], tag[order], place[order]
    first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]][: len(group)], np.arange(len(group)), 0))
    # Repeated rows bring one place several times; it is not later than itself.
    later = (doc != doc[first]) | (tag != tag[first]) | (place != place[first])
    return doc[later], tag[later], place[later]


def _bounded(heads: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of segments, whole minimizers together, of at most SORT_BYTES unless one minimizer has more."""
    order = np.argsort(heads["key"], kind="stable")
    key = heads["key"][order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    ends = np.r_[first[1:], len(key)]
    upto = np.cumsum(heads["len"][order].astype(np.int64))[ends - 1] if len(key) else first
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SORT_BYTES, "right")))
        yield order[first[a] : ends[b - 1]]
        a = b


def _copies(key: np.ndarray, seg: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of equal segments, and of their copies elsewhere."""
    order = np.lexsort((heads["pos"], heads["tag"], heads["doc"], seg, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (seg[order][1:] != seg[order][:-1])][: len(order)]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (heads["doc"][order] != heads["doc"][first]) | (heads["tag"][order] != heads["tag"][first]) | (heads["pos"][order] != heads["pos"][first])
    return order[new], order[later]


def _cuts_of(heads: np.ndarray) -> tuple[list, list, list]:
    return _cut_rows(heads["doc"], heads["tag"], heads["pos"], heads["pos"].astype(np.int64) + heads["len"])


def _single_windows(heads: np.ndarray, texts: list[bytes], hasher: Hasher) -> Iterator[tuple[list, list, list]]:
    """Cuts of segments taken as windows of their own, equal as a whole or not at all; a share of the digests at a time."""
    turns = np.uint64(-(-int((heads["len"].astype(np.int64) - WINDOW + 1).sum()) // SINGLE_WINDOWS))
    for turn in range(int(turns)):
        keys, segs, rows = [], [], []
        for data, which, starts, offsets in _pieces(texts):
            raw = np.frombuffer(data, np.uint8)
            at = np.arange(len(raw) - WINDOW + 1)
            part = np.repeat(np.arange(len(which)), np.diff(starts))[: len(at)]
            inside = at + WINDOW <= starts[part + 1]
            at, part = at[inside], part[inside]
            key = hasher.stretch(hasher.sums(raw, 0), at, at + WINDOW, 0)
            own = key % turns == np.uint64(turn)
            at, part, key = at[own], part[own], key[own]
            h = heads[which[part]]
            h["pos"] += (at - starts[part] + offsets[part]).astype(np.uint32)
            h["len"] = WINDOW
            keys.append(key)
            segs.append(hasher.stretch(hasher.sums(raw, 1), at, at + WINDOW, 1))
            rows.append(h)
        h = np.concatenate(rows)
        yield _cuts_of(h[_copies(np.concatenate(keys), np.concatenate(segs), h)[1]])


def shard_cuts(heads: np.ndarray, data: bytes, hasher: Hasher | None = None, division: int = 0) -> Iterator[tuple[list, list, list]]:
    """Cuts of a shard's segments, from one suffix array for each SORT_BYTES of them.

    A minimizer with more is divided by further ones; segments that are equal then go as copies. What MAX_DIVISIONS
    leave together is divided to single windows.
    """
    size = heads["len"].astype(np.int64)
    starts = np.cumsum(size) - size
    for part in _bounded(heads):
        h = heads[part]
        texts = [data[a : a + n] for a, n in zip(starts[part].tolist(), h["len"].tolist())]
        if len(part) < 2 or size[part].sum() <= SORT_BYTES:
            doc, tag, start = repeated_windows(h, b"".join(texts))
            yield _cut_rows(doc, tag, start, start + WINDOW)
            continue
        hasher = hasher or Hasher()
        if division == MAX_DIVISIONS:
            yield from _single_windows(h, texts, hasher)
            continue
        x = segments(texts, hasher, 100 + division)
        own = x["doc"]
        h = h[own]
        h["pos"] += x["pos"]
        h["len"] = x["len"]
        h["key"] = _mix(h["key"] ^ _mix(x["key"]))
        stay, gone = _copies(h["key"], x["seg"], h)
        yield _cuts_of(h[gone])
        parts = [texts[i][p : p + n] for i, p, n in zip(own[stay].tolist(), x["pos"][stay].tolist(), x["len"][stay].tolist())]
        yield from shard_cuts(h[stay], b"".join(parts), hasher, division + 1)


def sorted_shards(segments_of_shards: DataFrame) -> DataFrame:
    """Cuts from each shard's suffix arrays."""

    def run(t: pa.Table) -> pa.Table:
        heads = np.frombuffer(b"".join(t["heads"].to_pylist()), _HEAD)
        return pa.Table.from_batches([_batch("cut", c) for c in shard_cuts(heads, b"".join(t["bytes"].to_pylist()))])

    return segments_of_shards.groupBy("place").applyInArrow(run, _FOUND)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc (null ids first of all), tag (of the text) and text as bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("tag"), text.alias("text"), *more)


def cuts(docs: DataFrame) -> DataFrame:
    """(doc, tag, rows): removed stretches of documents, packed; a document may have several rows, which overlap."""
    rows = _keyed(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(MIN_SHARDS, int(size // SHARD_BYTES))
    found = written(compared(filed(rows, shards)), "found")
    asks = found.where("kind = 'ask'")
    sorted_cuts = sorted_shards(fetched(rows, asks, shards))
    return written(found.where("kind = 'cut'").unionByName(sorted_cuts).select("doc", "tag", "rows"), "cuts")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, the remaining bytes, and how many bytes there were, went, and in how many stretches."""
    gone = cuts(docs).groupBy("doc", "tag").agg(F.collect_list("rows").alias("cuts"))

    def run(batches):
        for b in batches:
            rows = []
            for text, packs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, spans, removed = text, 0, 0
                if packs:
                    x = np.frombuffer(b"".join(packs), "<u4").reshape(-1, 2)
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, x[:, 0], 1)
                    np.add.at(edge, x[:, 1], -1)
                    out = np.cumsum(edge[:-1]) > 0
                    spans, removed = int(np.count_nonzero(np.diff(np.r_[False, out].astype(np.int8)) == 1)), int(out.sum())
                    kept = np.frombuffer(text, np.uint8)[~out].tobytes()
                rows.append((len(text), removed, spans, kept))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(gone, ["doc", "tag"], "left")
    return rows.select("doc_id", "text", "cuts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
