"""MinHash near-duplicates with tensored banding, candidates verified on full shingle sets.

Two collections of M sketches, each of R hashes, are computed per document; every pair of a sketch from the one and a
sketch from the other is a table key, so M*M tables of 2R rows cost only 2*M*R hashes. A linked pair at the threshold
of 0.75 meets in no table with a chance of about 1e-4, at 0.8 of 1e-5.

Documents with one shingle set are one node from the start. A bucket never emits its pairs: its members are compared
with a hub, first the smallest node, then the one with most links. Buckets whose members are still in several
components after that join these components to a neighbourhood, and a neighbourhood's members are compared on their
full sets where they meet, in blocks of bounded size; only links that join components leave a task. Members whose own
shingles rule every link out are dropped there first. So hubs only save work; no candidate is lost to them.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; rows of one doc_id with
different texts are linked through their id; a row without doc_id is linked like any other, its component is the
smallest doc_id reachable, null if there is none, and it is kept only if that is null; an empty table gives an empty
result; extra columns are ignored by ``classes`` and kept by ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written
from .components import components
from .decontaminate import chunks

SHINGLE = 5
THRESHOLD = 75
M, R = 12, 2
#: Documents whose keys of one table meet in one group.
GROUP_DOCS = 100_000
#: Documents whose keys a worker packs at once.
PACK_DOCS = 10_000
#: Pairs of one hub that meet its set in one place.
HUB_PAIRS = 2_000
#: Sets of one neighbourhood that are compared in one block.
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 600_000

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, each computed once while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((hashes[x] for w in words for x in w), np.uint64, sum(sizes))
    k = np.uint64(0xD6E8FEB86659FD93)
    grams = flat
    n = max(0, len(flat) - SHINGLE + 1)
    if n:
        grams = flat[:n].copy()
        for i in range(1, SHINGLE):
            grams = grams * k + flat[i : i + n]
        grams = _mix(grams)
    out, at = [], 0
    for size in sizes:
        if size >= SHINGLE:
            out.append(np.unique(grams[at : at + size - SHINGLE + 1]))
        else:
            whole = xxhash.xxh3_64_intdigest(flat[at : at + size].tobytes(), seed=size)
            out.append(np.array([whole] if size else [], np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 2*M*R) minimum hashes as u32; empty sets have the largest value throughout."""
    out = np.full((len(sets), 2 * M * R), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for j, a in enumerate(_constants(2 * M * R, 0xA24BAED4963EE407)):
            out[full, j] = np.minimum.reduceat(((flat * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def table_keys(sigs: np.ndarray) -> np.ndarray:
    """(documents, M*M) keys: each sketch of the first collection with each of the second."""
    s = sigs.astype(np.uint64).reshape(len(sigs), 2, M, R)
    sketch = np.zeros((len(sigs), 2, M), np.uint64)
    for r in range(R):
        sketch = _mix(sketch + s[:, :, :, r] + np.uint64(r + 1))
    tables = np.arange(M * M, dtype=np.uint64).reshape(M, M)
    return _mix(sketch[:, 0, :, None] * np.uint64(0x9FB21C651E98DF25) + sketch[:, 1, None, :] + tables).reshape(len(sigs), M * M)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles, mark (digest of the set) and signature."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = b.column(2).to_pylist()
            for x, y in chunks(texts):
                sets = shingle_sets(texts[x:y], hashes)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ], names=["doc_id", "digest", "n_shingles", "mark", "sig"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, digest binary, n_shingles long, mark binary, sig binary")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


#: A node's row in a bucket; component and links are known from the second round on.
_FIRST = np.dtype([("key", "<u4"), ("node", "<i8"), ("n", "<i4")])
_LATER = np.dtype([*_FIRST.descr, ("comp", "<i8"), ("deg", "<i4")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("ok", "?")])


def _paired(x: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's hub, and the pairs of hub and member; ok says whether the sizes allow a link.

    ``first``: the hub is the smallest node. ``later``: the one with most links; only pairs across components.
    ``apart``: components instead of nodes, beside the bucket's smallest.
    """
    within = (x["node"],) if kind == "first" else (x["node"], -x["deg"]) if kind == "later" else (x["comp"],)
    x = x[np.lexsort((*within, x["key"]))]
    first = np.flatnonzero(np.r_[True, x["key"][1:] != x["key"][:-1]]) if len(x) else np.zeros(0, np.int64)
    hub = x[np.repeat(first, np.diff(np.r_[first, len(x)]))]
    name = "comp" if kind == "apart" else "node"
    ok = _sizes_allow(x["n"], hub["n"])
    other = x["node"] != hub["node"] if kind == "first" else x["comp"] != hub["comp"]
    if kind == "later":
        other &= ok
    out = np.zeros(int(other.sum()), _PAIR)
    out["a"], out["b"], out["ok"] = hub[name][other], x[name][other], ok[other] | (kind == "apart")
    return x[first], out


def _bucketed(nodes: DataFrame, parts: int, kind: str) -> DataFrame:
    """Distinct pairs (a, b, ok) of the buckets of nodes (sig, node, n, ...).

    A worker pairs the members it holds with their bucket's hub there and passes on the hubs alone, packed by table and
    part, so a bucket of any size meets in one place with at most one row from each worker's batch.
    """
    dtype = _FIRST if kind == "first" else _LATER

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        keys = table_keys(np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(t.num_rows, -1))
        rows = np.zeros(t.num_rows, dtype)
        for c in dtype.names[1:]:
            rows[c] = t[c].to_numpy()
        place, packs, pairs = [], [], []
        for k in range(keys.shape[1]):
            part = (keys[:, k] % np.uint64(parts)).astype(np.int64)
            rows["key"] = keys[:, k] >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                hubs, own = _paired(rows[order[x:y]], kind)
                place.append(k * parts + int(part[order[x]]))
                packs.append(hubs.tobytes())
                pairs.append(own)
        place.append(-1 - int(rows["node"].min()))  # a place of its own for the pairs
        packs.append(np.unique(np.concatenate(pairs)).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(packs, pa.binary())], names=["place", "rows"])

    def packed(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PACK_DOCS:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    def run(t: pa.Table) -> pa.Table:
        rows = b"".join(t["rows"].to_pylist())
        out = np.frombuffer(rows, _PAIR) if t["place"][0].as_py() < 0 else np.unique(_paired(np.frombuffer(rows, dtype), kind)[1])
        return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "ok": pa.array(out["ok"], pa.bool_())})

    return nodes.select("sig", *dtype.names[1:]).mapInArrow(packed, "place long, rows binary").groupBy("place").applyInArrow(run, "a long, b long, ok boolean").distinct()


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= THRESHOLD * np.maximum(a, b).astype(np.int64)


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, elements): the packed shingle set of each rep (node, doc, digest)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc", _digest(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("text"))
    r = reps.select("node", F.col("doc").alias("r_doc"), F.col("digest").alias("r_digest"))

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in chunks(texts):
                packed = [s.tobytes() for s in shingle_sets(texts[x:y], hashes)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(packed, pa.binary())], names=["node", "elements"])

    joined = rows.join(r, F.col("digest").eqNullSafe(F.col("r_digest")) & F.col("doc").eqNullSafe(F.col("r_doc"))).select("node", "text")
    return joined.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def _linked(u: np.ndarray, v: np.ndarray) -> bool:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(u) + len(v) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs (hub, member) that are links on their full sets; a hub's set is copied as its pairs need."""
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("fan"))
    salted = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).alias("salt"))
    hubs = fan.join(sets.toDF("a", "ea"), "a").select("a", "ea", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("salt"))
    joined = salted.join(sets.toDF("b", "eb"), "b").join(hubs, ["a", "salt"]).select("a", "b", "ea", "eb")

    def run(batches):
        for x in batches:
            ok = [_linked(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)) for u, v in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _may_link(n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a set of n elements, ``own`` of them in no other set, can be linked with any set as large as these."""
    shared = n - own
    other = np.maximum(shared, n.min() if len(n) else 0)
    return 100 * shared >= THRESHOLD * (n + other - shared)


def joining_links(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between sets of different components, enough to join what they join; with ``side``, between its two values."""
    at = np.arange(len(node))
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    doc = np.repeat(at, n)
    while len(at):  # sets that can have no partner go, until all that are left may have one
        used = np.bincount(flat)
        own = np.bincount(doc, (used[flat] == 1), len(node)).astype(np.int64)
        stay = np.zeros(len(node), bool)
        stay[at] = _may_link(n[at], own[at])
        if stay[at].all():
            break
        at, flat, doc = at[stay[at]], flat[stay[doc]], doc[stay[doc]]
    if not len(at) or (comp[at] == comp[at[0]]).all():
        return []
    order = np.argsort(flat, kind="stable")
    holders, starts = doc[order], np.concatenate(([0], np.cumsum(np.bincount(flat))))
    names, sizes = np.unique(comp[at], return_counts=True)
    root = {int(c): int(c) for c in names}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out, bounds = [], np.searchsorted(doc, [at, at + 1])
    for i, x, y in zip(at.tolist(), *bounds.tolist()):
        if side is None and comp[i] == names[sizes.argmax()] or side is not None and side[i] != side.min():
            continue  # the largest component is met from the other side of each pair
        common = np.bincount(np.concatenate([holders[starts[k] : starts[k + 1]] for k in flat[x:y].tolist()]), minlength=len(node))
        ok = (100 * common >= THRESHOLD * (n[i] + n - common)) & (comp != comp[i])
        if side is not None:
            ok &= side != side[i]
        for j in np.flatnonzero(ok).tolist():
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                root[p] = q
                out.append((int(node[i]), int(node[j])))
    return out


def _within(neighbourhoods: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join the components of each neighbourhood (node, comp, place), block against block."""
    rows = neighbourhoods.join(sets, "node")
    blocks = rows.groupBy("place").agg(F.ceil(F.sum(F.octet_length("elements").cast("long") + 64) / BLOCK_BYTES).alias("blocks"))
    rows = rows.join(blocks, "place").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "elements")

    def run(t: pa.Table) -> pa.Table:
        side = None if t["i"][0] == t["j"][0] else t["block"].to_numpy()
        links = joining_links(t["node"].to_numpy(), t["comp"].to_numpy(), [np.frombuffer(e, np.uint64) for e in t["elements"].to_pylist()], side)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("place", "i", "j").applyInArrow(run, "a long, b long")


def _state(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node, sig, n) with component and number of links."""
    comp = components(links)
    degree = links.select("a").union(links.select("b")).toDF("node").groupBy("node").agg(F.count("*").cast("int").alias("deg"))
    out = written(nodes.join(comp, "node", "left").join(degree, "node", "left").select("node", "sig", "n", F.coalesce("component", "node").alias("comp"), F.coalesce("deg", F.lit(0)).alias("deg")), "state")
    return out


def links(docs: DataFrame, reps: DataFrame, same_id: DataFrame) -> DataFrame:
    """Links (a, b) between reps (node, doc, digest, n, sig) that span each component; same_id (a, b) are links already."""
    parts = max(1, -(-reps.count() // GROUP_DOCS))
    pairs = written(_bucketed(reps, parts, "first"), "pairs")
    met = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    nodes = written(reps.join(met, "node"), "nodes")
    sets = written(_sets(docs, nodes), "sets")
    found = written(verified(pairs.where("ok").select("a", "b"), sets).unionByName(same_id), "found")
    parts = max(1, -(-nodes.count() // GROUP_DOCS))
    state = _state(nodes.select("node", "sig", "n"), found)
    more = _bucketed(state, parts, "later").select("a", "b")
    seen = pairs.where("ok").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    more = written(more.join(seen, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti"), "pairs")
    if not more.isEmpty():
        both = written(found.unionByName(verified(more, sets)), "found")
        discard(found, state)
        found = both
        state = _state(nodes.select("node", "sig", "n"), found)
    discard(pairs, more)
    apart = components(_bucketed(state, parts, "apart").select("a", "b"))
    open_nodes = state.select("node", "comp").join(apart.toDF("comp", "place"), "comp")
    out = written(found.unionByName(_within(open_nodes, sets)), "found")
    discard(found, state, sets, nodes)
    return out


#: A text that holds more than one in so many rows is hot; there are at most as many such texts.
HOT_SHARE = 1000


def _rows(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, digest and n_shingles; its component (a node) and the smallest doc_id of that, if it has words."""
    signed = written(sign(docs), "signed")
    filled = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")).alias("row")
    reps = filled.groupBy("mark").agg(first, F.count("*").alias("copies"), F.first("n_shingles").cast("int").alias("n"), F.first("sig").alias("sig"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "mark", "copies", F.col("row.doc_id").alias("doc"), F.col("row.digest").alias("digest"), "n", "sig"), "reps")
    several = filled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least <> most")
    marks = filled.select("doc_id", "mark").join(several, "doc_id").where("mark <> least").select("least", "mark").distinct()
    node = reps.select("node", "mark")
    same_id = marks.join(node.toDF("a", "least"), "least").join(node.toDF("b", "mark"), "mark").select("a", "b")
    found = links(docs, reps, written(same_id, "same_id"))
    of_node = reps.select("node", "mark", "copies", "doc").join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("doc").alias("least"))
    of_mark = written(of_node.join(least, "component").select("mark", "copies", "component", "least"), "marks")
    discard(found, reps)
    # A text with very many copies would meet in one task: the few such texts are sent to all.
    total = of_mark.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(of_mark.where(F.col("copies") * HOT_SHARE > total).drop("copies"))
    rows = signed.select("doc_id", "digest", "n_shingles", "mark")
    cold = rows.join(F.broadcast(hot.select("mark")), "mark", "left_anti").join(of_mark.drop("copies"), "mark", "left")
    return cold.unionByName(rows.join(hot, "mark")).drop("mark")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return _rows(docs).select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: of the smallest doc_id, else of those without.

    Rows without words: one of each doc_id, and all that have none. Which of several equal rows (doc_id and text) stays
    is not defined if their other columns differ.
    """
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("doc_id")).alias("id"))
    rows = _rows(docs).where("component IS NOT NULL OR doc_id IS NOT NULL").groupBy(group.alias("of"), "doc_id", "digest").agg(F.count("*").alias("times"))
    rows = written(rows, "verdicts")
    first = rows.groupBy("of").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")).alias("row")).select(F.col("row.doc_id").alias("f_doc"), F.col("row.digest").alias("f_digest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("digest") == F.col("f_digest"))
    gone = rows.join(first, is_first, "left_anti").select("doc_id", "digest")
    twice = rows.join(first, is_first, "left_semi").where("times > 1").select("doc_id", "digest")
    whole = docs.select(F.struct("*").alias("row"))
    whole = whole.select("row", F.col("row.doc_id").cast("long").alias("id"), _digest(F.coalesce("row.text", F.lit(""))).alias("of_text"))
    same = (F.col("digest") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("id"))
    left = whole.join(gone, same, "left_anti")
    if not twice.isEmpty():
        one = left.join(twice, same, "left_semi").groupBy("id", "of_text").agg(F.first("row").alias("row")).select("row")
        left = left.join(twice, same, "left_anti").select("row").unionByName(one)
    return left.select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


_W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS k FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {THRESHOLD} * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
