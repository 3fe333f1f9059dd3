"""Quality classifier by co-training of a text view and a page-metadata view.

Two logistic models see the same documents: one their words and the shape of the text, the other their source,
language and length. Over some rounds each view judges every document outside the labelled sample and hands the
PER_ROUND it is surest of, for each class, to the other view as if they were labelled; then each view's logit is
calibrated on labelled documents left out of training, the calibrated views are combined, and every document is scored.
This is done for two targets, low quality and toxicity; a document is kept if it is neither.

Labelled rows are a bounded sample drawn by hash of the id, MAX_LABELLED; the vocabulary is the MAX_WORDS words that
stand in MIN_DOCS of them or more and whose shares differ most between the classes of either target, over the labelled
documents of training. The unlabelled side is all other documents: their features are written once and every round
judges all of them; only the chosen ones come to the driver, four times PER_ROUND a target and round. Equal confidence
is ordered by a hash of the id. Scoring reads every whole text.

Defined results: a null or empty text has no words and is scored by its shape and metadata; null metadata is a value of
its own; repeated rows each get a score and are handed over once; rows without doc_id are scored but not learnt from;
repeated labels of a document count as one, low quality and toxic winning; null labels are left out; without labels of both classes a target's probability is the share seen, or 0, so that
nothing is rejected without evidence; an empty table gives an empty result; extra columns are ignored by ``score`` and
kept by ``keep``.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

MAX_LABELLED, MAX_WORDS, MIN_DOCS = 6000, 40_000, 4
#: Rounds; confidence from which a view hands a document over; how many a round, view and class.
ROUNDS, SURE, PER_ROUND = 3, 0.97, 300
#: Share of the labelled sample kept out of training, for calibration.
HELD_OUT = 0.25
META_SLOTS = 512
STEPS, RATE, DECAY = 150, 0.1, 1e-4
#: Standard errors by which a word's share must differ between the classes to enter a model.
SCREEN = 5.0
REJECT = 0.5
TARGETS = ("low_quality", "toxic")
_SHAPE = 8


def fold(text: bytes) -> list[bytes]:
    return text.lower().split()


#: Bytes that end a word without being part of it, for the vocabulary.
_EDGE = b".,;:!?\"'()#*$%&|<>"


def terms(words: list[bytes]) -> set[bytes]:
    return {w.strip(_EDGE) for w in words}


def shape(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, c = max(1, len(words)), max(1, len(text))
    upper = sum(map(text.count, (b"E", b"A", b"T", b"N", b"O", b"R", b"S", b"I")))
    lower = sum(map(text.count, (b"e", b"a", b"t", b"n", b"o", b"r", b"s", b"i")))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))
    return [math.log1p(n), symbols * 10 / c, upper / max(1, upper + lower), text.count(b"!!") / n, text.count(b"|") / n, (text.count(b".") + text.count(b",")) / n, distinct / n, min(20, c / n) / 10]


def meta(source, lang, n_chars) -> list[int]:
    """Slots of the metadata's values."""
    size = -1 if n_chars is None else int(math.log2(n_chars + 1))
    return [zlib.crc32(f"{k}={v}".encode()) % META_SLOTS for k, v in (("s", source), ("l", lang), ("n", size), ("ln", (lang, size)))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Sparse:
    """Rows of set features and dense columns."""

    at: np.ndarray
    slot: np.ndarray
    dense: np.ndarray
    width: int

    def logits(self, m: Logistic) -> np.ndarray:
        return np.bincount(self.at, m.w[self.slot], len(self.dense)) + ((self.dense - m.mean) / m.scale) @ m.v + m.bias


@dataclass
class Logistic:
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float = 0.0

    @staticmethod
    def fit(x: Sparse, y: np.ndarray) -> Logistic:
        """Full-batch Adam over the slots that pass the screen; the classes weigh the same."""
        d = x.dense.shape[1]
        m = Logistic(np.zeros(x.width), np.zeros(d), x.dense.mean(0) if len(y) else np.zeros(d), (x.dense.std(0) if len(y) else np.ones(d)) + 1e-6)
        pos = y.sum()
        if not 0 < pos < len(y):
            m.bias = 0.0 if not len(y) else float(np.log((pos + 0.01) / (len(y) - pos + 0.01)))
            return m
        weight = np.where(y > 0, 0.5 / pos, 0.5 / (len(y) - pos))
        on, all_on, n = np.bincount(x.slot, y[x.at], x.width), np.bincount(x.slot, minlength=x.width), len(y)
        share = (all_on + 1) / (n + 2)
        apart = np.abs(on / pos - (all_on - on) / (n - pos)) / np.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)))
        passed = (apart >= SCREEN)[x.slot]
        x = Sparse(x.at[passed], x.slot[passed], x.dense, x.width)
        z = (x.dense - m.mean) / m.scale
        g1, g2 = np.zeros(x.width + d + 1), np.zeros(x.width + d + 1)
        for t in range(1, STEPS + 1):
            r = (_sigmoid(x.logits(m)) - y) * weight
            g = np.concatenate((np.bincount(x.slot, r[x.at], x.width) + DECAY * m.w, z.T @ r + DECAY * m.v, [r.sum()]))
            g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
            step = RATE * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-6)
            m.w -= step[: x.width]
            m.v -= step[x.width : -1]
            m.bias -= step[-1]
        return m


@dataclass
class Target:
    """Both views' models and how their logits combine."""

    text: Logistic
    meta: Logistic
    mix: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def _calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic model of few columns, by Newton steps with a weak prior; non-negative on the views."""
    x = np.column_stack((z, np.ones(len(z))))
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(c))
        c = c - np.linalg.solve(h, x.T @ (p - y) + 0.05 * c)
    c[:-1] = np.maximum(c[:-1], 0)
    return c


def _views(counts: tuple, values: tuple, dense: np.ndarray, words: int) -> tuple[Sparse, Sparse]:
    """Both views of some documents, from the lengths of their slot lists and these lists end to end."""
    n = len(dense)
    text, metas = (np.repeat(np.arange(n), c) for c in counts)
    return Sparse(text, values[0], dense, max(1, words)), Sparse(metas, values[1], np.zeros((n, 0)), META_SLOTS)


def _views_of(rows: list[Row], words: int) -> tuple[Sparse, Sparse]:
    counts, values = zip(*[(np.array([len(r[c]) for r in rows], int), np.fromiter((i for r in rows for i in r[c]), int)) for c in ("slots", "metas")])
    return _views(counts, values, np.array([r["dense"] for r in rows]).reshape(len(rows), _SHAPE), words)


class Learner:
    """One target: labelled documents with their labels, and per view the documents that the other view handed over."""

    def __init__(self, rows: list[Row], y: np.ndarray, words: int):
        held = np.array([_held(r["key"]) for r in rows], bool)
        self.learnt, self.learnt_y = [r for r, h in zip(rows, held) if not h], y[~held]
        self.cal_y, self.labelled_y, self.words = y[held], y, words
        self.cal = _views_of([r for r, h in zip(rows, held) if h], words)
        self.given: tuple[dict[int, tuple[float, Row]], ...] = ({}, {})

    def fit(self, view: int) -> Logistic:
        more = [self.given[view][i] for i in sorted(self.given[view])]
        x = _views_of(self.learnt + [r for _, r in more], self.words)[view]
        return Logistic.fit(x, np.r_[self.learnt_y, [label for label, _ in more]])

    def judge(self, view: int) -> tuple[Logistic, np.ndarray]:
        """The view's model and the calibration of its logit."""
        model = self.fit(view)
        return model, _calibrate(self.cal[view].logits(model)[:, None], self.cal_y)

    def target(self) -> Target:
        out = Target(self.fit(0), self.fit(1))
        if 0 < self.cal_y.sum() < len(self.cal_y):
            out.mix = _calibrate(np.column_stack((self.cal[0].logits(out.text), self.cal[1].logits(out.meta))), self.cal_y)
        else:
            share = min(float(self.labelled_y.mean()) if len(self.labelled_y) else 0.0, 1 - 1e-6)
            out.mix = np.array([0.0, 0.0, math.log((share + 1e-9) / (1 - share))])
        return out


def confident(pool: DataFrame, learners: list[Learner]) -> DataFrame:
    """(target, view, label, key): the PER_ROUND surest documents of each, among all that the other view was not given yet."""
    judges = [[learner.judge(k) for k in range(2)] for learner in learners]
    had = [[np.array(sorted(learner.given[1 - k]), np.int64) for k in range(2)] for learner in learners]
    words = learners[0].words
    cases = [(t, k, label) for t in range(len(learners)) for k in range(2) for label in (1, 0)]

    def run(batches):
        best = {c: (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in cases}
        for b in batches:
            key, tie = b.column("key").to_numpy(), b.column("tie").to_numpy()
            lists = [b.column(c) for c in ("slots", "metas")]
            counts, values = zip(*[(x.value_lengths().to_numpy(), x.flatten().to_numpy()) for x in lists])
            views = _views(counts, values, b.column("dense").flatten().to_numpy().reshape(len(key), _SHAPE), words)
            for t, k, label in cases:
                model, c = judges[t][k]
                p = np.round(_sigmoid(views[k].logits(model) * c[0] + c[1]), 9)
                p = p if label else 1 - p
                on = (p >= SURE) & ~np.isin(key, had[t][k])
                p, i, j = (np.r_[x, y] for x, y in zip(best[t, k, label], (p[on], tie[on], key[on])))
                order = np.lexsort((j, i, -p))
                order = order[np.r_[True, j[order][1:] != j[order][:-1]][: len(order)]][:PER_ROUND]
                best[t, k, label] = p[order], i[order], j[order]
        for (t, k, label), (p, i, j) in best.items():
            n = len(p)
            yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int32()) for v in (t, k, label)] + [pa.array(p, pa.float64()), pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["target", "view", "label", "p", "tie", "key"])

    found = pool.select("key", "tie", "slots", "dense", "metas").mapInArrow(run, "target int, view int, label int, p double, tie long, key long")
    once = found.groupBy("target", "view", "label", "key").agg(F.max("p").alias("p"), F.max("tie").alias("tie"))
    first = Window.partitionBy("target", "view", "label").orderBy(F.desc("p"), "tie", "key")
    return once.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PER_ROUND).select("target", "view", "label", "key")


def exchange(pool: DataFrame, learners: list[Learner]) -> bool:
    """One round: each view hands its surest documents to the other. False if there was none."""
    picks = [r.asDict() for r in confident(pool, learners).collect()]
    if not picks:
        return False
    wanted = pool.sparkSession.createDataFrame([(k,) for k in sorted({r["key"] for r in picks})], "key long")
    rows = {r["key"]: r for r in pool.join(F.broadcast(wanted), "key").groupBy("key").agg(F.min_by(F.struct("key", "slots", "dense", "metas"), "row").alias("r")).select("r.*").collect()}
    for r in sorted(picks, key=lambda r: (r["target"], r["view"], -r["label"], r["key"])):
        learners[r["target"]].given[1 - r["view"]].setdefault(r["key"], (float(r["label"]), rows[r["key"]]))
    return True


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    targets: list[Target]


_FEATURES = "key long, low_quality int, toxic int, slots array<int>, dense array<double>, metas array<int>"


def _sample(labels: DataFrame) -> DataFrame:
    """The labelled sample's ids and targets."""
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__key")).agg(
        F.max((F.col("quality") == 0).cast("int")).alias("low_quality"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic")
    )
    return lab.orderBy(F.xxhash64("__key"), "__key").limit(MAX_LABELLED)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))


def _held(key) -> bool:
    return zlib.crc32(f"held{key}".encode()) % 1000 < HELD_OUT * 1000


def _apart(on: str, pos: int, n: int) -> Column:
    """The screen of Logistic.fit over the labelled documents of training, of which ``all_on`` hold the word."""
    if not 0 < pos < n:
        return F.lit(0.0)
    share = (F.col("all_on") + 1) / (n + 2)
    return F.abs(F.col(on) / pos - (F.col("all_on") - F.col(on)) / (n - pos)) / F.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)))


def vocabulary_of(sample: DataFrame) -> DataFrame:
    """The words of the models, w, best first."""

    def words(batches):
        for b in batches:
            count: dict[bytes, list[int]] = {}
            for key, text, *ys in zip(*[b.column(i).to_pylist() for i in range(4)]):
                add = (1, 0, 0, 0) if _held(key) else (1, 1, *ys)
                for w in terms(fold(text)):
                    c = count.setdefault(w, [0, 0, 0, 0])
                    for i, x in enumerate(add):
                        c[i] += x
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), *[pa.array([c[i] for c in count.values()], pa.int64()) for i in range(4)]], names=["w", *sums])

    sums = ["n", "all_on", *TARGETS]
    learnt = F.crc32(F.concat(F.lit("held"), F.col("doc_id").cast("string")).cast("binary")) % 1000 >= HELD_OUT * 1000
    total = sample.where(learnt).agg(F.count("*"), *[F.coalesce(F.sum(t), F.lit(0)) for t in TARGETS]).first()
    found = sample.select("doc_id", "text", *TARGETS).mapInArrow(words, "w binary, " + ", ".join(f"{c} long" for c in sums)).groupBy("w").agg(*[F.sum(c).alias(c) for c in sums])
    best = F.greatest(*[_apart(t, pos, total[0]) for t, pos in zip(TARGETS, total[1:])])
    return found.where(F.col("n") >= MIN_DOCS).orderBy(best.desc(), F.desc("n"), "w").limit(MAX_WORDS)


def _features(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    def run(batches):
        get = vocabulary.get
        names = ("doc_id", "low_quality", "toxic", "text", "source", "lang", "n_chars")
        for b in batches:
            key, low, toxic, *cols = [b.column(c) for c in names]
            slots, dense, metas = [], [], []
            for text, *m in zip(*[c.to_pylist() for c in cols]):
                w = fold(text)
                ts = terms(w)
                slots.append(sorted(i for t in ts if (i := get(t)) is not None))
                dense.append(shape(text, w, len(ts)))
                metas.append(meta(*m))
            yield pa.RecordBatch.from_arrays([key, low, toxic, pa.array(slots, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64())), pa.array(metas, pa.list_(pa.int32()))], names=["key", "low_quality", "toxic", "slots", "dense", "metas"])

    return rows.mapInArrow(run, _FEATURES)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    drawn, rows = F.broadcast(_sample(labels)), _rows(docs)
    sample = rows.join(drawn, F.col("doc_id") == F.col("__key")).drop("__key")
    vocabulary = {bytes(r["w"]): i for i, r in enumerate(vocabulary_of(sample).select("w").collect())}
    got = sorted(_features(sample, vocabulary).collect(), key=lambda r: (r["key"], r["slots"], r["dense"], r["metas"]))
    others = rows.join(drawn, F.col("doc_id") == F.col("__key"), "left_anti").select("*", F.lit(-1).alias("low_quality"), F.lit(-1).alias("toxic"))
    learners = [Learner(got, np.array([r[t] for r in got], float), len(vocabulary)) for t in TARGETS]
    if any(0 < learner.learnt_y.sum() < len(learner.learnt_y) for learner in learners):  # no view can be sure of anything otherwise
        features = _features(others, vocabulary).select("key", F.xxhash64("key").alias("tie"), F.xxhash64("slots", "dense", "metas").alias("row"), "slots", "dense", "metas")
        pool = written(features, "pool")
        for _ in range(ROUNDS):
            if not exchange(pool, learners):
                break
        discard(pool)
    return Model(vocabulary, [learner.target() for learner in learners])


def _scorer(model: Model):
    weights = [t.text.w for t in model.targets]

    def logits(texts: list[bytes | None], sources, langs, sizes) -> np.ndarray:
        """(targets, documents) probabilities."""
        get, at, slots, dense, ms = model.vocabulary.get, [], [], [], []
        for k, t in enumerate(texts):
            t = t or b""
            w = fold(t)
            ts = terms(w)
            ids = [i for x in ts if (i := get(x)) is not None]
            at.append(len(ids))
            slots += ids
            dense.append(shape(t, w, len(ts)))
        n = len(texts)
        text = Sparse(np.repeat(np.arange(n), at), np.array(slots, int), np.array(dense).reshape(n, _SHAPE), len(weights[0]))
        ms = [meta(*x) for x in zip(sources, langs, sizes)]
        metas = Sparse(np.repeat(np.arange(n), 4), np.array(ms, int).ravel(), np.zeros((n, 0)), META_SLOTS)
        return np.array([t.probability(text.logits(t.text), metas.logits(t.meta)) for t in model.targets])

    return logits


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, both probabilities and whether the document is kept."""
    schema = "doc_id long, p_low_quality double, p_toxic double, kept boolean"

    def run(batches):
        probabilities = _scorer(model)
        for b in batches:
            p = probabilities(*[b.column(i).to_pylist() for i in (1, 2, 3, 4)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[0]), pa.array(p[1]), pa.array((p < REJECT).all(0))], names=["doc_id", "p_low_quality", "p_toxic", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "source", "lang", F.col("n_chars").cast("long")).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are kept, with all their columns."""
    names = docs.columns

    def run(batches):
        probabilities = _scorer(model)
        at = [names.index(c) for c in ("text", "source", "lang", "n_chars")]
        for b in batches:
            text = b.column(at[0]).cast(pa.binary()).to_pylist()
            p = probabilities(text, *[b.column(i).to_pylist() for i in at[1:]])
            yield b.filter(pa.array((p < REJECT).all(0)))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
