"""The pipeline's stages in order, each against a plain version of what it must do."""

import re

import corpus_pipeline
import numpy as np
from draftlake.llm import decontaminate, near_duplicates, secrets
from draftlake.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "secret_scans", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), name)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept["quality_classifier"].items() if (w := t.lower().split())}
    label = {i: i for i in kept["quality_classifier"]}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert set(kept["near_duplicates"]) == {i for i, c in label.items() if c == i}
    assert near_duplicates.THRESHOLD == 75
    quality = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i in kept["quality_classifier"] for i, r in quality.items() if r["quality"] == 1 and r["toxic"] == 0]
    bad = [i in kept["quality_classifier"] for i, r in quality.items() if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.7 * len(bad), (sum(good), len(good), sum(bad), len(bad))
    assert kept["decontamination"] == decontaminated(kept["near_duplicates"], [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert kept["secret_scans"] == {i: redacted(t) for i, t in kept["decontamination"].items()}
    final = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    assert set(final) == set(kept["secret_scans"]) and all(r["round_trip"] for r in final.values())


def decontaminated(texts, items):
    """Every window of every item looked up at every place of every text."""
    split = [decontaminate.words_of((t or "").encode()) for t in items]
    windows = {tuple(w[k : k + 8]) for w in split if w for k in range(max(1, len(w) - 7))}
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in texts.items():
        w = decontaminate.words_of((t or "").encode())
        hit = np.zeros(len(w), bool)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = True
        if not hit.any():
            out[i] = t
        elif hit.sum() < decontaminate.MAX_COVERAGE * len(w):
            out[i] = decontaminate.without_spans(t.encode(), hit).decode()
    return out


def redacted(text):
    if text is None:
        return None
    spans = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least)
    out, reach = [], 0
    for start, _, end in spans:
        if start >= reach:
            out.append(text[reach:start])
        reach = max(reach, end)
    return "<secret>".join([*out, text[reach:]]) if spans else text
