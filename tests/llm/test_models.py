"""Resampling, toxicity, language model and pipeline: brute force, held-out accuracy and edge cases."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest

from barlab.llm import lm_scoring, quality, toxicity
from barlab.llm.common import store, word_hashes
from barlab.llm.gru import Gru
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice(["the", "sea", "river", "stone", "walks", "under", "bright", "morning", "slowly", "and"]) for _ in range(n))


def test_resampling_keeps_the_target_and_drops_junk(spark, make):
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(80)] + [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(20)] + ODD
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 100, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.importance_resample(make(texts), labels).select("doc_id", "__quality.*").collect()
    assert len(rows) == len(texts)
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(80)) <= kept and not kept & set(range(80, 100))
    assert len(kept) == sum(r.log_odds >= 0 for r in rows)  # k of Gumbel top-k
    everything = quality.importance_resample(make(texts), labels.limit(0)).where("__quality.kept").count()
    assert everything == len(texts)
    assert quality.importance_resample(make(texts).limit(0), labels).count() == 0


def test_resampling_does_not_depend_on_the_label_bound(spark, make):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(700):  # about six good texts to a bad one, and odds that overlap
        share = rng.random()
        texts.append(" ".join(w if rng.random() < share else w.upper() + "!" for w in prose(rng, 60).split()))
        labels.append((i, int(rng.random() < 1 / (1 + math.exp(-0.3 - 3 * share)))))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    whole, cut = (quality.importance_resample(make(texts), labels, bound=b).select("__quality.*").collect() for b in (20_000, 60))
    assert abs(np.mean([r.log_odds for r in whole]) - np.mean([r.log_odds for r in cut])) < 0.7
    assert abs(sum(r.kept for r in whole) - sum(r.kept for r in cut)) < 90


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = np.round(np.concatenate([rng.normal(size=3000), np.full(50, 0.25), rng.normal(1e-9, 1e-12, 100)]), 12)
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 700, 1200, 3150):
        assert quality.kth_largest(df, k) == ranked[k - 1]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(3)

    def slow(x, s, e):  # the best segment, then what lies to its left and right
        best = max(((x[a:b].sum(), a - b, a, b) for a in range(s, e) for b in range(a + 1, e + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, a, b = max((v for v in ((x[i:j].sum(), i - j, i, j) for i in range(s, e) for j in range(i + 1, e + 1)) if abs(v[0] - best[0]) < 1e-12), key=lambda v: v[1])
        return slow(x, s, a) + [(a, b)] + slow(x, b, e)

    for _ in range(60):
        x = rng.normal(-0.2, 1, int(rng.integers(0, 14)))
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == slow(x, 0, len(x))


def test_toxicity_on_held_out_texts(spark, make):
    rng = random.Random(4)
    bad = ["vlorm", "grukash", "zentolk"]
    texts, marks = [], []
    for i in range(400):
        w = prose(rng, 80).split()
        if i % 5 == 0:
            for k in range(6):
                w[20 + k] = rng.choice(bad) + rng.choice(["", "en", "ist"])
        texts.append(" ".join(w))
        marks.append(int(i % 5 == 0))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(make(texts + ODD), labels).collect()}
    assert len(rows) == len(texts) + len(ODD)
    for i, m in enumerate(marks):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == marks[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert not any(rows[400 + k].predicted for k in range(len(ODD)))
    assert toxicity.score_toxicity(make(texts[:3]), labels.limit(0)).count() == 3
    assert toxicity.score_toxicity(make(texts[:3]).limit(0), labels).count() == 0


def test_toxicity_with_both_classes_at_the_bound(spark, make):
    rng = random.Random(12)
    marks = [int(i % 5 == 0) for i in range(400)]
    texts = [prose(rng, 70) + (" " + " ".join(rng.choice(["vlorm", "grukash", "zentolk"]) for _ in range(6)) if m else "") for m in marks]
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(make(texts), labels, bound=40).collect()}
    held = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == marks[i] for i in held]) > 0.97


def test_toxicity_intercept_is_that_of_all_labels(spark, make):
    rng = random.Random(13)
    texts = [prose(rng, 60) for _ in range(400)]  # no evidence at all: every score is the toxic share of the labels
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    for bound in (20_000, 40):
        scores = [r.score for r in toxicity.score_toxicity(make(texts), labels, bound=bound).collect()]
        assert abs(np.median(scores) - 0.2) < 0.06


def test_toxicity_counts_repeated_rows_in_its_calibration(spark, make):
    rng = random.Random(14)
    marks = [int(i % 5 == 0) for i in range(200)]
    texts = [prose(rng, 60) + (" vlorm grukash zentolk vlorm" if m else "") for m in marks]
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    docs = make(texts)
    once, often = ({r.doc_id: r.score for r in toxicity.score_toxicity(d, labels).collect()} for d in (docs, docs.unionByName(docs).unionByName(docs)))
    assert once.keys() == often.keys()
    assert all((once[i] >= 0.5) == (often[i] >= 0.5) == bool(m) for i, m in enumerate(marks))


def test_word_hashes_depend_on_the_word_alone():
    texts = [b"A b  longer-word\n", b"", b" \t", b"b a LONGER-word x" + b"y" * 5000, b"b"]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, before, _ = word_hashes(raw, at)
    words = [w for t in texts for w in t.lower().split()]
    assert before.tolist() == np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))


def test_gru_gradients_and_carried_state():
    rng = np.random.default_rng(5)
    g = Gru(3, 4, 5, seed=1)
    g.p = {k: x.astype(np.float64) for k, x in g.p.items()}
    ids = rng.integers(0, 12, 40)
    whole = g.score(ids, np.array([15, 16, 40]), lanes=2, window=7)
    for s, e, want in zip((0, 15, 16), (15, 16, 40), whole):
        h, total = np.zeros((1, 5)), 0.0
        for t in range(s, e):
            total += float(g.log_probs(h, ids[t:t + 1])[0])
            _, h, _ = g.run(ids[t:t + 1, None], np.zeros((1, 1), bool), h.copy())
        assert abs(total - want) < 1e-4
    total = sum(math.exp(float(g.log_probs(np.zeros((1, 5)), np.array([i]))[0])) for i in range(12))
    assert abs(total - 1) < 1e-6
    pattern = [np.tile([1, 2, 3, 4, 5, 6], 40) for _ in range(60)]
    model = Gru(3, 4, 8)
    before = model.score(pattern[0], np.array([240]))[0]
    assert model.train(pattern).score(pattern[0], np.array([240]))[0] > 0.3 * before


def test_softmax_gradient_is_numeric():
    rng = np.random.default_rng(9)
    g = Gru(3, 4, 5, seed=2)
    g.p = {k: x.astype(np.float64) for k, x in g.p.items()}
    states, targets = rng.normal(size=(6, 5)), rng.integers(0, 12, 6)
    _, grads, ds = g.log_probs(states, targets, grad=True)
    for name, at in (("cw", (1, 2)), ("cb", (0,)), ("ww", (int(targets[0]) // 4, 3, 1)), ("wb", (int(targets[1]) // 4, 2))):
        old, got = g.p[name][at], []
        for step in (1e-5, -1e-5):
            g.p[name][at] = old + step
            got.append(g.log_probs(states, targets).sum())
        g.p[name][at] = old
        assert abs((got[0] - got[1]) / 2e-5 - grads[name][at]) < 1e-6
    moved = [g.log_probs(states + step * np.eye(5)[2], targets).sum() for step in (1e-5, -1e-5)]
    assert abs((moved[0] - moved[1]) / 2e-5 - ds[:, 2].sum()) < 1e-6


def test_language_model_base_equals_brute_force(make):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(0, 90)) + rng.choice([" Q", " q7", ""]) for _ in range(120)] + ODD
    count, tokens = collections.Counter(), {}
    for i, t in enumerate(texts):
        tokens[i] = [*(t or "").encode().lower().split(), b""]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    rows = lm_scoring.score_documents(make(texts), train_share=2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * max(1, len(w))
        assert r.score < 0
    assert sum(r.score for r in rows if r.doc_id < 120) > sum(r.base_score for r in rows if r.doc_id < 120)
    assert lm_scoring.score_documents(make(["a b", "a b", None], ids=[1, 1, None])).count() == 3
    assert lm_scoring.score_documents(make(["a b"]).limit(0)).count() == 0


def test_language_model_learns_from_every_training_document(make, monkeypatch):
    seen = []
    frame = type(make(["a"]).select("text"))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **b: (seen.append(self) if f.__name__ == "learn" else None, plain(self, f, schema, *a, **b))[1])
    texts = [f"text{i} " + "word " * (i % 7) for i in range(150)]
    lm_scoring.score_documents(make(texts + ["the same"] * 40, ids=[*range(150), *[7] * 20, *[None] * 20]))
    want = collections.Counter(t for i, t in zip([*range(150), *[7] * 20, *[None] * 20], texts + ["the same"] * 40) if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2)
    assert len(seen) == 2 and all(collections.Counter(r.text for r in d.collect()) == want for d in seen)
    docs = [np.tile([1, 2, 3, 4, 5, 6], 40) for _ in range(60)]
    model = Gru(3, 4, 8)
    pieces = [model.train(docs[i:i + 20]).updates for i in (0, 20, 40)]
    assert pieces == sorted(set(pieces)) and model.score(docs[0], np.array([240]))[0] > 0.3 * Gru(3, 4, 8).score(docs[0], np.array([240]))[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(store(stage(spark, seen[-1], SF), name))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == names for d in seen[:-1]) and all(b <= a for a, b in zip(ids, ids[1:]))
    last = {}
    for i in ids[1]:
        last[texts[i]] = max(i, last.get(texts[i], i))
    assert ids[2] == set(last.values())
    from tests.llm.test_joins_and_dedup import brute_components

    kept = sorted(ids[2])
    assert ids[3] == {c for _, c in brute_components([texts[i] for i in kept], kept).values()}
    assert ids[5] == ids[4] and len(ids[4]) < len(ids[3])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [i for i, q in labels.items() if q == 1 and i not in ids[1]]
    assert len(wrong) <= 0.02 * sum(labels.values())
