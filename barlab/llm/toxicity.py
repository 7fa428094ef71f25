"""Toxic passages as maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import APART, U64, crc_share, mix, slices, store, text_bytes, word_hashes
from barlab.llm.quality import bounded_labels, intercept_shift, logistic

#: Views of a token: the whole token and its first bytes, so that an unseen form of a known stem has a score.
VIEWS = (None, 4, 5, 6, 7)
#: Score of a token that is not listed: what a passage loses by each.
REST = -0.05


def views(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """One hash array per view and the tokens before each text."""
    raw, at = text_bytes(column)
    out = []
    for k, prefix in enumerate(VIEWS):
        h, before, _ = word_hashes(raw, at, space=APART, prefix=prefix)
        out.append(mix(h + U64(k)))
    return out, before


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in one pass over the tokens.

    Runs of one sign are summed first; candidate segments form a stack in which each new one is joined to earlier ones
    while that raises its score, so every candidate is pushed and popped once.
    """
    n = len(score)
    if not n:
        return []
    sign = score > 0
    cut = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    sums = np.add.reduceat(score, cut).tolist()
    ends = np.append(cut[1:], n).tolist()
    stack: list[list] = []  # start, end, sum before, sum at the end
    total = 0.0
    for start, end, s in zip(cut.tolist(), ends, sums):
        if s <= 0:
            total += s
            continue
        item = [start, end, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j -= 1
            if j < 0 or stack[j][3] >= item[3]:
                stack.append(item)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


def decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(x * values)) = 1 for scores of negative mean: the scale of the largest segment."""
    weights = weights / weights.sum()
    if not (values > 0).any() or weights @ values >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while weights @ np.exp(np.minimum(high * values, 700)) < 1:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        if weights @ np.exp(np.minimum(mid * values, 700)) < 1:
            low = mid
        else:
            high = mid
    return high


class Lexicon:
    """Scores of token views; a token takes the view whose score is largest, or ``rest`` if none is listed."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray, rest: float):
        order = np.argsort(keys)
        self.keys, self.scores, self.rest = keys[order], scores[order], rest

    def __call__(self, hashes: list[np.ndarray]) -> np.ndarray:
        best = np.full(len(hashes[0]), self.rest)
        if len(self.keys):
            for h in hashes:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                best = np.maximum(best, np.where(self.keys[at] == h, self.scores[at], self.rest))
        return best


def view_counts(train: DataFrame) -> DataFrame:
    """(h, bad0, all0, bad1, all1): texts that hold a token view, toxic ones and all, in fold 0 and in fold 1."""

    def count(batches):
        for batch in slices(batches):
            hashes, before = views(batch.column("text"))
            toxic, fold = np.asarray(batch.column("label")), np.asarray(batch.column("fold"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(before))
            for h in hashes:
                key, inverse = np.unique(h, return_inverse=True)
                pair = np.unique(inverse.astype(np.int64) * batch.num_rows + doc)
                k, d = pair // batch.num_rows, pair % batch.num_rows
                cells = [np.bincount(k, w[d], len(key)).astype(np.int64) for f in (0, 1) for w in ((fold == f) & (toxic == 1), fold == f)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, cells)], names=["h", "bad0", "all0", "bad1", "all1"])

    sums = [F.sum(c).alias(c) for c in ("bad0", "all0", "bad1", "all1")]
    return train.mapInArrow(count, "h long, bad0 long, all0 long, bad1 long, all1 long").groupBy("h").agg(*sums)


def prior_counts(background: DataFrame, keys: np.ndarray) -> tuple[dict[int, int], int]:
    """Occurrences of the listed views in all texts, and the tokens of all texts."""

    def count(batches):
        total, tokens = np.zeros(len(keys), np.int64), 0
        for batch in slices(batches):
            hashes, before = views(batch.column("text"))
            tokens += int(before[-1])
            for h in hashes:
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(at[keys[at] == h], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], tokens))], names=["i", "n"])

    got = {r.i: r.n for r in background.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return {int(keys[i]): n for i, n in got.items() if i >= 0}, max(got.get(-1, 0), 1)


def lexicon_of(rows: list[tuple[int, int, int]], bad_texts: int, texts: int, prior: dict[int, int], tokens: int, size: int, certainty: float,
               strength: float) -> Lexicon:
    """Log-odds of views in toxic against other texts with an informative Dirichlet prior of ``strength`` of the texts' number.

    A view is listed when its log-odds lies ``certainty`` standard deviations above zero; its score is what lies
    beyond. Of more than ``size`` views the most certain stay.
    """
    got, clean_texts, strength = [], texts - bad_texts, strength * texts
    for h, bad, both in rows:
        alpha = 0.5 + strength * prior.get(h, 1) / tokens
        clean = both - bad
        odds = math.log((bad + alpha) / (bad_texts + strength)) - math.log((clean + alpha) / (clean_texts + strength))
        deviation = math.sqrt(1 / (bad + alpha) + 1 / (clean + alpha))
        if odds >= certainty * deviation:
            got.append((odds / deviation, h, odds - certainty * deviation))
    got = sorted(got, reverse=True)[:size]
    return Lexicon(np.array([g[1] for g in got], np.int64).view(U64), np.array([g[2] for g in got]), REST)


def passage_scores(docs: DataFrame, lexicon: Lexicon, scale: float, size: float, level: float) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_tokens, evidence, top and the toxic passages as token ranges.

    A segment of score s has the extreme-value p-value 1 - exp(-size * tokens * exp(-scale * s)); the passages are those
    below ``level``, ``evidence`` is the sum of -log10 of their p-values, ``top`` the largest -log10 of any.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        lex = held.value
        for batch in slices(batches):
            hashes, before = views(batch.column("text"))
            scores = lex(hashes)
            hot = np.concatenate([[0], np.cumsum(scores > 0)])
            found, evidence, top = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                s, e = int(before[i]), int(before[i + 1])
                here = []
                if hot[e] > hot[s]:
                    for a, b, value in segments(scores[s:e]):
                        expected = size * (e - s) * math.exp(-scale * value)
                        p = -math.expm1(-expected)
                        strength = -math.log10(max(p, 1e-300))
                        top[i] = max(top[i], strength)
                        if p < level:
                            here.append({"begin": a, "stop": b, "score": value})
                            evidence[i] += strength
                found.append(here)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(before)), pa.array(evidence), pa.array(top), pa.array(found, span)],
                names=[*batch.schema.names, "n_tokens", "evidence", "top", "passages"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scan, f"{kinds}, n_tokens long, evidence double, top double, passages array<struct<begin:bigint,stop:bigint,score:double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, bound: int = 20_000,
                   size: int = 50_000, min_docs: int = 3, certainty: float = 2.5, strength: float = 0.1, level: float = 0.01, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, passages per row of ``docs`` (doc_id, text; other columns are ignored).

    Labels are learnt from at most ``bound`` rows of each class outside the held-out share, and are never an input of a
    score. The lexicon comes from all of them; its extreme-value scale and the map from a text's evidence to a
    probability come from two halves, each judged by the lexicon of the other, at the class ratio of all labels outside
    the held-out share. Null, empty and token-free texts have no passage and get the score of no evidence. Rows are scored one by one; null and repeated ids stay.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = labels.where(crc_share("doc_id", modulus) != held)
    picked = store(bounded_labels(usable, label, bound), "labels")
    train = store(rows.join(F.broadcast(picked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))), "train")
    counts = store(view_counts(train), "views")
    sizes = {(r.fold, r.label): r["count"] for r in train.groupBy("fold", "label").count().collect()}
    bad_texts, texts = [sizes.get((f, 1), 0) for f in (0, 1)], [sizes.get((f, 0), 0) + sizes.get((f, 1), 0) for f in (0, 1)]
    bad, both = F.col("bad0") + F.col("bad1"), F.col("all0") + F.col("all1")
    # twice as frequent in toxic texts as in others: a ratio of rates, which the sizes of the classes do not move
    often = bad * (sum(texts) - sum(bad_texts)) > 2 * (both - bad) * sum(bad_texts)
    listed = counts.where((bad >= min_docs) & often).orderBy(F.desc(bad / (both - bad + 1)), "h").limit(2 * size).collect()
    prior, tokens = prior_counts(rows, np.array(sorted(r.h for r in listed), np.int64)) if listed else ({}, 1)
    fit = lambda cells, k, n: lexicon_of(cells, k, n, prior, tokens, size, certainty, strength)
    lexicon = fit([(r.h, r.bad0 + r.bad1, r.all0 + r.all1) for r in listed], sum(bad_texts), sum(texts))
    halves = [fit([(r.h, r.bad0, r.all0) for r in listed], bad_texts[0], texts[0]), fit([(r.h, r.bad1, r.all1) for r in listed], bad_texts[1], texts[1])]

    points, scales = [], []
    for f in (0, 1):  # each fold is judged by the lexicon of the other
        judge = spark.sparkContext.broadcast(halves[1 - f])

        def histogram(batches, judge=judge):
            for batch in slices(batches):
                value, count = np.unique(np.round(judge.value(views(batch.column("text"))[0]), 2), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["value", "n"])

        own = train.where(F.col("fold") == f)
        bins = own.where("label = 0").select("text").mapInArrow(histogram, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
        scales.append(decay(np.array([b.value for b in bins]), np.array([float(b.n) for b in bins])) if bins else 1.0)
    scale = min(max(float(np.mean(scales)), 0.05), 5.0)
    for f in (0, 1):
        probe = passage_scores(train.where(F.col("fold") == f).select("label", "text"), halves[1 - f], scale, 0.1, level)
        # a labelled id may be repeated without bound: equal evidence, to four digits, comes as one row
        points += probe.groupBy(F.round(F.log1p(F.col("evidence") + F.col("top")), 4).alias("x"), "label").agg(F.count("*").alias("n")).orderBy("x", "label").collect()
    x, y, n = (np.array([r[c] for r in points], float) for c in ("x", "label", "n"))
    a, b = logistic(x, y, n) if len(set(y)) == 2 else (-3.0, 0.0)
    a, b = a + intercept_shift(usable, label, picked), max(b, 0.0)
    scored = passage_scores(rows.withColumn("held_out", crc_share("doc_id", modulus) == held), lexicon, scale, 0.1, level)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.log1p(F.col("evidence") + F.col("top")))))
    return scored.withColumn("score", score).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_tokens", F.size("passages").cast("long").alias("n_passages"))
