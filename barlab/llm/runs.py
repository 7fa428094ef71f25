"""Periodic runs of words: a suffix automaton whose suffix links form a link-cut forest.

Appending word i makes the path from its state to the root the suffixes that end at i. Access recolours that path with i; the
pieces it crosses are the states whose last end was the same earlier place j. A piece whose longest string has length l tells that
the l words before i equal those before j, and no more: the words up to i have period i - j over l + (i - j) words. Where l reaches
the period this is a square; where the next word breaks the period the stretch is a maximal run. Since j is the last end, the
period is the smallest one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import give_back, slices

#: A run has at least this many words and this many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
_RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


class LastEnds:
    """The suffix automaton of a growing sequence with the last end of every state.

    A splay tree holds each maximal piece of a link path whose states share their last end; ``end`` is kept at its root.
    ``left`` are the shorter strings, ``right`` the longer ones, ``up`` the parent in the splay tree or, at its root, the state
    that the piece hangs from.
    """

    def __init__(self) -> None:
        self.moves: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.left, self.right, self.up, self.end = [-1], [-1], [-1], [-1]
        self.last = 0

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(-1)
        for column in (self.left, self.right, self.up, self.end):
            column.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up, end = self.left, self.right, self.up, self.end
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner:
                turn = p if (left[g] == p) == (left[p] == x) else x
                self._rotate(turn)
                if up[turn] < 0 or (left[up[turn]] != turn and right[up[turn]] != turn):
                    end[turn] = end[g]
                p = up[x]
                top = up[p]
                if top < 0 or (left[top] != p and right[top] != p):
                    end[x] = end[p]
            else:
                end[x] = end[p]
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c >= 0:
            up[c] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _append(self, word: int) -> int:
        """The state of the sequence so far with ``word``; its link is set, its place in the forest too."""
        moves, length, link, up = self.moves, self.length, self.link, self.up
        p, new = self.last, self._state(length[self.last] + 1, {})
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = moves[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                short = self._state(length[p] + 1, dict(moves[q]))
                link[short], link[q], link[new] = link[q], short, short
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = short
                    p = link[p]
                self._splay(q)  # the copy ends where q does: it joins q's piece, just above q
                above = self.left[short] = self.left[q]
                if above >= 0:
                    up[above] = short
                self.left[q], up[short] = short, q
        up[new] = link[new]
        self.last = new
        return new

    def append(self, word: int, at: int) -> list[tuple[int, int]]:
        """Append ``word`` as number ``at``: (last end, length) of each piece of earlier ends, longest first."""
        left, right, up, end, length = self.left, self.right, self.up, self.end, self.length
        below, x, pieces = -1, self._append(word), []
        while x >= 0:
            self._splay(x)
            if end[x] >= 0 and length[x]:
                pieces.append((end[x], length[x]))
            cut = right[x]
            if cut >= 0:
                end[cut] = end[x]
            right[x] = below
            below, x = x, up[x]
        end[below] = at
        return pieces


def piece_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by end."""
    automaton, runs, n = LastEnds(), [], len(words)
    for i, word in enumerate(words):
        for j, same in automaton.append(word, i):
            period = i - j
            total = same + period
            if total >= MIN_WORDS and total >= MIN_PERIODS * period and (i + 1 == n or words[i + 1] != words[j + 1]):
                runs.append((i - total + 1, total, period))
    return runs


def pieces(words: list) -> list[tuple[int, int]]:
    """The stretches [start, stop) between words that occur fewer than ``MIN_PERIODS`` times, ``MIN_WORDS`` words at least.

    A run holds each of its words that often, so it lies within a piece, and the word beside a piece never extends it.
    """
    count = Counter(words)
    often = np.fromiter((count[w] >= MIN_PERIODS for w in words), bool, len(words))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]))).tolist()
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= MIN_WORDS]


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words by start, then period."""
    runs = []
    for start, stop in pieces(words):
        ids: dict = {}
        runs += [(start + s, length, period) for s, length, period in piece_runs([ids.setdefault(w, len(ids)) for w in words[start:stop]])]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in slices(batches):
        found, kept = [], []
        for text in b["text"].to_pylist():
            words = (text or "").encode().split()
            runs = word_runs(words)
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            kept.append(b" ".join(_collapsed(words, runs)).decode())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])
    give_back()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed for every row of ``docs`` (doc_id, text; other columns, whatever their names, are not read).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least ``MIN_WORDS`` words and ``MIN_PERIODS`` times
    its smallest period that no neighbouring word extends; ``runs`` has all of them by start, then period. ``collapsed`` joins the
    words that no run contains after its first period by one space. Null and empty texts and texts without a repetition have no
    runs. Rows are independent: repeated rows and ids give equal rows, null ids stay, an empty table gives none. A long text
    takes n log n steps and about a kilobyte per word of its longest piece (``pieces``). There is no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find, f"doc_id long, {_RUNS}")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text with a periodic tail in the texts whose crc32 h of the decimal doc_id divides by 10: from word a = g % n on the words
    a .. a + p - 1 repeat, with g = h div 10 and p = 1 + (n - a) div (3 + g % 8). Null ids stay as they are."""
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``periodic_runs``: n_runs, the run of the greatest exponent (ties: smallest start, then period),
    runs_sha256 over ``start,length,period`` lines and collapsed_sha256."""
    runs = periodic_runs(docs)
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | (
        (b["length"] * a["period"] == a["length"] * b["period"]) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
