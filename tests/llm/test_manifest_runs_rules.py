"""Merkle manifest, periodic runs and adaptive quality rules against brute force, with odd inputs."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from barlab.llm import merkle, quality_rules, runs
from tests.llm.conftest import DOCS, ODD


def h(text):
    return sha256(text.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    n = row["n_chars"]
    return h("".join(map(framed, (row["doc_id"], row["source"], row["lang"], None if n is None else n + more, row["text"]))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for row in tree[:-1]:
        out.append((row[at ^ 1] if at ^ 1 < len(row) else "", at & 1))
        at >>= 1
    return out


def brute_manifest(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1) if tampered else leaf(r)
            for other, left in path:
                node = h(other + node if left else node + other)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h("".join(s for s, _ in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df, bits):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    m = merkle.manifest(df, changes={"n_chars": F.col("n_chars") + 1}, where=crc % 7 == 0, bits=bits)
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.regexp_replace("path", "[LR-]", ""), 256), "folded_root",
                 F.col("folded_root") == F.col("root"))
    return sorted(map(tuple, m.collect()), key=str)


def documents(langs, seed=1):
    rng, rows = random.Random(seed), []
    for lang, n in langs.items():
        rows += [(rng.randrange(10**6), rng.choice(ODD), lang, rng.choice(["s", None, ""]), rng.choice([None, 0, 7, 10**9])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("bits", [1, 2, 8])
@pytest.mark.parametrize("langs", [{"en": 37, None: 5, "": 2, "é": 1, "z": 16}, {"en": 1}, {"a": 1, "b": 1}, {None: 9}])
def test_manifest_equals_brute_force(spark, bits, langs):
    rows = documents(langs)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert manifest_rows(df, bits) == brute_manifest([dict(zip(DOCS.names, r)) for r in rows])


def test_manifest_orders_null_and_repeated_ids(spark):
    rows = [(3, "a", "en", "s", 1), (3, "b", "en", "s", 1), (None, "c", "en", "s", 1), (None, None, "en", None, None), (3, "a", "en", "s", 1), (1, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert manifest_rows(df, 2) == brute_manifest([dict(zip(DOCS.names, r)) for r in rows])


def test_manifest_of_no_rows_and_of_clashing_columns(spark):
    assert merkle.tampered_manifest(spark.createDataFrame([], DOCS)).collect() == []
    rows = documents({"en": 20, "de": 3})
    df = spark.createDataFrame(rows, DOCS)
    names = ("tree", "digest", "pos", "n", "block", "path", "row", "changed", "leaf", "root", "at", "part", "first", "group")
    more = df.withColumns({c: F.lit("x") for c in names}).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    key = lambda d: sorted(map(tuple, merkle.tampered_manifest(d).collect()), key=str)
    assert key(more) == key(df)


def test_versions_share_what_they_do_not_copy():
    leaves = [h(str(i)) for i in range(11)]
    tree = merkle.BlockTree(leaves, merkle.height(len(leaves)))
    before = [list(r) for r in tree.rows]
    for i in range(11):
        version = tree.version(i, h("other"))
        assert len(version) == len(tree.rows) and tree.rows == before
        assert version[-1] == levels(leaves[:i] + [h("other")] + leaves[i + 1:])[-1][0]
        assert merkle.follow(tree.path(i), leaves[i])[-1] == before[-1][0]


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(6, 4 * q) and not any(all(w[k] == w[k - r] for k in range(s + r, s + size)) for r in range(1, q)):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 60), st.integers(1, 9))
def test_runs_equal_brute_force(words, a, p):
    if a < len(words):
        words = [words[i] if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i in range(len(words))]
    assert runs.word_runs(words) == brute_runs(words)
    assert sorted(runs.piece_runs(words), key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_last_ends_are_those_of_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        word = [rng.randrange(2) for _ in range(40)]
        automaton = runs.LastEnds()
        for i, x in enumerate(word):
            want = {}
            for size in range(1, i + 1):
                ends = [j for j in range(size - 1, i) if word[j - size + 1:j + 1] == word[i - size + 1:i + 1]]
                if ends:
                    want[ends[-1]] = size
            got = {}
            for j, size in automaton.append(x, i):
                got[j] = max(size, got.get(j, 0))
            assert got == want


def test_long_periodic_texts_stay_near_linear():
    base = [f"w{i % 977}" for i in range(60000)]
    assert runs.word_runs(base) == [(0, 60000, 977)]
    assert runs.word_runs(["a"] * 60000) == [(0, 60000, 1)]


def run_rows(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if crc % 10 == 0 and w:
            g = crc // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        found = brute_runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], h(lines),
                    sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_run_query_equals_brute_force(spark, make):
    rng = random.Random(8)
    texts = [t[:800] if t else t for t in ODD] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(200)]
    ids = [*range(len(texts) - 3), None, 5, 5]
    got = runs.run_digests(runs.with_planted_runs(make(texts, ids=ids).repartition(4))).collect()
    assert sorted(map(tuple, got), key=str) == run_rows(zip(ids, texts))


def test_runs_of_no_rows_and_of_clashing_columns(spark, make):
    assert runs.run_digests(runs.with_planted_runs(spark.createDataFrame([], DOCS))).collect() == []
    df = make(["a a a a a a a", "b"])
    more = df.withColumns({c: F.lit(1) for c in ("words", "g", "n", "a", "p", "runs", "collapsed", "best", "start")}).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    key = lambda d: sorted(map(tuple, runs.run_digests(runs.with_planted_runs(d)).collect()), key=str)
    assert key(more) == key(df)


def brute_counts(text):
    text = text or ""
    w = text.encode().split()
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = Counter(win)
    cover = {j for i, x in enumerate(win) if twice[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_text_counts_equal_brute_force(spark, make):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)] + ["x # y | z\n\nx # y | z\n \t\nq", "l1 w\nl1 w\nl1 w\nl2"]
    rows = quality_rules.apply_rules(make(texts)).collect()
    got = {r.doc_id: tuple(r)[1:6] for r in rows}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.outliers)


def test_sketch_quantiles_are_within_one_part_in_32(spark):
    rng = random.Random(5)
    values = [rng.randrange(40) for _ in range(500)] + [int(rng.lognormvariate(7, 2)) for _ in range(4000)] + [1 << 40] * 30
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality_rules.bucket(F.col("v")))
    for v, low, high in df.select("v", quality_rules.bucket_least(F.col("b")), quality_rules.bucket_least(F.col("b") + 1)).collect():
        assert low <= v < high and (high - low == 1 or (high - low) * 32 <= low)


def test_sketches_of_parts_add_up(spark, make):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "be", "GAMMA#"]) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 60))) for _ in range(120)]
    rows = quality_rules.text_counts(make(texts, sources=[f"s{i % 4}" for i in range(120)])).withColumns({"lang_key": F.col("lang"), "source_key": F.col("source")})
    own = quality_rules.sketches(rows, ["lang_key", "source_key"])
    key = lambda d: sorted(map(tuple, d.select("feature", "bucket", "n").collect()))
    assert key(quality_rules.merged(own, [])) == key(quality_rules.sketches(rows, []))


def test_thresholds_follow_their_group(spark, make):
    """A source full of symbols keeps them, the same text is an outlier elsewhere; a hot source and null groups included."""
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(40))
    code = lambda: " ".join("<&" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    texts, sources = [prose() for _ in range(300)] + [code() for _ in range(60)], ["hot"] * 300 + ["code"] * 60
    texts += [code(), code(), prose(), prose()]
    sources += ["hot", None, None, "rare"]
    df = make(texts, sources=sources)
    kept = {r.doc_id: (r.kept, r.outliers) for r in quality_rules.apply_rules(df, min_docs=50).collect()}
    assert all(kept[i][0] for i in range(360)) and kept[362][0] and kept[363][0]
    assert not kept[360][0] and "symbols" in kept[360][1] and not kept[361][0]


def test_rules_of_no_rows_and_of_clashing_columns(spark, make):
    assert quality_rules.apply_rules(spark.createDataFrame([], DOCS)).collect() == []
    df = make(ODD, ids=[None, 1, 1, *range(3, len(ODD))])
    names = ("_words", "_win", "_lines", "_ranked", "_starts", "n_words", "lang_key", "source_key", "_salt", "base_failed", "kept", "symbols_low")
    more = df.withColumns({c: F.lit("x") for c in names}).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    key = lambda d: sorted(map(tuple, quality_rules.apply_rules(d).collect()), key=str)
    assert key(more) == key(df)


def test_rules_run_without_python_workers(spark, make):
    df = make(ODD)
    plan = quality_rules.apply_rules(df)._jdf.queryExecution().toString() + quality_rules.text_counts(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
