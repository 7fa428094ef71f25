"""N-gram join, suffix dedup, decontamination and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import decontaminate, ngram_join, suffix_dedup
from barlab.llm.common import components
from tests.llm.conftest import ODD


def brute_components(texts, ids):
    sets = {}
    for i, t in zip(ids, texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 3
    return " ".join(w)


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [a + b for a in "bcdfgklm" for b in ("a", "en", "ist", "or", "ung")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out, shared = [], text(60)
    for n in (1, 3, 5, 6, 8, 12, 20, 45, 90, 300, 700):
        base = text(n)
        out += [base, base.upper(), base + " " + text(1)] + [edited(rng, base, k) for k in range(1, 1 + max(1, n // 60)) for _ in range(3)]
        out += [edited(rng, base, max(1, n // 12)) for _ in range(2)]
    out += [text(40) + " " + shared + " " + text(40) for _ in range(25)]
    chain = text(80).split()
    out += [" ".join(chain[:k] + ["z"] * (80 - k)) for k in range(80, 40, -3)]
    return out


def test_components_equal_brute_force(make):
    texts = corpus() + ODD
    ids = list(np.random.default_rng(1).permutation(len(texts)) * 7 + 3)
    ids = [int(i) for i in ids]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(make(texts, ids=ids).repartition(3)).collect()}
    assert got == brute_components(texts, ids)


def test_block_pairs_lose_no_link(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 4)  # large groups are compared block against block
    texts = corpus(9)
    ids = list(range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(make(texts, ids=ids)).collect()}
    assert got == brute_components(texts, ids)


def test_sketch_keys_meet_for_every_similar_pair():
    rng, bands = np.random.default_rng(3), ngram_join.Bands(75, 100)
    for n in list(range(1, 60)) + [200, 997]:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = rng.integers(0, max(1, n // 7) + 1)
        add = rng.integers(0, max(1, n // 7) + 1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= 75 * (len(a) + len(b) - inter):
            assert np.intersect1d(ngram_join.range_keys(a, bands), ngram_join.range_keys(b, bands)).size
            sketch = [np.frombuffer(ngram_join.bit_sketch(x), np.uint8) for x in (a, b)]
            assert ngram_join.near_enough(sketch[0], len(a), sketch[1], len(b), 75, 100)


def test_join_of_null_and_repeated_ids_and_no_rows(make):
    df = make(["a b c d e", "a b c d e", "a b c d e", None], ids=[4, 4, None, 2])
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(df).collect())
    assert rows == [("2", 0, "2"), ("4", 1, "4"), ("4", 1, "4"), ("None", 1, "None")]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(1) for c in ("n", "h1", "key", "component", "class_id", "sketch", "bit", "repeats", "label", "weight")})
    kept = ngram_join.drop_near_copies(clash)
    assert kept.count() == 4 and kept.columns == clash.columns


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got.get(n, n) == min(seen)


def brute_trim(texts, ids, length):
    seen, out = set(), {}
    for i, t in sorted(zip(ids, texts)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k:k + length] in seen:
                gone[k:k + length] = b"\1" * length
        seen |= {b[k:k + length] for k in range(len(b) - length + 1)}
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [32, 0])
def test_suffix_dedup_equals_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    long = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [f"{' '.join(word() for _ in range(9))} {rng.choice(long)[rng.randrange(9):rng.randrange(60, 300)]} {rng.choice(long)}" for _ in range(40)]
    texts += ["ab" * 200, "ab" * 40 + "c" + "ab" * 60, "x" * 49, "x" * 50, "x" * 51, "y" * 500] + ODD + long[:2]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_copies(make(texts, ids=ids).repartition(3)).collect()}
    assert got == brute_trim(texts, ids, 50)


def test_suffix_dedup_of_null_and_repeated_ids_and_no_rows(make):
    t = "the quick brown fox jumps over the lazy dog and runs away again"
    rows = suffix_dedup.remove_copies(make([t, t, t, None], ids=[3, 3, None, 5]), with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept).decode()) for r in rows) == [("3", 0, t), ("3", 0, t), ("5", 0, ""), ("None", 0, t)]
    assert suffix_dedup.remove_copies(make([t], ids=[1]).limit(0)).count() == 0


def test_suffix_dedup_removes_the_shuffle_files_of_what_it_has_stored(spark, make, monkeypatch):
    from barlab.llm import common

    key, stored, plain = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], common.store
    before = spark.conf.get(key)
    monkeypatch.setattr(common, "store", lambda df, tag: (stored.append((tag, spark.conf.get(key))), plain(df, tag))[1])
    t = "the quick brown fox jumps over the lazy dog and runs away again"
    rows = suffix_dedup.remove_copies(make([t, t, "other words"], ids=[3, 4, 5]))
    assert stored == [("anchors", "true"), ("ranges", "true")] and spark.conf.get(key) == before
    assert sorted((r.doc_id, r.n_removed) for r in rows.collect()) == [(3, 0), (4, len(t)), (5, 0)]


def test_a_pair_with_many_common_keys_is_compared_once(spark):
    rng = random.Random(2)
    sketch, members = bytearray(64), {k: rng.sample(range(60), 25) for k in range(50)}  # several blocks and buckets of keys
    rows = [(k * 1000003, d, 100, sketch, d, len(ds)) for k, ds in members.items() for d in ds]
    groups = spark.createDataFrame(rows, "key long, doc_id long, n long, sketch binary, component long, size long")
    got = [(r.a, r.b) for r in ngram_join.crossing_pairs(groups, 75, 100).collect()]
    want = {(a, b) for ds in members.values() for a in ds for b in ds if a < b}
    assert set(got) == want
    assert len(got) < 1.2 * len(want)  # 15,000 pairs in the keys


def test_suffix_dedup_sorts_a_bucket_in_parts():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    shared = rng.integers(97, 117, 3000).astype(np.uint8).tobytes()
    texts = [shared[k:k + 1500] + rng.integers(97, 117, 1000).astype(np.uint8).tobytes() for k in rng.integers(0, 1500, 800)]
    rows = pa.table([pa.array(range(800)), pa.array([0] * 800, pa.uint32()), pa.array([7] * 800, pa.int32()), pa.array(texts, pa.binary())], names=["doc_id", "mark", "begin", "text"])
    tracemalloc.start()
    doc, mark, begin, end = suffix_dedup.later_copies(rows, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first, want = {}, set()
    for d, t in enumerate(texts):
        for b in range(len(t) - 49):
            if first.setdefault(t[b:b + 50], d) < d:
                want.add((d, b + 7))
    assert set(zip(doc.tolist(), begin.tolist())) == want and (end == begin + 50).all() and len(doc) == len(want)
    assert peak < 80 * sum(map(len, texts))  # 144 bytes each with all windows laid out at once


def test_longest_previous_factor_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        doc, lcp = rng.integers(0, 6, n), np.concatenate([[0], rng.integers(0, 9, n - 1)])
        want = [max([min(lcp[min(i, j) + 1:max(i, j) + 1]) for j in range(n) if doc[j] < doc[i]] or [0]) for i in range(n)]
        got = suffix_dedup.longest_previous_factor(doc, lcp, 4)
        assert [w if w >= 4 else 0 for w in want] == got.tolist()


def test_decontamination_finds_copies_and_paraphrases(spark, make):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(25) + ". " + say(8) + "." for _ in range(12)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = [say(rng.randrange(0, 300)) for _ in range(60)]
    exact = [say(90) + "\n" + items[k].upper() + " " + say(70) for k in range(6)]
    loose = [say(50) + " " + " ".join(w for j, w in enumerate(items[k].split()) if j % 5 or j > 24) + " " + say(50) for k in range(6, 10)]
    docs = make(clean + exact + loose + ODD)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == {(60 + k, k) for k in range(10)}
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(clean + exact + loose + ODD))) - {60 + k for k in range(10)}
    assert decontaminate.contaminated_pairs(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_short_copies_among_words_of_no_item(make, spark):
    rng = random.Random(8)
    words = [f"common{i}" for i in range(45)]
    items = [" ".join(words[k * 15:k * 15 + 15]) for k in range(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = lambda n: [f"other{rng.randrange(10 ** 6)}" for _ in range(n)]
    clean = []
    for _ in range(60):  # the items' words are in nearly all documents, those around a copy in none: so it is in a large corpus
        mixed = words + other(200)
        rng.shuffle(mixed)
        clean.append(" ".join(mixed))
    copies = [" ".join([*other(60), item, *other(60)]) for item in items]
    near = [" ".join([*other(60), *(w for j, w in enumerate(item.split()) if j not in (3, 9)), *other(60)]) for item in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(make(clean + copies + near), bench).collect()}
    assert got == {(60 + k, k % 3) for k in range(6)}


def test_overlaps_lose_no_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(40):
        item = rng.integers(0, 12, rng.integers(1, 20))
        term = rng.integers(-1, 30, 300)
        before = np.array([0, 0, 130, 131, 300])
        doc, first, end = decontaminate.passages(before)
        has = np.zeros(31, np.int8)
        has[item] = 1
        at, _ = decontaminate.overlaps(term, before, doc, first, end, has, len(item), 0.5)
        for p in range(len(doc)):
            text = term[max(before[doc[p]], first[p] - len(item)):min(before[doc[p] + 1], end[p] + len(item))]
            assert decontaminate.lcs(item, text) < 0.5 * len(item) or p in at


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]
