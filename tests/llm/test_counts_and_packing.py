"""Token counts, packing, secrets and exact dedup against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from barlab.llm import exact_dedup, packing, secrets, token_counts
from tests.llm.conftest import ODD


def tokens_of(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


def test_token_counts_match_the_library(odd):
    got = {r.doc_id: r for r in token_counts.token_counts(odd, P.path("byte_bpe_50k.json"), P.PATTERN, ["<|endoftext|>"], limit=100).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        want = len(tokens_of("byte_bpe_50k.json", t))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 100), (i, t)


def test_token_counts_of_repeated_null_and_no_rows(make):
    df = make(["a b", "a b", "c"], ids=[1, 1, None])
    args = (P.path("byte_bpe_50k.json"), P.PATTERN, ["<|endoftext|>"])
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(df, *args).collect()) == [("1", 2), ("1", 2), ("None", 1)]
    assert token_counts.token_counts(df.limit(0), *args).count() == 0


def test_pre_tokens_join_up_to_the_text():
    split = token_counts.pre_tokens(P.PATTERN, ["<|endoftext|>"])
    for t in ODD:
        assert "".join(split(t)) == (t or "")


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_is_a_round_trip(odd, size):
    rows = packing.pack_sequences(odd, P.path("word_bpe_49k.json"), size=size).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(ODD):
        ids = np.array(tokens_of("word_bpe_49k.json", t) + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes()), (i, t)
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == parts[0].sequence_tokens and (at == size or at & (at - 1) == 0)


def test_a_full_chunk_table_keeps_what_is_used_again():
    import pyarrow as pa

    table, path, learned = packing.ChunkIds(P.path("word_bpe_49k.json"), limit=120), P.path("word_bpe_49k.json"), []
    learn = table.learn
    table.learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    tk = Tokenizer.from_file(path)
    for block in range(12):
        texts = [" ".join(f"Common{i},x" for i in range(30)), " ".join(f"rare{block}of{i}" for i in range(40)), "", None, "caf\u00e9\u2003x"]
        ids, tokens = table.encode(pa.array(texts, pa.string()), 1)
        want = [tk.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert ids.tolist() == sum(want, []) and tokens.tolist() == list(map(len, want))
        assert len(table.slot) <= 120
    assert all(learned.count(b"Common%d,x" % i) == 1 for i in range(30))


def test_packing_prefers_the_cheapest_sequence():
    pieces, cost = packing.pack_block(np.array([60, 60, 30, 30, 10, 10]), 100, 1.0, 0.01)
    assert len(cost) == 2 and {p[3] for p in pieces[:2]} == {0, 1} and cost.max() / cost.min() < 1.05


def test_secret_base_spans_and_ownership(odd, make):
    got = {r.doc_id: r for r in secrets.scan_secrets(odd).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        found = sorted(((s, secrets.KINDS.index(k), f"{k}:{s}:{e}") for k, s, e, _ in secrets.base_spans(t or "")))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest()
        assert set(f[2] for f in found) <= set(got[i].spans.split(","))
    assert (got[24].n_assign, got[25].n_access, got[26].n_hex) == (3, 1, 1)
    assert got[27].n_assign == 1 and got[27].spans.count("owned") == 1
    bare = "value Zx81mQ02kLp93vBn47TsRd55 here"
    one = {r.doc_id: r for r in secrets.scan_secrets(make([bare, bare, "x"], sources=["a", "a", "b"])).collect()}
    two = {r.doc_id: r for r in secrets.scan_secrets(make([bare, bare, "x"], sources=["a", "b", "b"])).collect()}
    assert (one[0].spans, one[0].n_live) == ("owned:6:30", 1) and (two[0].spans, two[0].n_live, two[0].n_copied) == ("", 0, 1)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_exact_groups(odd, make, bits):
    df = odd.union(make(["Hello world", "q", None], ids=[100, None, 101]))
    texts = {i: t or "" for i, t in enumerate(ODD)} | {100: "Hello world", None: "q", 101: ""}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    rows = exact_dedup.exact_groups(df, bits).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = groups[texts[r.doc_id]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_exact_copies(df, bits)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert exact_dedup.exact_groups(df.limit(0), bits).count() == 0
