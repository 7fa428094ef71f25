"""Token counts from distinct pre-tokens: pieces are counted once per distinct pre-token and no ids are kept."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import tokenizer
from barlab.llm.postings import in_chunks, postings, weighted_sums

_RUN = re.compile(r"\s\s|\x00|[\x1c-\x1f]")


def pre_tokens(pattern: str, special: list[str]) -> Callable[[str | None], list[str]]:
    """Split a text where byte-level BPE never merges.

    White space of one character parts the text at once: a space opens the next piece, a line feed stands alone. A text
    with longer runs of white space goes through the tokenizer's own splitting pattern. Pieces join up to the text.
    """
    import regex

    rule = regex.compile(pattern)
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def split(text: str | None) -> list[str]:
        if not text:
            return []
        if not _RUN.search(text):
            return [p for p in text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if p]
        if marks is None:
            return rule.findall(text)
        out, at = [], 0
        for m in marks.finditer(text):
            out += rule.findall(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + rule.findall(text[at:])

    return split


def piece_counter(tokenizer_path: str) -> Callable:
    """A task's table of distinct pre-tokens: each is encoded once, whatever number of blocks and documents hold it."""

    def start():
        tk = tokenizer(tokenizer_path)
        known: dict[bytes, int] = {}

        def pieces(words: pa.Array) -> list[np.ndarray]:
            keys = words.to_pylist()
            new = list({k for k in keys if k not in known})
            for s in range(0, len(new), 1024):
                part = new[s:s + 1024]
                known.update(zip(part, (len(e.ids) for e in tk.encode_batch([k.decode() for k in part], add_special_tokens=False))))
            return [np.fromiter((known[k] for k in keys), np.float64, len(keys))]

        return pieces

    return start


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, special: list[str], limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted row by row.
    The tokenizer file must be readable at the same path on every executor.
    """
    carry = {"doc_id": "long", "n_bytes": "long"}

    def head(batch, lens):
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        return {"doc_id": batch.column("doc_id").to_pylist(), "n_bytes": size}

    split = pre_tokens(pattern, special)
    posted = postings(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), in_chunks(split, pa.string()), carry, head, salts=16)
    sums = weighted_sums(posted, ["pieces"], carry, piece_counter(tokenizer_path), "int")
    return sums.select("doc_id", "n_bytes", F.col("pieces").cast("long").alias("n_tokens"), (F.col("pieces") > limit).alias("over_limit"))
