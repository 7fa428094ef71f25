"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import KEPT, slices, text_bytes, tokenizer, word_strings

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, sequence_cost double")


#: First bytes of the white space outside ASCII.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class ChunkIds:
    """Token ids of texts through a table of distinct chunks between white space, for tokenizers that drop white space.

    A chunk is encoded once per worker while it stays in the table. At ``limit`` chunks those of a single block leave it; of
    the others the most used stay, half the limit at most.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tk = tokenizer(path)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used, self.ends, self.uses = 0, np.zeros(1, np.int64), np.zeros(0, np.int64)

    def make_room(self) -> None:
        again = np.flatnonzero(self.uses > 1)
        if len(again) > self.limit // 2:
            again = np.sort(again[np.argsort(-self.uses[again], kind="stable")[:self.limit // 2]])
        chunks = list(self.slot)  # in the order of their slots
        size = np.diff(self.ends)[again]
        last = np.cumsum(size)
        source = np.arange(int(size.sum())) + np.repeat(self.ends[again] - (last - size), size)
        self.slot = {chunks[i]: k for k, i in enumerate(again.tolist())}
        self.ids[:len(source)] = self.ids[source]
        self.used, self.ends, self.uses = len(source), np.append(0, last), (self.uses[again] + 1) // 2

    def learn(self, chunks: list[bytes]) -> None:
        counts = []
        for s in range(0, len(chunks), 1024):
            part = chunks[s:s + 1024]
            texts = [c.decode() for c in part]
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            e = self.tk.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            where = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
            starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
            count = np.bincount(np.searchsorted(starts, where, side="right") - 1, minlength=len(part))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used:self.used + len(ids)] = ids
            counts.append(count)
            self.used += len(ids)
        if chunks:
            self.slot.update(zip(chunks, range(len(self.slot), len(self.slot) + len(chunks))))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts)))
            self.uses = np.append(self.uses, np.zeros(len(chunks), np.int64))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end, each document followed by ``end_id``, and the tokens of each document.

        Chunks are parted at ASCII white space; a text with other white space is given to the tokenizer as a whole.
        """
        raw, at = text_bytes(column)
        rows = len(at) - 1
        odd = np.unique(np.searchsorted(at, wide_spaces(raw), side="right") - 1)
        words, before = word_strings(raw, at, lower=False)
        row = np.repeat(np.arange(rows), np.diff(before))
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        new = [w for w in known if w not in self.slot]
        if len(self.slot) + len(new) > self.limit:
            self.make_room()
            new = [w for w in known if w not in self.slot]
        self.learn(new)
        ends = self.ends
        slot = np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))
        self.uses[slot] += 1
        first, size = ends[slot], np.diff(ends)[slot] if len(known) else slot
        code = coded.indices.to_numpy().astype(np.int64)
        if len(odd):
            keep = ~np.isin(row, odd)
            row, code = row[keep], code[keep]
        sizes = size[code]
        per_doc = np.bincount(row, sizes, rows).astype(np.int64)
        source = np.arange(int(sizes.sum())) + np.repeat(first[code] - (np.cumsum(sizes) - sizes), sizes)
        whole = {int(i): np.array(self.tk.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in odd}
        for i, v in whole.items():
            per_doc[i] = len(v)
        out = np.full(int(per_doc.sum()) + rows, end_id, np.uint32)
        body = np.ones(len(out), bool)
        last = np.cumsum(per_doc + 1) - 1
        body[last] = False
        for i, v in whole.items():
            out[last[i] - len(v):last[i]] = v
            body[last[i] - len(v):last[i]] = False
        out[body] = self.ids[source]
        return out, per_doc + 1


def wide_spaces(raw: np.ndarray) -> np.ndarray:
    """Places of Unicode white space outside ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    lead = np.flatnonzero(_LEADS[raw])
    if not len(lead):
        return lead
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return lead[hit]


def capacities(total: int, size: int) -> list[int]:
    """Sequence capacities that hold exactly ``total`` tokens: full ones, then powers of two, which need no padding."""
    caps, rest = [size] * (total // size), total % size
    while rest:
        caps.append(1 << (rest.bit_length() - 1))
        rest -= caps[-1]
    return caps


def pack_block(tokens: np.ndarray, size: int, linear: float, quadratic: float):
    """Assign documents to sequences: (document, start, length, sequence, offset) per piece, and the cost of each sequence.

    Full sequences are cut off long documents first. What is left goes, in descending cost, to the sequence of lowest
    cost with room; when none has room for all of it, it is cut over the sequences with the most room.
    """
    cost = lambda n: linear * n + quadratic * n * n
    pieces, costs = [], []
    full = tokens // size
    for d in np.flatnonzero(full):
        for j in range(int(full[d])):
            pieces.append((d, j * size, size, len(costs), 0))
            costs.append(cost(size))
    rest = tokens - full * size
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    room = np.array(capacities(int(rest.sum()), size), np.int64)
    used, load = np.zeros(len(room), np.int64), np.zeros(len(room))
    base = len(costs)
    for d in order:
        at, left = int(full[d]) * size, int(rest[d])
        while left:
            fit = np.where(room >= left, load, np.inf)
            s = int(fit.argmin())
            take = left
            if fit[s] == np.inf:
                s = int(room.argmax())
                take = int(room[s])
            pieces.append((d, at, take, base + s, int(used[s])))
            used[s] += take
            room[s] -= take
            load[s] += cost(take)
            at, left = at + take, left - take
    return pieces, np.concatenate([costs, load]) if len(load) else np.array(costs)


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, linear: float = 1.0,
                   quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row per piece of a document (doc_id, text; other columns are ignored), with its sequence and offset.

    Every row of ``docs`` gives at least one piece: a null or empty text is its end token alone. The sequences of a block
    (a run of rows of one input split, a few MB of text) are independent of other blocks, so nothing is shuffled and a
    lost task is simply rerun; ids are ``split << 32 | block << 20 ...`` and thus unique. A sequence is full or its
    length is a power of two.
    """

    def pack(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids_of = chunk_table(tokenizer_path)
        for batch in slices(batches, max_bytes=4 << 20):
            ids, tokens = ids_of.encode(batch.column("text"), end_id)
            pieces, cost = pack_block(tokens, size, linear, quadratic)
            start = np.cumsum(tokens) - tokens
            p = np.array(pieces, np.int64).reshape(-1, 5)
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = start[p[:, 0]] + p[:, 1]
            crc = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), p[:, 2].tolist())]
            held = np.bincount(p[:, 3], p[:, 2], len(cost)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(p[:, 0])), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(crc, pa.int64()),
                 pa.array(tokens[p[:, 0]]), pa.array((part << 40) + k + p[:, 3]), pa.array(p[:, 4]),
                 pa.array(held[p[:, 3]]), pa.array(cost[p[:, 3]])],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
            k += len(cost)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, SCHEMA)


_TABLES: dict[str, ChunkIds] = {}
KEPT.append(_TABLES)


def chunk_table(path: str) -> ChunkIds:
    """The worker's table for a tokenizer file; Spark reuses workers, so later tasks find the chunks of earlier ones."""
    if path not in _TABLES:
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]
