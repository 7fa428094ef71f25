"""Per-document word frequencies as compact postings, summed against values of the words.

A *block* is a run of rows of one input split. Within a block every distinct word has one entry: the ordinals of the
documents that hold it and how often. The entries of a block are dealt to buckets by the word's hash and travel as one
compressed Arrow batch per (block, bucket), so a (word, document) pair costs a few bytes. Where a bucket's payloads meet, each
distinct word gets its value once; the products come back summed per (block, document). A word's entries in one bucket
number at most one per block, and of all pairs a word can hold only one per document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barlab.llm.common import BLOCK_ROWS, U64, binary_rows, give_back, mix, scratch_partitions, slices

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
#: A word in more than this share of a block's documents is dealt over several buckets, if the caller allows it.
FREQUENT = 16
#: Text of a block.
BLOCK_BYTES = 3 << 20
CHUNK_ROWS = 128


def binary_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the values of a binary column."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]].astype(U64) + U64(1) if data is not None else np.zeros(0, U64)
    at -= at[0]
    size = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1], size)
    raw *= (mix(np.arange(1, int(size.max(initial=0)) + 1, dtype=U64)) | U64(1))[place]
    total = np.concatenate([np.zeros(1, U64), np.cumsum(raw, dtype=U64)])
    return mix(total[at[1:]] - total[at[:-1]])


def in_chunks(split: Callable, kind: pa.DataType) -> Callable:
    """``words_of`` from a function of one text; few texts exist as lists of words at a time."""

    def words_of(batch: pa.RecordBatch):
        lens, parts = [], []
        for s in range(0, batch.num_rows, CHUNK_ROWS):
            lists = [split(t) for t in batch.column("text").slice(s, CHUNK_ROWS).to_pylist()]
            lens += [len(ws) for ws in lists]
            parts.append(pa.array([w for ws in lists for w in ws], kind))
        return pa.concat_arrays(parts), np.repeat(np.arange(batch.num_rows), lens)

    return words_of


def pack(batch: pa.RecordBatch, level: int | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def postings(docs: DataFrame, words_of: Callable, carry: dict[str, str], header: Callable, tally: Callable | None = None,
             salts: int = 1) -> DataFrame:
    """(block, bucket, payload) for the words of ``words_of(batch) -> (words, row of each)``, and one header row per block with a
    null payload.

    ``header(batch, words per row) -> dict`` gives one list per column of ``carry`` (name -> Spark type), an array column of the
    header row. ``tally(batch)`` marks documents; a payload's ``tally`` is the word's frequency in the marked ones. The payloads
    hold word, ords (uint16) and freqs (uint8); a frequency over 255 takes several entries.
    """
    buckets = scratch_partitions(docs)
    schema = ", ".join(["block long", "bucket long", "payload binary", *(f"{k} array<{v}>" for k, v in carry.items())])
    names = ["block", "bucket", "payload", *carry]

    def emit(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, max_bytes=BLOCK_BYTES):
            block = (part << 32) | k
            k += 1
            n = batch.num_rows
            found, row = words_of(batch)
            head = header(batch, np.bincount(row, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([block % buckets]), pa.array([None], pa.binary()), *(pa.array([list(head[c])], pa.list_(KINDS[v])) for c, v in carry.items())],
                names=names)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            del found
            words = coded.dictionary.cast(pa.binary())
            key = coded.indices.to_numpy().astype(np.int64) * BLOCK_ROWS + row
            key.sort()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            freq = np.diff(np.append(at, len(key)))
            key = key[at]
            marked = freq if tally is None else freq * tally(batch)[key % BLOCK_ROWS]
            marked = np.bincount(key // BLOCK_ROWS, marked, len(words)).astype(np.int64)
            parts = (freq + 254) // 255
            if parts.max() > 1:
                rest = freq - 255 * (parts - 1)
                key, last = np.repeat(key, parts), np.cumsum(parts) - 1
                freq = np.full(len(key), 255)
                freq[last] = rest
            counts = np.bincount(key // BLOCK_ROWS, minlength=len(words))
            cols = [words, binary_rows((key % BLOCK_ROWS).astype(np.uint16), counts), binary_rows(freq.astype(np.uint8), counts)]
            whole = pa.RecordBatch.from_arrays([*cols, *([pa.array(marked)] if tally else [])], names=["word", "ords", "freqs", *(["tally"] if tally else [])])
            hashes = binary_hashes(words)
            if salts > 1:
                hashes = np.where(counts * FREQUENT > n, mix(hashes + U64(block % salts)), hashes)
            bucket = (hashes % U64(buckets)).astype(np.int64)
            order = pc.sort_indices(pa.table({"b": pa.array(bucket), "w": words}), sort_keys=[("b", "ascending"), ("w", "ascending")])
            whole, bucket = whole.take(order), bucket[order.to_numpy()]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            payload = [pack(whole.slice(s, e - s)) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(payload), block)), pa.array(bucket[cuts[:-1]]), pa.array(payload, pa.binary()), *(pa.nulls(len(payload), pa.list_(KINDS[v])) for v in carry.values())],
                names=names)
            del whole, words, payload, key, freq
            give_back()

    return docs.mapInArrow(emit, schema)


def dealt(posted: DataFrame) -> DataFrame:
    """The payloads of a bucket in one task, block after block; block -1, if there is one, comes first."""
    return posted.repartition(scratch_partitions(posted), "bucket").sortWithinPartitions("block")


def weighted_sums(posted: DataFrame, value_cols: list[str], carry: dict[str, str], values_of: Callable, kind: str = "double") -> DataFrame:
    """One row per document: its header columns and, for each value column, sum(frequency * value of the word).

    ``values_of()`` is called once per task and gives a function (words) -> one array per value column; payloads of
    block -1 are handed to its attribute ``load`` first. ``kind`` is the type in which partial sums travel ('int' for counts,
    'double' for logarithms).
    """
    dtype = {"int": np.int32, "double": np.float64}[kind]
    schema = ", ".join(["block long", "ords binary", *(f"{c} binary" for c in value_cols), *(f"{k} array<{v}>" for k, v in carry.items())])
    names = ["block", "ords", *value_cols, *carry]

    def partial(batches):
        acc, now, values = None, None, values_of()

        def flush():
            hit = np.flatnonzero(acc.any(axis=0))
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([hit.astype(np.uint16).tobytes()]), *(pa.array([acc[i, hit].astype(dtype).tobytes()]) for i in range(len(value_cols))),
                 *(pa.nulls(1, pa.list_(KINDS[v])) for v in carry.values())], names=names)

        for batch in batches:
            is_head = pc.is_null(batch.column("payload"))
            heads = batch.filter(is_head)
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [heads.column("block"), *[pa.nulls(heads.num_rows, pa.binary())] * (1 + len(value_cols)), *(heads.column(c) for c in carry)], names=names)
            batch = batch.filter(pc.invert(is_head))
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                entries = unpack(payload.as_buffer())
                if block < 0:
                    values.load(entries)
                    continue
                if now != block:
                    if now is not None:
                        yield flush()
                    now, acc = block, np.zeros((len(value_cols), BLOCK_ROWS))
                ords = np.frombuffer(b"".join(entries.column("ords").to_pylist()), np.uint16)
                freq = np.frombuffer(b"".join(entries.column("freqs").to_pylist()), np.uint8)
                m = pc.binary_length(entries.column("freqs")).to_numpy()
                for j, v in enumerate(values(entries.column("word").combine_chunks())):
                    acc[j] += np.bincount(ords, np.repeat(v, m) * freq, BLOCK_ROWS)
        if now is not None:
            yield flush()
        del values
        give_back()

    def finish(key, group):
        ords, parts = group.column("ords").to_pylist(), [group.column(c).to_pylist() for c in value_cols]
        head = next([group.column(c)[i].as_py() for c in carry] for i, o in enumerate(ords) if o is None)
        total = np.zeros((len(value_cols), len(head[0])))
        for i, o in enumerate(ords):
            if o is not None:
                at = np.frombuffer(o, np.uint16)
                for j in range(len(value_cols)):
                    total[j, at] += np.frombuffer(parts[j][i], dtype)
        return pa.table([*(pa.array(h, KINDS[v]) for h, v in zip(head, carry.values())), *(pa.array(t) for t in total)], names=[*carry, *value_cols])

    out = ", ".join([*(f"{k} {v}" for k, v in carry.items()), *(f"{c} double" for c in value_cols)])
    return dealt(posted).mapInArrow(partial, schema).groupBy("block").applyInArrow(finish, out)


def word_counts(posted: DataFrame, top: int) -> DataFrame:
    """Per task: (bucket, block -1, payload of word and c, n = sum of c, v = words with c > 0, best = the ``top`` most
    frequent words) from the tallies of ``posted``. A task holds the distinct words of its buckets."""

    def count(batches):
        held: dict[int, dict[bytes, int]] = {}
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                entries = unpack(payload.as_buffer())
                counts = held.setdefault(bucket, {})
                for w, c in zip(entries.column("word").to_pylist(), entries.column("tally").to_pylist()):
                    counts[w] = counts.get(w, 0) + c
        for bucket, counts in held.items():
            words, c = pa.array(list(counts), pa.binary()), np.fromiter(counts.values(), np.int64, len(counts))
            seen = [(-k, w) for w, k in counts.items() if k]
            import heapq

            best = [{"word": w, "c": -k} for k, w in heapq.nsmallest(top, seen)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1]), pa.array([bucket]), pa.array([pack(pa.RecordBatch.from_arrays([words, pa.array(c)], names=["word", "c"]))]),
                 pa.array([int(c.sum())]), pa.array([int((c > 0).sum())]), pa.array([best], pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64())])))],
                names=["block", "bucket", "payload", "n", "v", "best"])

    return dealt(posted.where("payload is not null").select("block", "bucket", "payload")).mapInArrow(
        count, "block long, bucket long, payload binary, n long, v long, best array<struct<word:binary,c:long>>")
