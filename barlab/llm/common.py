"""Helpers shared by the text operators: table access, scratch tables, batch slicing, word hashing, components."""

from __future__ import annotations

import ctypes
import inspect
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_ROWS = 4096
BLOCK_BYTES = 2 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a local master without it (tests) gets one of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_alone(df: DataFrame, tag: str) -> DataFrame:
    """``store``, after which Spark removes the shuffle files that it needed: what is stored takes their place on disk."""
    key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return store(df, tag)
    finally:
        conf.set(key, before)


def scratch_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle by key: what the session sets, never fewer than the input's splits."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_share(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES,
           max_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds at most ``max_rows`` rows and, beyond its first row, ``max_bytes`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = end[start - 1] if start else 0
            stop = int(np.searchsorted(end, base + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end (nulls: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "")
    column = pa.concat_arrays([column]) if column.offset else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A coarser split: words are letters, digits and all bytes of non-ASCII characters; everything else separates.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row, the words before each row, and their first bytes.

    Words are runs of bytes outside ``space``, by default ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased; with ``prefix`` only that
    many bytes of a word count.

    Each byte is multiplied by a random odd number of its place in the word and the products are summed, so equal
    words get equal hashes whatever row or position they stand in.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    inside = ~space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, U64), before, starts
    wide = np.int32 if n < 1 << 31 else np.int64
    place = np.arange(n, dtype=wide) - starts.astype(wide)[np.maximum(np.cumsum(first, dtype=wide) - 1, 0)]
    longest = int(place[inside].max()) + 1
    weights = mix(np.arange(1, longest + 1, dtype=U64)) | U64(1)
    value = (_LOWER[raw] if lower else raw).astype(U64) + U64(1)
    value *= weights[np.where(inside, place, 0)]
    value[~inside if prefix is None else ~inside | (place >= prefix)] = 0
    return mix(np.add.reduceat(value, starts)), before, starts


def word_strings(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every row as one binary column, and the words before each row."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    data = (_LOWER[raw] if lower else raw)[inside]
    sizes = np.add.reduceat(inside.astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words, np.searchsorted(starts, at)


def binary_rows(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next ``counts[i]`` items of ``data``."""
    at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Alternates large-star and small-star rounds. A node's neighbours are never gathered in one place,
    only their minimum is, with partial aggregation. Every round is written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    last = None
    while True:
        around = both(e)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e1 = large.where("a <> b").distinct()
        down = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(down, "a")
        e2 = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        e = store(e2.where("a <> b").distinct(), tag)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last = now
    low = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return low.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


_TOKENIZERS: dict = {}
#: What workers keep from one task to the next.
KEPT: list[dict] = [_TOKENIZERS]


def tokenizer(path: str):
    """The worker's tokenizer for a file, loaded once and kept to one thread: a task has one core."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        tk.no_truncation()
        tk.no_padding()
        _TOKENIZERS[path] = tk
    return _TOKENIZERS[path]


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the system; Spark reuses workers for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def forget() -> None:
    """Begin a task in a reused worker without the tokenizers and tables that other operators left in it."""
    for tables in KEPT:
        tables.clear()
    give_back()


def frugal(task):
    """``task`` of ``mapInArrow`` (a generator) or ``applyInArrow`` (table, or key and table) such that a worker that waits
    for its next task holds none of its memory."""

    def ended(*args):
        try:
            return task(*args)
        finally:
            give_back()

    def run(batches):
        forget()
        try:
            yield from task(batches)
        finally:
            give_back()

    if inspect.isgeneratorfunction(task):
        return run
    # Spark counts the arguments
    return (lambda key, table: ended(key, table)) if len(inspect.signature(task).parameters) == 2 else (lambda table: ended(table))


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or with underscores added a name that no column has."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
