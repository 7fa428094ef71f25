"""Exact dedup behind a two-pass Bloom filter: only rows that may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlab.llm.common import store

WORD_BITS = 64
SEGMENT_WORDS = 256


def bit_segments(bits: DataFrame) -> DataFrame:
    """(segment, words) of a bit filter from its set bits (column ``bit``, each once)."""
    words = bits.groupBy((F.col("bit") / WORD_BITS).cast("long").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(bit % {WORD_BITS} as int))")).alias("v"))
    segment = (F.col("w") / SEGMENT_WORDS).cast("long")
    return words.groupBy(segment.alias("segment")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("w") % SEGMENT_WORDS).cast("int").alias("k"), "v"))).alias("m")
    ).select("segment", F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("words"))


def seen_twice(hashes: DataFrame, filter_bits: int) -> DataFrame:
    """First pass: the filter bits that two or more rows set. ``hashes``: one long column ``h``.

    The bits are counted with partial aggregation; the table has at most ``filter_bits`` bits whatever the input.
    """
    bit = F.pmod(F.col("h"), F.lit(filter_bits))
    return bit_segments(hashes.groupBy(bit.alias("bit")).agg(F.count("*").alias("n")).where("n > 1").select("bit"))


def may_repeat(df: DataFrame, segments: DataFrame, h: Column, filter_bits: int) -> DataFrame:
    """Second pass: ``df`` with ``__repeats``, false only for rows whose hash occurs once. The filter is broadcast; its size
    is bounded by ``filter_bits`` / 8 bytes by construction."""
    bit = F.pmod(h, F.lit(filter_bits))
    word = (bit / WORD_BITS).cast("long")
    probed = df.withColumn("__segment", (word / SEGMENT_WORDS).cast("long")).withColumn("__k", (word % SEGMENT_WORDS).cast("int")).withColumn(
        "__b", (bit % WORD_BITS).cast("int"))
    joined = probed.join(F.broadcast(segments.withColumnRenamed("segment", "__segment").withColumnRenamed("words", "__words")), "__segment", "left")
    hit = F.expr("shiftright(__words[__k], __b) & 1L") == 1
    return joined.withColumn("__repeats", F.coalesce(hit, F.lit(False))).drop("__segment", "__k", "__b", "__words")


def _packed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct column, so that no name of theirs can meet one used here."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))


def without_ids(docs: DataFrame, gone: DataFrame, filter_bits: int = 1 << 24) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (distinct doc_id). Rows that a bit filter of the ids clears pass
    straight through; only the others, whose texts then travel, meet the ids in a join. Null ids stay. Other columns may have
    any name and type."""
    gone = store(gone.where("doc_id is not null"), "gone")
    segments = bit_segments(gone.select(F.pmod(F.xxhash64("doc_id"), F.lit(filter_bits)).alias("bit")).distinct())
    flagged = may_repeat(_packed(docs), segments, F.xxhash64("doc_id"), filter_bits)
    maybe = flagged.where("__repeats")
    return flagged.where("not __repeats").select("row.*").unionByName(maybe.join(gone, "doc_id", "left_anti").select("row.*"))


def exact_groups(docs: DataFrame, filter_bits: int = 1 << 27) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns ignored).

    Texts are equal when identical; null counts as empty. The largest doc_id of a group stays (null ids are smaller than
    any). Repeated rows with the same id form one group; all of them are ``kept`` if their id is the kept one.
    Rows outside the filter come straight from the scan. With more distinct texts than ``filter_bits`` more rows take
    part in the shuffle; the result never changes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h"))
    rows = store(rows, "hashes")
    flagged = may_repeat(rows, seen_twice(rows.select("h"), filter_bits), F.col("h"), filter_bits).drop("h")
    once = flagged.where("not __repeats").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                               F.lit(True).alias("kept"), "text_sha256")
    again = flagged.where("__repeats").drop("__repeats")
    groups = again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = again.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return once.unionByName(again)


def drop_exact_copies(docs: DataFrame, filter_bits: int = 1 << 27) -> DataFrame:
    """``docs`` without the copies that ``exact_groups`` drops, one row for each distinct text, columns unchanged.

    Rows that cannot repeat pass through with their text; the others are reduced to one row per text with partial
    aggregation, so a large group of copies shrinks before it is shuffled. Rows with one text and one doc_id are told apart by
    their values; of equal rows one stays. A null doc_id stays only where no other has the text. Other columns may have any
    name and type, maps included.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = _packed(docs)
    segments = store(seen_twice(rows.select(F.xxhash64(text).alias("h")), filter_bits), "filter")
    flagged = may_repeat(rows, segments, F.xxhash64(text), filter_bits)
    values = F.xxhash64(F.to_json("row"))
    best = flagged.where("__repeats").groupBy(F.sha2(text, 256).alias("key")).agg(
        F.max_by("row", F.struct(F.col("doc_id"), values.alias("values"))).alias("row"))
    return flagged.where("not __repeats").select("row.*").unionByName(best.select("row.*"))
