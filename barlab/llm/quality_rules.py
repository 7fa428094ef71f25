"""Quality rules with adaptive thresholds: quantile sketches per language and source in place of fixed cutoffs.

Everything is DataFrame expressions. A sketch is a log-linear histogram: values below ``1 << FINE`` have a bucket each, larger ones
share ``1 << FINE`` buckets per power of two, so a quantile is off by at most one part in 32. Sketches of parts add up to that of
the whole, which gives those of a language and of the corpus from those of (language, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.llm.common import store
from barlab.operators.attach import attach

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
FINE = 5
#: A document is an outlier beyond this many quartile distances from its group's quartiles.
FENCE = 3
#: Groups with fewer documents use the sketch of their language, then that of the corpus.
MIN_DOCS = 200
#: Features in thousandths: expression over the counts, and the least quartile distance a group is taken to have. Shares of
#: repetition are shrunk by a constant below, so that one line said twice is no outlier in a short text.
FEATURES = {
    "word_length": ("1000 * word_chars div n_words", 500),
    "symbols": ("1000 * n_symbols div word_chars", 10),
    "capitals": ("1000 * n_capitals div word_chars", 30),
    "dup_lines": ("1000 * n_dup_lines div (n_lines + 20)", 30),
    "repeats": ("1000 * n_repeat_words div (n_words + 100)", 60),
    "echoes": ("1000 * n_echo_words div (n_words + 20)", 30),
}


def text_counts(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words of ``text``,
    and n_echo_words, words equal to the one before.

    Repeated windows are found inside a row: window hashes are sorted with their places, equal neighbours mark a window, and the
    words that marked windows cover are counted by the gaps between their starts. Texts without a repeat skip the sort.
    """
    kept = docs.columns
    text, win, ranked, starts = F.col("text"), F.col("_win"), F.col("_ranked"), F.col("_starts")
    size = lambda c: F.size(c).cast("long")
    without = lambda chars: F.octet_length(text) - F.octet_length(F.regexp_replace(text, chars, ""))
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    rows = docs.withColumn("_words", F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_words", size("_words"))
    rows = rows.withColumn("_win", F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("_ranked", F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(
        F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    beside = lambda p, i: (F.get(ranked, i - 1)["h"] == p["h"]) | (F.get(ranked, i + 1)["h"] == p["h"])
    rows = rows.withColumn("_starts", F.sort_array(F.transform(F.filter(ranked, beside), lambda p: p["at"])))
    gaps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
    repeats = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    echoes = F.filter("_words", lambda w, i: w == F.get("_words", i - 1))
    return rows.select(
        *kept, "n_words", F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"), without("[A-Z]+").cast("long").alias("n_capitals"), size("_lines").alias("n_lines"),
        (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"), F.coalesce(repeats, F.lit(0).cast("long")).alias("n_repeat_words"), size(echoes).alias("n_echo_words"))


def bucket(v: Column) -> Column:
    """The sketch bucket of a whole number from 0 on."""
    shift = F.greatest(F.length(F.bin(v)) - (FINE + 1), F.lit(0))
    return shift.cast("long") * (1 << FINE) + F.call_function("shiftright", v, shift)


def bucket_least(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(b / (1 << FINE)) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * (1 << FINE), shift)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, bucket, n) of every feature of ``FEATURES``: one grouping with partial aggregation, mergeable by sums."""
    return rows.select(*keys, *[F.expr(e).alias(f) for f, (e, _) in FEATURES.items()]).unpivot(
        keys, list(FEATURES), "feature", "v").groupBy(*keys, "feature", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], fence: float) -> DataFrame:
    """One row per group: documents ``n`` and, per feature, ``<feature>_low`` and ``<feature>_high``.

    A window sees the buckets of one feature of one group, at most a few hundred rows however many documents there are.
    """
    each = Window.partitionBy(*keys, "feature")
    at = sketch.withColumn("upto", F.sum("n").over(each.orderBy("bucket"))).withColumn("all", F.sum("n").over(each))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    q = at.groupBy(*keys, "feature").agg(bucket_least(quartile(1)).alias("q1"), (bucket_least(quartile(3) + 1) - 1).alias("q3"), F.max("all").alias("n"))
    least = F.create_map(*[F.lit(x) for f, (_, w) in FEATURES.items() for x in (f, w)])
    width = F.greatest(F.col("q3") - F.col("q1"), least[F.col("feature")])
    q = q.select(*keys, "feature", "n", (F.col("q1") - fence * width).alias("low"), (F.col("q3") + fence * width).alias("high"))
    of = lambda f, side: F.max(F.when(F.col("feature") == f, F.col(side))).alias(f"{f}_{side}")
    return q.groupBy(*keys).agg(F.max("n").alias("n"), *[of(f, s) for f in FEATURES for s in ("low", "high")])


def thresholds(rows: DataFrame, fence: float = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences for every (lang_key, source_key) of ``rows``, from its own sketch or, where it is small, from a merged one."""
    own = store(sketches(rows, ["lang_key", "source_key"]), "sketch")
    language = merged(own, ["lang_key"])
    corpus = merged(language, [])
    sides = [f"{f}_{s}" for f in FEATURES for s in ("low", "high")]
    level = lambda df, keys, tag: fences(df, keys, fence).select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in ["n", *sides]])
    levels = level(own, ["lang_key", "source_key"], "own").join(level(language, ["lang_key"], "language"), "lang_key").crossJoin(
        F.broadcast(level(corpus, [], "corpus")))  # one row
    pick = lambda c: F.when(F.col("own_n") >= min_docs, F.col(f"own_{c}")).when(
        F.col("language_n") >= min_docs, F.col(f"language_{c}")).otherwise(F.col(f"corpus_{c}")).alias(c)
    return levels.select("lang_key", "source_key", *[pick(c) for c in sides])


def apply_rules(docs: DataFrame, fence: float = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, outliers for every row of ``docs``.

    Reads doc_id, text, lang and source; other columns, whatever their names, are ignored. Words are ``[^\\x20\\x09-\\x0D]+``. A document
    fails the base rules with fewer than 20 words or with more than 30 % of its words in repeated windows of eight. The others
    form the sketches; ``outliers`` names the features in which one lies outside the fences of its language and source (a value
    on a fence is inside), ``kept`` is true without any. Null and empty texts count zero words and fail. Null languages and
    sources are groups of their own. Equal rows get equal verdicts, null and repeated ids stay, an empty table gives none. A
    text of any length is one row; its windows take about 50 bytes a word. The fences reach the rows through a salted join, so
    that a source with a third of all rows spreads over tasks.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key("lang").alias("lang_key"), key("source").alias("source_key"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text_counts(rows).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = store(rows.withColumn("base_failed", failed), "counts")
    good = rows.where("not base_failed")
    judged = attach(good, thresholds(good, fence, min_docs), ["lang_key", "source_key"], F.struct("doc_id", "n_words", "word_chars"))
    out = [F.when(~F.expr(e).between(F.col(f"{f}_low"), F.col(f"{f}_high")), F.lit(f)) for f, (e, _) in FEATURES.items()]
    judged = judged.withColumn("outliers", F.array_compact(F.array(*out)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    none = F.array().cast("array<string>")
    return judged.select(*columns, (F.size("outliers") == 0).alias("kept"), "outliers").unionByName(
        rows.where("base_failed").select(*columns, F.lit(False).alias("kept"), none.alias("outliers")))
