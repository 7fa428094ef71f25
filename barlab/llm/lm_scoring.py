"""Language-model scores of whole documents: an add-one unigram base and a gated recurrent model trained on the corpus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import crc_share, slices, store, text_bytes, word_hashes, word_strings
from barlab.llm.gru import Gru
from barlab.llm.postings import BLOCK_BYTES, postings, weighted_sums, word_counts

END = b""
#: Tokens of texts that the recurrent model holds at a time while it is trained.
LEARN = 1 << 20


def words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of all texts and one end token for each, with the row of every token."""
    found, before = word_strings(*text_bytes(batch.column("text")), lower=True)
    rows = np.arange(batch.num_rows)
    return pa.concat_arrays([found, pa.array([END] * len(rows), pa.binary())]), np.concatenate([np.repeat(rows, np.diff(before)), rows])


def vocabulary_hashes(vocab: list[bytes]) -> np.ndarray:
    """The hash of each vocabulary word as ``word_hashes`` gives it."""
    raw = np.frombuffer(b" ".join(vocab) or b" ", np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def ids_of(batch: pa.RecordBatch, keys: np.ndarray, codes: np.ndarray, end_id: int, unknown_id: int):
    """Token ids of a batch's texts, each with its end, and the exclusive ends of the documents."""
    raw, at = text_bytes(batch.column("text"))
    hashes, before, _ = word_hashes(raw, at)
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1) if len(keys) else np.zeros(len(hashes), np.int64)
    code = np.where(keys[place] == hashes, codes[place], unknown_id) if len(keys) else np.full(len(hashes), unknown_id)
    ends = before[1:] + np.arange(1, batch.num_rows + 1)
    ids = np.full(int(ends[-1]), end_id, np.int64)
    keep = np.ones(len(ids), bool)
    keep[ends - 1] = False
    ids[keep] = code
    return ids, ends


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, classes: int = 32, width: int = 32, hidden: int = 24,
                    train_share: int = 1, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    A null or empty text is its end token alone. Rows are scored one by one, so repeated rows and null ids stay. Word counts
    come from all documents outside the held-out share. The recurrent model knows the ``classes * width - 2`` most
    frequent words (a bounded model size); any other word costs the model's unknown token times the word's share of
    the base probability outside the vocabulary, so the score is a proper probability of the text. It is trained on every
    training document, whole texts, in every input split, and the splits' models are averaged after each of ``rounds``
    passes. A ``train_share`` above 1 leaves all but one document in that many out.
    With no training tokens every count is 0 and the base is uniform.
    """
    size = classes * width
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (crc_share("doc_id", modulus) == held).alias("held_out"))
    carry = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long"}

    def head(batch, lens):
        return {"doc_id": batch.column("doc_id").to_pylist(), "held_out": batch.column("held_out").to_pylist(), "n_tokens": lens.tolist()}

    def tally(batch):
        return ~batch.column("held_out").to_numpy(zero_copy_only=False)

    posted = store(postings(rows, words, carry, head, tally), "posted")
    counts = store(word_counts(posted, size - 1), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, norm = int(total.n), int(total.n) + int(total.v) + 1
    top = counts.select(F.explode("best").alias("b")).select("b.*").orderBy(F.desc("c"), "word").limit(size - 1).collect()
    end_count = next((r.c for r in top if bytes(r.word) == END), 0)
    top = [r for r in top if bytes(r.word) != END][:size - 2]
    vocab = [bytes(r.word) for r in top]
    mass = np.array([(r.c + 1) / norm for r in top])
    end_mass = (end_count + 1) / norm
    rest = max(1 - mass.sum() - end_mass, 0.5 / norm)  # of all words outside the vocabulary, unseen ones included

    unigram = np.full(size, 1e-12)
    end_id, unknown_id = 0, 1
    unigram[end_id], unigram[unknown_id], unigram[2:2 + len(mass)] = end_mass, rest, mass
    hashes = vocabulary_hashes(vocab)
    order = np.argsort(hashes)
    keys, codes = hashes[order], order + 2
    start = np.log(unigram)
    params = Gru(classes, width, hidden, start).flat()

    learners = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(train_share)) == 0)).select("text")

    for _ in range(rounds):
        now = params

        def learn(batches):
            model, texts, held, tokens = Gru(classes, width, hidden, start).load(now), [], 0, 0
            for batch in slices(batches):
                ids, ends = ids_of(batch, keys, codes, end_id, unknown_id)
                if texts and held + len(ids) > LEARN:
                    model.train(texts)
                    texts, held = [], 0
                texts += np.split(ids, ends[:-1])
                held, tokens = held + len(ids), tokens + len(ids)
            if texts:
                model.train(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(tokens)]), pa.array([model.flat()], pa.list_(pa.float32()))], names=["weight", "model"])

        mean = learners.mapInArrow(learn, "weight double, model array<float>").select("weight", F.posexplode("model").alias("i", "x")).groupBy("i").agg(
            (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x")).collect()  # one row per parameter: a fixed number
        if mean:
            params = np.zeros(len(params), np.float32)
            params[[r.i for r in mean]] = [r.x for r in mean]
    model_bytes = rows.sparkSession.sparkContext.broadcast((params, keys, codes))

    def score(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        params, keys, codes = model_bytes.value
        model = Gru(classes, width, hidden, start).load(params)
        pending, held = [], 0

        def flush():
            got = [(b, d, *ids_of(d, keys, codes, end_id, unknown_id)) for b, d in pending]
            base = np.cumsum([0, *(len(i) for _, _, i, _ in got)])
            lp = model.score(np.concatenate([i for _, _, i, _ in got]), np.concatenate([e + base[j] for j, (_, _, _, e) in enumerate(got)]))
            at = 0
            for b, d, _, _ in got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b]), pa.array([d.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([lp[at:at + d.num_rows] / math.log(10)], pa.list_(pa.float64()))],
                    names=["block", "ids", "gru"])
                at += d.num_rows

        for batch in slices(batches, max_bytes=BLOCK_BYTES):  # the same blocks as in the postings
            pending.append(((part << 32) | k, batch))
            k, held = k + 1, held + batch.nbytes
            if held > 12 << 20:
                yield from flush()
                pending, held = [], 0
        if pending:
            yield from flush()

    gru = rows.mapInArrow(score, "block long, ids array<long>, gru array<double>")
    heads = posted.where("payload is null").join(gru, "block", "left").withColumn(
        "gru", F.when(F.col("doc_id") == F.col("ids"), F.col("gru")).otherwise(F.raise_error(F.lit("the input's splits changed between two scans"))))
    lists = [F.lit(None).cast(f"array<{v}>").alias(c) for c, v in carry.items()]
    loads = counts.select("block", "bucket", "payload", *lists, F.lit(None).cast("array<double>").alias("gru"))
    whole = posted.where("payload is not null").withColumn("gru", F.lit(None).cast("array<double>")).unionByName(heads.drop("ids")).unionByName(loads)
    inside = {END, *vocab}

    class Values:
        """The base logarithm of a word, whether it is known, and its logarithm within the mass outside the vocabulary."""

        def __init__(self):
            self.known: dict[bytes, int] = {}

        def load(self, entries):
            self.known.update(zip(entries.column("word").to_pylist(), entries.column("c").to_pylist()))

        def __call__(self, words):
            keys = words.to_pylist()
            c = np.fromiter((self.known[k] for k in keys), np.float64, len(keys))
            base = np.log10((c + 1) / norm)
            return base, c > 0, np.where([k in inside for k in keys], 0.0, base - math.log10(rest))

    sums = weighted_sums(whole, ["base", "known", "outside"], carry | {"gru": "double"}, Values)
    return sums.select("doc_id", "held_out", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       F.col("base").alias("base_score"), (F.col("gru") + F.col("outside")).alias("score"))
