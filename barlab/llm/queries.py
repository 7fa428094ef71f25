"""The operators applied to the given tables with their production parameters, and SQL where it can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.llm import sql
from barlab.llm.common import table
from barlab.llm.decontaminate import contaminated_pairs
from barlab.llm.exact_dedup import exact_groups
from barlab.llm.lm_scoring import score_documents
from barlab.llm.merkle import tampered_manifest
from barlab.llm.ngram_join import jaccard_components
from barlab.llm.packing import pack_sequences
from barlab.llm.quality import importance_resample
from barlab.llm.quality_rules import apply_rules
from barlab.llm.runs import run_digests, with_planted_runs
from barlab.llm.secrets import scan_secrets
from barlab.llm.suffix_dedup import remove_copies
from barlab.llm.token_counts import token_counts
from barlab.llm.toxicity import score_toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_importance_resampling")
def op2(spark, sf_dir):
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "__quality.*")


@query("op3_secret_scan")
def op3(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                        ["<|endoftext|>"])


@query("op5_toxic_segments")
def op5(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_latent_decontamination")
def op6(spark, sf_dir):
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return remove_copies(table(spark, sf_dir, "documents"))


@query("op8_cost_balanced_packing")
def op8(spark, sf_dir):
    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op9(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", sql.MERKLE)
def op11(spark, sf_dir):
    return tampered_manifest(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs", sql.RUNS)
def op12(spark, sf_dir):
    return run_digests(with_planted_runs(table(spark, sf_dir, "documents")))


@query("op13_adaptive_quality_rules", sql.QUALITY)
def op13(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "documents")).withColumn("outliers", F.array_join(F.array_sort("outliers"), ","))
