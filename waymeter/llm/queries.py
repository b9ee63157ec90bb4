"""One query for each operator of this subpackage, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.llm import archives, bpe, counts, exact, mixing, near, negatives, quality, repeats, secrets, shards, sql, toxicity, whitening

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return toxicity.grade(documents, toxicity.train(documents, _table(spark, folder, "labels")))


def op2_blob_ledger_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.by_row(_table(spark, folder, "documents"))


def op3_tree_merge_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, folder, "documents"), largest=True)


def op4_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shards(_table(spark, folder, "documents"))


def op5_segment_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), also=())


#: The tree's levels. The tables have no domain; sources stand for four of them by their number.
DOMAINS = ["web", "books", "forums", "news"]
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4}, "source": {"src0": 2}}
SHARE, EPOCHS, SEED = (1, 1), 4, 17


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS)).cast("int") + 1)


def op6_hierarchical_mixing(spark: SparkSession, folder: str) -> DataFrame:
    levels = {"domain": domain_of(F.coalesce("source", F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(_table(spark, folder, "documents"), levels, WEIGHTS, SHARE, EPOCHS, SEED)


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(_table(spark, folder, "documents"), words=2, percent=80)


def op8_doubling_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.cut_repeats(_table(spark, folder, "documents"), length=50)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")


def op9_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archives.convert_pages(_table(spark, folder, "pages"))


def op10_risk_controlled_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"), stratum=F.col("lang"))


def op11_threshold_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op12_chebyshev_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vector = F.when(negatives.usable(F.col("embedding")), whitening.fixed_point("embedding", 64, 1_000_000))
    return whitening.whiten(_table(spark, folder, "embeddings"), vector)


def op13_cached_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def entries() -> dict[str, Entry]:
    return {
        "op1_ordinal_toxicity": (op1_ordinal_toxicity, None),
        "op2_blob_ledger_secrets": (op2_blob_ledger_secrets, sql.op2()),
        "op3_tree_merge_exact_dedup": (op3_tree_merge_exact_dedup, sql.op3()),
        "op4_sampled_splitters": (op4_sampled_splitters, None),
        "op5_segment_tree_bpe": (op5_segment_tree_bpe, None),
        "op6_hierarchical_mixing": (op6_hierarchical_mixing, sql.op6(DOMAINS, WEIGHTS, SHARE, EPOCHS, SEED)),
        "op7_minhash_near_dedup": (op7_minhash_near_dedup, sql.op7()),
        "op8_doubling_substring_dedup": (op8_doubling_substring_dedup, sql.op8()),
        "op9_arc_to_warc": (op9_arc_to_warc, sql.op9()),
        "op10_risk_controlled_rules": (op10_risk_controlled_rules, sql.op10()),
        "op11_threshold_hard_negatives": (op11_threshold_hard_negatives, sql.op11()),
        "op12_chebyshev_whitening": (op12_chebyshev_whitening, None),
        "op13_cached_token_counts": (op13_cached_token_counts, None),
    }
