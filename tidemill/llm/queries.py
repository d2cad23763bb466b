"""The thin opN_ queries: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.suffix_dedup import removed_repeats

    return removed_repeats(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.token_counts import token_counts, word_bpe

    return token_counts(table(spark, sf_dir, "documents"), word_bpe(), limit=2048)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.quality_rules import quality

    return quality(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.bpe import multilingual, round_trip

    return round_trip(table(spark, sf_dir, "documents"), *multilingual())


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.kneser_ney import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op9_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.sstable import byte_bpe, written_and_read

    return written_and_read(table(spark, sf_dir, "documents"), byte_bpe(), end_id=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_token_counts, op3_quality_rules, op4_byte_bpe, op5_kneser_ney, op6_simhash, op7_bit_sliced_top_k, op8_source_mix, op9_sstable_shards, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    from tidemill.llm import mixing, quality_rules, topk

    return {"op3_quality_rules": quality_rules.ORACLE, "op7_bit_sliced_top_k": topk.ORACLE, "op8_source_mix": mixing.ORACLE}
