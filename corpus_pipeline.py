"""A training corpus from documents, in five stages, each written before the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bpe import multilingual, round_trip
from tidemill.llm.common import table, work_dir, written
from tidemill.llm.mixing import mixed
from tidemill.llm.near_copies import one_of_similar
from tidemill.llm.suffix_dedup import repeats, without_repeats
from tidemill.llm.toxicity import model_for, scored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go."""
    model = model_for(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=tuple(docs.columns)).where(F.col("score") < 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach from one another (a Jaccard similarity of 0.8 or more of five-word shingles), the one with the smallest doc_id stays."""
    return one_of_similar(docs)


#: Bytes of a repeated passage: what 51 words or more have nearly always (40 words of the tables; operator 6 has seen to whole copies).
PASSAGE = 256


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that occur twice go from every text (in whole characters); a document of which nothing is left goes.

    n_chars follows the text. A null text becomes empty.
    """
    keep = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = repeats(docs, without_repeats, "text string, gone long", length=PASSAGE, keep=keep)
    left = cut.where((F.col("found.gone") == 0) | F.col("found.text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("found.text"), "n_chars": F.length("found.text")}
    return left.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a row is there as often as the mix takes it."""
    taken = mixed(docs, keep=tuple(docs.columns)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return round_trip(docs, *multilingual())


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mix", mix),
    ("byte_bpe", encoding),
]

#: Models, connected components and merges have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), work_dir(spark, f"pipeline-{name}"))
    return docs
