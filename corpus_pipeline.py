"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs`` for the rows that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import bpe, jaccard, lines, mixing, quality
from rookery.llm.common import prepared
from rookery.llm.queries import vocabulary_path
from rookery.session import scratch_path
from rookery.sources.tables import read

#: Near duplicates here: shingles of five words, Jaccard similarity of 80 % and more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepared(spark)
    return quality.accepted(docs, quality.trained(docs, read(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat the template of an earlier document, ``n_chars``
    counted anew. Documents that lose all their text go; those without any stay."""
    prepared(spark)
    return lines.cleaned(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least ``doc_id``.
    Rows with a null id or equal ids in one group: one of them, by the texts' order."""
    prepared(spark)
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights starts them; those that the mix
    does not reach go."""
    prepared(spark)
    return mixing.repeated(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text again."""
    prepared(spark)
    coded = bpe.encoded(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        "tokens",
        F.sha2("decoded", 256).alias("text_sha256"),
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = read(prepared(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{number}")
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
