"""A training-corpus pipeline: each stage calls one operator of ``tessera.llm``.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame;
it is written as Parquet and read again as the next one's ``docs``. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.exact_dedup import drop_exact_duplicates
from tessera.llm.jaccard_join import keep_one_of_each
from tessera.llm.mixing import mix_documents
from tessera.llm.piece_codec import encode_pieces
from tessera.llm.queries import vocabulary
from tessera.llm.toxicity import drop_toxic, fit_severity
from tessera.plans.scratch import spill


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model rejects."""
    return drop_toxic(docs, fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest identifier."""
    return drop_exact_duplicates(docs, keep="largest")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents."""
    return keep_one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight takes them."""
    return mix_documents(docs)


def piece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their texts."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"), keep_columns=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("mix_sources", mix_sources), ("piece_codec", piece_codec)]

#: No SQL: the first stage's model, the third's components and the last's pieces are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
