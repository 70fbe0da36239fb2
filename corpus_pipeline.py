"""A corpus pipeline of five stages: quality, exact copies, near copies, mixing, piece encoding.

Each stage works on all that the one before kept; all but the last return the columns of documents, whatever others
there are beside them. Null and empty texts are clean, equal to each other (the larger id stays), take part in no mixture
(they have no words) and so are not encoded. Of equal texts the row with the largest id stays, a null id before none; rows
that repeat the staying id all stay. Of near copies the least id stays. Rows that share an id are documents of their own in
the mixture. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gamelode.llm import common, exact_dedup, mixing, piece_dropout, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_clean(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_dropout.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("piece encoding", encode_pieces),
]

#: The classifier, the fingerprints and the pieces have no form in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
