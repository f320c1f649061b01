"""A corpus pipeline of four training-data operators, each stage written and read again.

Documents without a language go; of each group of near copies one document stays; sources
are mixed to their target weights; and what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylog.llm import jaccard, language, mixing, packing
from quarrylog.llm.common import documents, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no learned language; columns stay.

    Null and empty texts go; short texts in doubt stay; repeated rows stay or go together; an
    empty table stays empty. Where no language could be learned only texts without a letter go.
    """
    return language.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of links; columns stay.

    Documents without words are linked with nothing and all stay; rows repeated with one doc_id
    and text count as one; an empty table stays empty.
    """
    return jaccard.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document none, one or two times; columns stay.

    A null source is a source of its own, after all others. Texts without words, null ones
    among them, have no mass and take no copies. Rows alike share their copies out in turn;
    ties are settled by hashes of the rows, so reruns agree; an empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 4096 tokens.

    A null text is empty: its end token alone. Each row is packed by itself, repeated ones too;
    an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The mix is random by hashes and pieces depend on a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
