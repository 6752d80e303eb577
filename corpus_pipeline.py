"""A corpus pipeline from four operators: languages told, near duplicates out, sources mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import language_id, mixing, near_dedup, packing
from strandloom.llm.common import new_path, table
from strandloom.session import ship


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells, with it in `lang`.

    Texts that are null, empty or without a letter go, and all of them where no labelled row is there to learn from; rows
    that repeat and ties are judged each alike; an empty table stays empty; other columns are kept.
    """
    ship(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least doc_id.

    Null texts count as empty ones, which are copies of one another, as are texts without words only where they are equal;
    of rows that repeat one stays; a class of null ids keeps one row; an empty table stays empty; other columns are kept.
    """
    ship(spark)
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: a row for each document and epoch, with the words taken as its text.

    Documents without words, whose text is null or empty, go; a null source is a source; rows that repeat take part each;
    an empty table stays empty; other columns are kept.
    """
    ship(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, placed in sequences of at most 2048 tokens.

    A null or empty text is the end id alone; rows that repeat are packed each; an empty table gives no pieces; of the
    other columns of documents only doc_id is kept.
    """
    ship(spark)
    return packing.packed_ids(docs)


STAGES = [
    ("identify_languages", identify_languages),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Tokenisation, the sketches and the drawn mix are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
