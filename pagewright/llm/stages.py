"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as S

from pagewright.llm import credentials, line_dedup, ngram_join, outliers, packing
from pagewright.session import stored
from pagewright.sources.snapshot import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns that came in, ``n_chars`` counted anew."""
    return df.withColumn("n_chars", S.char_length("text").cast("long"))


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return _documents(outliers.drop_outliers(docs))


def lines(spark, docs, sf_dir):
    """Lines that many documents share go; every document stays."""
    return _documents(line_dedup.drop_frequent_lines(docs))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return _documents(ngram_join.drop_near_duplicates(docs))


def secrets(spark, docs, sf_dir):
    """Found secrets are replaced by a mark; every document stays."""
    return _documents(credentials.redact_secrets(docs))


def pack(spark, docs, sf_dir):
    """Where each piece of each document goes: (doc_id, piece, start, length, bin_id, capacity, offset)."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("secret scans", secrets), ("best-fit packing", pack)]
#: Robust estimates and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again; what a stage wrote on its way
    is emptied with it."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(spark, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
