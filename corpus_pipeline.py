"""A pipeline of five of the training-data operators over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. Every stage works on all that its predecessor kept; all but the last return the columns of
documents, the last adds ``piece_ids`` and ``decoded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavegrid.llm import common as C
from wavegrid.llm import decontamination, line_dedup, near_dedup, sentencepiece_viterbi
from wavegrid.llm import toxicity as tox
from wavegrid.session import ship

#: Percent of shared shingles from which documents are near duplicates; 32 bands of 6 miss a pair at 0.8 with probability
#: (1 - 0.8^6)^32, 6e-5. The query op6 keeps its own share of 85.
NEAR_SHARE = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = tox.fit(docs, C.table(ship(spark), sf_dir, "labels"))
    return tox.clean_documents(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document has go from the texts; every document stays."""
    ship(spark)
    return line_dedup.drop_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (``NEAR_SHARE``) stays."""
    ship(spark)
    return near_dedup.one_of_each(docs, NEAR_SHARE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean_documents(docs, C.table(ship(spark), sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text's pieces and the text that they decode to."""
    ship(spark)
    return sentencepiece_viterbi.add_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("sentencepiece", pieces),
]
#: SQL can express neither the classifier nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.work_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
