"""A corpus pipeline from the operators of ``faultlore.llm``.

Each stage takes what its predecessor kept, as written to the shared folder, and
returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultlore.llm.common import Scratch, documents, placed, sent, unused, written
from faultlore.llm.exact import exact_duplicates
from faultlore.llm.languages import in_known_language
from faultlore.llm.mixing import mixed_documents
from faultlore.llm.near import near_duplicates
from faultlore.llm.packing import packed_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages, one or several; texts without letters and null texts go."""
    return in_known_language(docs)


def _kept(docs: DataFrame, verdicts: Callable[[DataFrame, str, Scratch], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (rows, name of their keys, store) keeps.

    Only the keys of dropped rows meet the texts, which stay where they are.
    """
    row, store = unused(docs, "row"), Scratch(docs.sparkSession, "stage")
    rows = placed(docs, *docs.columns, name=row)
    dropped = written(verdicts(rows, row, store).filter("NOT kept").select(row), "dropped")
    store.remove()
    return rows.join(sent(dropped), row, "left_anti").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id."""
    return _kept(docs, lambda rows, row, store: exact_duplicates(rows, row=row, store=store))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five words a shingle, similarity 0.8."""
    return _kept(docs, lambda rows, row, store: near_duplicates(rows, percent=80, shingle=5, row=row))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: documents as often as they are taken, the last time perhaps in part."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packed_documents(docs)


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage),
          ("packing", packing_stage)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
