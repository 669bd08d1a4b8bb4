"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a frame; its rows are written and read again as the next stage's
``docs``. All stages but the last return rows of ``documents`` with all their columns, as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epochsql.llm.common import Scratch, table
from epochsql.llm.decontaminate import drop_leaking
from epochsql.llm.minhash import keep_one_of_each
from epochsql.llm.mixing import mix_documents
from epochsql.llm.quality import keep_good, train
from epochsql.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal classifier, fitted on the rated documents among them, rejects.

    Null and empty texts stay, as they give no evidence; ids are only used to find ratings, so null ones are scored alike;
    repeated rows stay or go together; without ratings all rows stay; an empty table stays empty.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without words and rows without an id stay; rows that share one id stay or go together; an empty table stays
    empty.
    """
    return keep_one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark.

    Null and empty texts stay; ids are not looked at; without items all rows stay; an empty table stays empty.
    """
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each copy.

    Null texts and texts without words have no share in the mix and go; null sources are one source; rows that share an id,
    or have none, are taken alike; an empty table stays empty.
    """
    return mix_documents(spark, docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in shards that all hold the mixture.

    Null texts count as empty, null sources as one source; repeated rows have places of their own; an empty table gives no rows.
    """
    return assign_shards(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can express neither the fitted classifier nor the shards' checksums; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = scratch.write(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
