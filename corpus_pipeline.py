"""The corpus pipeline: stages applied one after another to ``documents``, each written as Parquet and read again.

All stages but the last return the columns of ``documents``. Nulls, empty and repeated
rows have the results that each operator's docstring states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperslice.llm import decontamination, pii, quality_rules, simhash_dedup
from hyperslice.llm.byte_bpe import round_trip
from hyperslice.llm.common import marked, read, release, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labelling reject go. The labelling is trained on ``docs`` and the labels table."""
    return quality_rules.keep(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    return simhash_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by pseudonyms, and n_chars is that of the new text."""
    done = pii.pseudonymise(docs, out="__private", key=pii.synthetic_key(spark)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return done.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last: the number and digest of every text's token ids, and the digest of the bytes they decode to."""
    return round_trip(docs, ["doc_id"])


STAGES: list[tuple[str, Stage]] = [("quality_rules", rules), ("near_dedup", dedup), ("decontamination", decontaminate), ("pii", private), ("byte_bpe", tokens)]

#: A trained labelling and ranked pair merging are beyond SQL: the pipeline is tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables between them only the last stays, which the lazy result reads."""
    docs, since = read(spark, sf_dir, "documents"), marked()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
