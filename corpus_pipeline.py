"""Corpus pipeline over ``documents``: toxicity, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before
kept; its rows are written as Parquet and reread. All but the last return the columns
of ``documents``, further ones and ones whose names clash with the stages' own included.
Empty tables give empty results; nulls in columns that a stage does not read pass through. Part of the training-data operators in ``emberline/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import common, kd_shards, kernel_toxicity, mixing, simhash_anchors, winnowing


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, fitted on the learnable labels, does not reject.

    Null and empty texts hold no insult and stay; labels without id or label are not learnt from.
    """
    return kernel_toxicity.drop_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component.

    Texts without words, null ones too, share the fingerprint zero and count as copies of each other; of repeated rows one stays.
    """
    return simhash_anchors.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words are in benchmark windows.

    Texts without words stay; null items are ignored.
    """
    return winnowing.drop_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights emits them.

    Texts without words have size 0; a null source is a source of its own, the last one; a source without any word emits nothing.
    """
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every emitted document.

    Copies share id and text and are told apart by row; a null id sorts first, a null text counts 8 bytes.
    """
    return kd_shards.contract(kd_shards.kd_shards(docs))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("sharding", sharding)]

#: Model scores and XXH64 fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and reread as the next one's input."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
