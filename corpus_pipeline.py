"""Documents to training shards: stages applied one after the other, each to all that its predecessor kept.

All columns of the documents are carried along, whatever their names; the last stage adds ``shard`` and ``slot``, which replace
columns of these names. Null and empty texts are not toxic and not contaminated; of all texts without words one stays. Null ids
come last where the smallest id decides. Rows equal in all columns are near copies of each other, so one stays. Long texts are
read whole. Labels too few to learn from reject nothing; benchmark items without text contaminate nothing. An empty documents
table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import decontaminate, mixing, near_copies, sharding, toxicity
from holdfast.llm.common import prepare, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger, trained on the labels, scores one half or more go."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash candidates whose five-word similarity is 0.8 or more."""
    return near_copies.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources move half the way, on a log scale, to equal shares; copies are rows of their own."""
    return mixing.mix(docs, alpha=0.5, numbered=False)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order, in 16 shards."""
    return sharding.shard(docs, n_shards=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: a fitted chain, 64-bit fingerprints and a random order have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(prepare(spark), docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
