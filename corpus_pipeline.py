"""A corpus made ready for training: filtered, de-duplicated, decontaminated and packed.

Each stage reads what the one before wrote, so a lost executor costs no more than a stage's own work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tonelens.llm import decontaminate, packing, quality, setsketch, toxicity
from tonelens.llm.common import read
from tonelens.llm.queries import fold
from tonelens.plans.workdir import materialise


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality.keep_good(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; a quarter of the labels is held out of the fit, as in the query."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic").filter(fold("doc_id", 4) != 2))
    return toxicity.keep_harmless(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return setsketch.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark passages to be contaminated."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good),
    ("toxicity", harmless),
    ("near-duplicates", distinct),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

#: Three stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
