"""A training corpus from raw documents: language, quality, near-duplicates, packing.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` writes every stage's result as Parquet in the shared
folder and reads it back as the next stage's input, so a lost executor never costs
more than the stage at hand. All stages but the last return rows of ``documents``,
unchanged; the last returns the pieces of the packed sequences.

No DuckDB SQL gives these rows (the models are fitted, the tokens come from a
tokenizer), so ``ORACLE_SQL`` is None and the tests hold each stage against a
brute-force version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.common import stored, table
from riskspark.llm.langid import keep_identified
from riskspark.llm.ngram_join import one_per_group
from riskspark.llm.packing import pack_documents
from riskspark.llm.quality import keep_good
from riskspark.llm.queries import TOKENIZER

MIN_LANGUAGE_SCORE = 0.5   # a best language less likely than this is no decision
NEAR_WORDS, NEAR_PERCENT = 5, 80   # near copies: Jaccard of word 5-shingles (op1's query has its own 4 and 85)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter, and
    texts whose best language is less likely than not."""
    return keep_identified(docs, MIN_LANGUAGE_SCORE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier predicts to be bad."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (5-word Jaccard >= 0.8), the one with the
    smallest id stays."""
    return one_per_group(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left into token sequences."""
    return pack_documents(docs, TOKENIZER)


STAGES = [("language", language_stage), ("quality", quality_stage), ("near duplicates", join_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
