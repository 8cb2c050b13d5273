"""Corpus preparation: stages applied to ``documents``, each stored as Parquet and read again.

1. Documents whose language is not found (no letters, or no language holds half of their words) go.
2. One document of each group of near duplicates stays: the first row of the smallest id.
3. Documents with windows of two benchmark items or more go; runs of hit words are cut out of the others.
4. Personal data is replaced by its kind in brackets.
5. What is left is packed into sequences.

Stages keep the columns of ``documents`` (others are dropped); ``n_chars`` follows the text where a stage changes it.

Defined results: a null, empty or letterless text has no language and goes in stage 1, whatever its other columns hold; a
null id, lang, source or n_chars doesn't matter (of rows with a null id one of each group of near duplicates stays if no row
of it has an id); of rows with equal ids in a group the one with the smallest row hash stays, repeated rows count once;
ties of languages go to the one that sorts first; a text of hit words only becomes empty and is packed as its end token;
an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import decontam, langid, minmax, packing, pii
from folia.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SHARE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _recounted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    seen = langid.identify(docs, langid.learned(docs))
    return _documents(seen.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(minmax.without_near_duplicates(_documents(docs)))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(decontam.decontaminate(_documents(docs), table(spark, sf_dir, "benchmark")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.redact(_documents(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(docs), packing.vocabulary())


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("PII", private), ("packing", packed)]

#: models and a tokenizer are applied, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
