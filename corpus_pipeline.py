"""Documents from raw to tokens: filter, deduplicate, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each result down and goes on from the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm import language, mixing, ngram_join, quality, sentencepiece_dropout
from rillspark.llm.tables import packed, table
from rillspark.session import durable, tune

# The ranking's own cut, a quantile of the scores: as large a share passes as the labels call good.
LEAST_QUALITY = quality.PASSES
# Below it a text is between two languages.
LEAST_LANGUAGE = language.AMBIGUOUS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking places above its quantile cut."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out())
    scored = quality.scored(packed(docs, "text"), quality.fit(docs, labels))
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("_doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: not those without letters, between two, or like none that was learned.

    Where no row has both a language and letters nothing was learned; then all documents stay.
    """
    learned = docs.filter(~language.held_out())
    model = language.fit(learned)
    if not model.languages:
        return docs
    limit = language.distance_limit(learned, model)
    known = language.identified(packed(docs, "text"), model)
    wanted = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)
    wanted &= F.col("distance") <= F.lit(limit)
    return known.filter(wanted).select("_doc.*")


def deduplication_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces."""
    return sentencepiece_dropout.encoded(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", deduplication_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

# Fitted models and merges are not for SQL; tests compare the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
