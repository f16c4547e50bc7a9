"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm import (
    fill_in_middle,
    fingerprints,
    language,
    mixing,
    neighbours,
    ngram_join,
    oracles,
    prefix_trie,
    quality,
    sentencepiece_dropout,
    sharding,
    token_counts,
    url_filters,
    warc,
)
from rillspark.llm.tables import table
from rillspark.session import tune, working_folder

SHARDS = 8
TOKEN_LIMIT = 1024


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, over 4,096 virtual slots.

    ``slot`` is the place within the shard, gapless from 0; ``virtual_slot`` the hashed one.
    """
    tune(spark)
    made = sharding.shard_documents(
        table(spark, sf_dir, "documents"), SHARDS, f"{working_folder(spark)}/slot_map"
    )
    return made.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.held_out()))
    made = language.identified(docs.select("doc_id", "text"), model)
    return made.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives by byte ranges."""
    tune(spark)
    written = warc.write_archives(table(spark, sf_dir, "pages"), f"{working_folder(spark)}/warc")
    found = warc.read_archives(written.select("path", "length"), with_payload=False)
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates and number of links at Jaccard 0.8 on 5 words."""
    tune(spark)
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the byte-level vocabulary."""
    tune(spark)
    made = token_counts.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from two thirds of the labels."""
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out())
    made = quality.scored(docs, quality.fit(docs, labels))
    return made.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.PASSES).cast("int").alias("predicted"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, ... by source, no document more than 3 times."""
    tune(spark)
    dealt = mixing.dealt_copies(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "source",
        "copies",
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot fingerprints of all documents and of their edited texts."""
    tune(spark)
    made = fingerprints.fingerprinted(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.array_join("spots", " ").alias("fingerprint"),
        F.array_join("edited_spots", " ").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, over shifted Hilbert curves."""
    tune(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under one seed, and whether they decode to the text."""
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_dropout.encoded(docs).drop("text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations: a row per node."""
    tune(spark)
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two unit ranks and put together anew, and taken apart again."""
    tune(spark)
    made = fill_in_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each page's url, and what it says; urls without a rule are allowed."""
    tune(spark)
    rules = url_filters.write_rules(url_filters.rules_table(spark), f"{working_folder(spark)}/rules")
    made = url_filters.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return made.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_neighbours": op9_neighbours,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filters": op13_url_filters,
}

# The others are beyond SQL (fitted models, tokenizers, a reduction tree, an approximate index);
# tests hold them against brute force.
ORACLE_SQL = {
    "op3_warc": oracles.OP3_WARC,
    "op4_ngram_join": oracles.OP4_NGRAM_JOIN,
    "op8_fingerprints": oracles.OP8_FINGERPRINTS,
    "op11_prefix_trie": oracles.OP11_PREFIX_TRIE,
    "op12_fill_in_middle": oracles.OP12_FILL_IN_MIDDLE,
    "op13_url_filters": oracles.OP13_URL_FILTERS,
}
