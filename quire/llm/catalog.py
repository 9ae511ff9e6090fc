"""The registered queries opN_<name>: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    ann,
    conversations,
    decontaminate,
    license_scan,
    line_dedup,
    mixing,
    ngram_lm,
    packing,
    quality,
    sharding,
    simhash,
    spelling,
    toxicity,
)
from quire.llm.common import fold, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards by rendezvous hashing of doc_id."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and accepted templates of every document; score 1 with a template, 0.5 with a phrase only."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    accepted = F.transform("spans", lambda s: s["label"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, accepted)).alias("labels"),
        F.when(F.size("spans") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents; those with crc32(doc_id) mod 7 = 2 do not train."""
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2, order=3)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, weights 3, 1, 2 by source, at most 2 epochs."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), share=1.5, max_epochs=2.0, cycle=(3, 1, 2))
    return mixing.taken_words(plan).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain fitted on labelled documents, applied to every document."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), chain)
    p = F.col("toxicity")["p"]
    return scored.select(
        "doc_id", *[p[k].alias(f"p_{name}") for k, name in enumerate(chain.names)], F.col("toxic_p").alias("score"),
        F.col("rejected").alias("toxic"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "cosine", "lcs", "answer_lcs", "first_word")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, 3 or fewer differing bits."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on 5 or more sources cut from every document."""
    clean = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), "source", min_sites=5)
    return clean.select("doc_id", "n_lines", "removed_lines", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("clean_md5"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 4 = 2 never train."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return quality.score_quality(docs, weights).select("doc_id", held, "score", "predicted")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens of the public word tokenizer, packed into sequences of at most 4096."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.piece_digests(*packing.pack_documents(table(spark, sf_dir, "documents"), path, capacity=4096, end_id=1))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its seed, then repaired by the cheapest edits."""
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_trie": op3_ngram_trie,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_nearest": op10_nearest,
    "op11_packing": op11_packing,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}
