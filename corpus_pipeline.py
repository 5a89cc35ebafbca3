"""The corpus pipeline: five stages over documents, each of which works on all that the one before kept.

What holds for every stage: null and empty texts, null ids and sources, ties, repeated rows and very long texts are rows
like any other, unless its own text says more; an empty table gives an empty one; columns besides those of documents stay
as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, secrets, simhash
from tessera.llm.common import scratch, stash, unstash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language: null texts, texts without letters, and those with
    hardly any known n-gram are rejected. Learned from the labelled documents that op6 learns from too; without labels
    every document is rejected."""
    labelled = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.learn(labelled), docs.columns)
    lang, _, coverage = found.columns[-3:]
    kept = found.where((F.col(lang) != langid.UNKNOWN) & (F.col(coverage) >= langid.LEAST_COVERAGE))
    return kept.withColumn("lang", F.col(lang)).select(*(f"`{c}`" for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: five-word shingles, a similarity of 0.8
    or more. Texts without words are copies of each other; rows without an id all stay."""
    return simhash.deduplicate(docs)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars that of the text now. A null text stays null."""
    return _sized(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass, in the mix's order. Texts without words aren't taken; a null
    source is one of its own."""
    return _sized(mixing.mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed), and whether the ids decode to the text; a null text counts as empty.
    Other columns don't go on."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = docs.select("doc_id", "lang", "source", F.col("text").alias("_text"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_sha"))
    # Written, else each task has two Python workers at a time, and executors keep them.
    made = stash(bpe.encode(own, "_text", path, pattern, ["doc_id", "lang", "source", "_sha"], with_offsets=False), "encoded")
    back = bpe.decode(made, "ids", path, pattern, ["doc_id", "lang", "source", "_sha", "n_tokens", "ids"])
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("exact"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("secret scans", secret_scan), ("mixing sources", mix_sources), ("byte-level BPE", tokens)]

#: SQL can't express the stages. Tests hold every stage, and run() itself, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder. Each stage's result is written; what it wrote on the way and
    the result before it are then deleted, but for the last one's."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch() as kept:
            docs = kept(stash(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        if last is not None:
            unstash(last)
        last = docs
