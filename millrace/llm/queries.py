"""Queries of the operators in this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch
from .chat_format import format_conversations, read_back
from .decontaminate import contaminated
from .embedding_dedup import embedding_near_duplicates
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .periodic_runs import most_periodic, periodic_runs
from .quality import classify
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .vector_codes import compress_vectors
from .warc import assemble, page_digests, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder MILLRACE_TOKENIZERS names, else where the package of such files puts it."""
    if folder := os.environ.get("MILLRACE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_key")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85).drop("text_key", "group_key")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), store.path("archives"))
    # the archives are parsed once; the digests need no bodies but those of metadata
    records = read_warc(spark, store.path("archives"))
    records = store.keep(records.withColumn("payload", F.when(F.col("record_type") == "metadata", F.col("payload"))), "records")
    store.drop("archives")
    return page_digests(assemble(records))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.union(more)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.withColumn("rate", F.round("rate", 9))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which about a tenth, told by a checksum of the id, repeat their words from some place on: what operator 11 is asked about."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    hit = hit.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    hit = hit.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    hit = hit.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    return hit.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeat_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", most_periodic())
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token_ids").path("files")
    write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_decontaminate, op4_quality_classifier, op5_ngram_jaccard_join, op6_warc, op7_chat_format, op8_embedding_dedup, op9_token_counts, op10_mix_sources, op11_periodic_runs, op12_vector_codes, op13_token_files)}
