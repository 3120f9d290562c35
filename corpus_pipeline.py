"""A corpus pipeline: five operators of millrace.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._store import Scratch
from millrace.llm.decontaminate import decontaminate
from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_join import ngram_jaccard_join
from millrace.llm.quality import keep_good
from millrace.llm.sharding import shard_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Rows of one (doc_id, text) stay or go together; null ids have no given labels; null and empty texts give
    no evidence, so the scorers' bias decides. An empty table stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, null ids last, then of the least text hash.

    Of repeated rows of that id and text one stays, the least by its other columns, so a
    group leaves one row whatever ids its rows have. Documents without words link with nothing: they all
    stay, but for repeated rows of one id and text. An empty table stays empty.
    """
    store = Scratch(spark, "pipeline_join")
    groups = store.keep(ngram_jaccard_join(docs, n=5, percent=80), "groups")
    each = groups.groupBy("group_key", "doc_id", "text_key").agg(F.count("*").alias("__mr_n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "__mr_n")).alias("r")
    one = store.keep(each.groupBy("group_key").agg(first).select(F.col("r.doc_id").alias("__mr_id"), F.col("r.text_key").alias("__mr_key"), "r.__mr_n"), "one")
    keyed = docs.select(COLUMNS).withColumn("__mr_text", F.xxhash64("text"))
    kept = keyed.join(one, keyed["doc_id"].eqNullSafe(one["__mr_id"]) & (keyed["__mr_text"] == one["__mr_key"]))
    if one.where("__mr_n > 1").isEmpty():
        return kept.select(COLUMNS)
    repeated = kept.where("__mr_n > 1").groupBy("__mr_id", "__mr_key").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return kept.where("__mr_n = 1").select(COLUMNS).union(repeated.select(COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of benchmark items.

    Rows of one text stay or go together, whatever their ids; null and empty texts stay. Without documents
    or items nothing changes.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated a Poisson number of times, sources weighed by the square root of their size; in random order.

    A null source is a source; rows with a null id get equal counts; null texts count like others. An empty table stays empty.
    """
    return mix_sources(docs, power=0.5).select(COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, of 24, and slot; equal texts share a shard.

    Every row has a slot of its own, repeated or without an id or text. An empty table gives no rows.
    """
    return shard_documents(docs, shards=24)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

#: The classifier's training can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written and read again."""
    store = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = store.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if last:
            store.drop(last)
        last = f"stage{i}"
        store.release()
    return docs
