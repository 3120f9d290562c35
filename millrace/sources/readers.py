"""Readers: JSON lines, text lines, generated problems, logs, tensor headers."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MESSAGE = "struct<role:string,content:string,thinking:string,trainable:boolean,tool_call_id:string,name:string>"
COMPARISON = "struct<prompt_conversation:array<struct<role:string,content:string>>,completion_A:array<struct<role:string,content:string>>,completion_B:array<struct<role:string,content:string>>>"


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines that must all have messages; a malformed or lacking line is an error."""
    df = spark.read.schema(f"messages array<{MESSAGE}>").option("mode", "FAILFAST").json(path)
    missing = F.raise_error(F.lit("a conversation line has no messages")).cast(df.schema["messages"].dataType)
    return df.select(F.coalesce("messages", missing).alias("messages"))


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labelled comparisons; lines that lack comparison or label go."""
    return spark.read.schema(f"comparison {COMPARISON}, label string").json(path).where("comparison IS NOT NULL AND label IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines, and the lines that could not be parsed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    good = parsed.where("row._bad IS NULL").select("row.*").drop("_bad")
    return good, parsed.where("row._bad IS NOT NULL").select("value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines without surrounding white space; blank lines stay."""
    from ..functions.text import strip

    return spark.read.text(path).select(strip("value").alias("value"))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint log with line numbers; no rows if there is no such file."""
    schema = "name string, epoch long, batch long, state_path string, sampler_path string"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, line_no long")
    return spark.read.schema(schema).json(path).withColumn("line_no", F.monotonically_increasing_id())


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric logs as (run_id, step, key, value); run_id is the folder's name. Values that aren't numbers go.

    A line holds its metrics beside step, or under metrics as ``write_metrics`` puts them.
    """
    run = F.regexp_extract(F.input_file_name(), r"(?:run_id=)?([^/=]+)/[^/]*$", 1)
    # the folders are read as such: their names are not taken for columns
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    rows = lines.select(run.alias("run_id"), F.from_json("value", "map<string,string>").alias("m"))
    nested = F.coalesce(F.from_json(F.col("m")["metrics"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.map_concat(F.map_filter("m", lambda k, _: ~k.isin("step", "metrics")), nested)
    each = rows.select("run_id", F.col("m")["step"].cast("long").alias("step"), F.explode(own).alias("key", "text"))
    return each.select("run_id", "step", "key", F.col("text").try_cast("double").alias("value")).where("value IS NOT NULL")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace events with line numbers."""
    return spark.read.schema("name string, ph string, pid long, tid long, ts double, args map<string,string>, cat string").json(path).withColumn("line_no", F.monotonically_increasing_id())


def arithmetic_problems(spark: SparkSession, batches: int, size: int, salt: int = 0) -> DataFrame:
    """Sums of x and y from 0 to 100 that (batch, place) decide."""
    base = spark.range(batches * size).select((F.col("id") / size).cast("long").alias("batch_idx"), (F.col("id") % size).alias("pos"))
    number = lambda k: F.pmod(F.xxhash64("batch_idx", "pos", F.lit(salt), F.lit(k)), F.lit(101)).cast("int")
    return base.withColumns({"x": number(0), "y": number(1)}).withColumns({"question": F.concat(F.lit("What is "), F.col("x").cast("string"), F.lit(" + "), F.col("y").cast("string"), F.lit("?")), "answer": (F.col("x") + F.col("y")).cast("string")})


def guess_numbers(spark: SparkSession, seed: int = 0, most: int = 1024, train: float = 0.9) -> DataFrame:
    """The numbers below ``most`` in shuffled order, split into train and test."""
    from ..operators.dataset import with_position

    return with_position(spark.range(most).select(F.col("id").alias("number")), "number", seed).withColumn("split", F.when(F.col("rn") <= int(most * train), "train").otherwise("test"))


def ground_truth(df: DataFrame) -> Column:
    """Gold answers: reward_model's ground_truth (its target if it has one), else golden_answers; anything but a list of strings is an error."""
    from pyspark.sql.types import ArrayType, StringType, StructType

    options = []
    if "reward_model" in df.columns:
        truth = df.schema["reward_model"].dataType["ground_truth"].dataType
        options.append(F.col("reward_model.ground_truth.target") if isinstance(truth, StructType) else F.col("reward_model.ground_truth"))
    if "golden_answers" in df.columns:
        options.append(F.col("golden_answers"))
    if not options:
        raise ValueError("no column has gold answers")
    kinds = [df.select(o).schema[0].dataType for o in options]
    if any(not isinstance(k, ArrayType) or not isinstance(k.elementType, StringType) for k in kinds):
        raise TypeError("gold answers must be lists of strings")
    return F.coalesce(*options)


def key_variant(df: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """The first pair of columns that the table has, as problem and answer; no rows if it has none."""
    for problem, answer in names:
        if problem in df.columns and answer in df.columns:
            return df.select(F.col(problem).alias("problem"), F.col(answer).alias("answer"))
    return df.sparkSession.createDataFrame([], "problem string, answer string")


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Shard(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        # Hadoop writes local URIs with a single slash
        own = partition.path.replace("file:/", "file:///", 1) if partition.path.startswith("file:/") and "://" not in partition.path else partition.path
        store, path = fs.FileSystem.from_uri(own) if "://" in own else (fs.LocalFileSystem(), own)
        with store.open_input_file(path) as f:
            (size,) = struct.unpack("<Q", f.read(8))
            header = json.loads(f.read(size))
        for name, spec in header.items():
            if name != "__metadata__":
                yield (name, [int(x) for x in spec["shape"]], partition.path)


class TensorHeaders(DataSource):
    """Format tensor_headers: (name, shape, shard) from the headers of tensor files, a partition each.

    Option path: files, separated by commas: of a store that their URI names (as file, hdfs or s3), or on a
    file system that all executors mount. Only headers are read.
    """

    @classmethod
    def name(cls):
        return "tensor_headers"

    def schema(self):
        return "name string, shape array<bigint>, shard string"

    def reader(self, schema):
        return _HeaderReader([p for p in self.options["path"].split(",") if p])


def tail_log(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of the lines that are appended to a folder of JSON logs; ``files`` at most are taken in a trigger, which bounds what is waiting."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path)


def table_stream(spark: SparkSession, path: str, schema, files: int | None = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, in any order of arrival."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
