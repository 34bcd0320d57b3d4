"""File sources and sinks of the harness: CSV tables, key-value logs, split lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "STARTANALYSIS"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which all executors share; only a local
    master may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder or '/tmp/checkpoints/tessella'}/{name}-{uuid.uuid4().hex}"


def first_field(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(text,): the first field of each line of (value,)."""
    return lines.select(F.split_part("value", F.lit(sep), F.lit(1)).alias("text"))


def read_first_field(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return first_field(spark.read.text(path), sep)


def parse_log(lines: DataFrame) -> DataFrame:
    """(record, config, key, value) from (line_no, value) rows of a log.

    What follows the first START counts, also on its own line, and the whole log where there is none;
    a line in braces opens a record, and ``key: value ms`` lines belong to the record open there;
    of equal keys the last counts.  ``config`` is a map of the record's settings."""
    start = lines.filter(F.col("value").contains(START)).agg(F.min("line_no").alias("first"))  # one row, null without START
    body = lines.crossJoin(start).filter("first is null or line_no >= first")
    after = F.substr("value", F.locate(START, F.col("value")) + len(START))
    text = F.trim(F.when(F.col("line_no") == F.col("first"), after).otherwise(F.col("value")))
    rows = body.select("line_no", text.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    opens = F.col("line").startswith("{")
    run = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # a log is one small file
    marked = rows.withColumns({
        "record": F.sum(opens.cast("int")).over(run),
        "config": F.last(F.when(opens, F.col("line")), ignorenulls=True).over(run),
    }).filter(~opens & (F.col("record") > 0))
    pair = marked.select(
        "record", settings(F.col("config")).alias("config"), "line_no",
        F.trim(F.regexp_extract("line", r"^([^:]+):", 1)).alias("key"),
        F.regexp_extract("line", r":\s*([-+0-9.eE]+)", 1).try_cast("double").alias("number"),
    ).filter("key <> ''")
    return pair.groupBy("record", "key").agg(F.max_by("number", "line_no").alias("value"), F.any_value("config").alias("config")).select(
        "record", "config", "key", "value"
    )


def settings(line: Column) -> Column:
    """map<string, string> of the innermost braces of a line such as ``{'Config': {'n': 1}}``."""
    inner = F.regexp_extract(line, r"\{([^{}]*)\}", 1)
    parts = F.filter(F.split(inner, r",\s*(?=['\"])"), lambda x: F.trim(x) != "")
    bare = lambda c: F.regexp_replace(F.trim(c), r"^['\"]|['\"]$", "")
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(bare(F.substring_index(x, ":", 1)), bare(F.regexp_extract(x, r"(?s):(.*)$", 1)))))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``parse_log`` of a text file; lines are numbered within the file as read whole."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_log(lines)


def wide(records: DataFrame, keys: list[str] | None = None, configs: list[str] = ()) -> DataFrame:
    """One row per record: a column per setting of ``configs``, as a number where it is one, and a
    column per key, null where a record lacks it."""
    named = [F.col("config")[c].try_cast("double").alias(c) for c in configs]
    rows = records.select("record", *named, "key", "value")
    return rows.groupBy("record", *configs).pivot("key", keys).agg(F.last("value"))
